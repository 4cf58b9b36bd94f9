"""Repair of conversation structure by a checkpointed dynamic program.

A repaired conversation has roles `(s?(ua)+)?` by their initials. Each row is kept (0), reroled to user or assistant (1) or deleted (2,
the only way for blank and repeated rows); an empty user or assistant row may be inserted anywhere (5); a truncated row that stays adds
5. The program runs over four states (nothing yet, system only, after user, after assistant). Backward it stores the vector of four
costs to go at every square root of the length only; walking forward it computes one block of vectors again and takes at each place
the first of D, I, K, R that is tight, so the edits read are the least in ASCII order of all cheapest ones. From one state every initial
leads to one state, so the walk never branches and the repaired rows are determined by the audit.

Conversations of a bounded size are sorted inside a partition and walked one after another. A longer one is cut: its rows are dealt by
range over many tasks, each cut gives a min-plus matrix (cost from each state at its left end to each at its right end), the matrices
are chained to the vector at every cut, each cut is walked from all four states at once, and a second chain picks the real ones. Equal rows of
one turn are one row with a count from the start. Only the digest of a long conversation needs its repaired rows in one task, in order: it
reads them as a stream and holds one hash.

Defined results: rows of a conversation are ordered by turn (nulls first), then role, then text; null roles and texts are one space,
null conv_ids are one conversation; rows that repeat everything are duplicates; a conversation of which nothing is left has zeros, an
empty audit and the hash of an empty text; an empty table gives no rows. Extra columns are ignored; texts of any length are used whole."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from bourseflow.llm.common import small_side, stored

NO_SPACE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

# states: nothing yet, system only, after user, after assistant; a new row takes each to `AFTER_NEW` in the role `NEW_ROLE`
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_NEW = (USER, USER, ASSISTANT, USER)
NEW_ROLE = ("user", "user", "assistant", "user")
# code of a row: its initial (s 0, u 1, a 2, other 3), 4 more if truncated, FORCED if it can only be deleted
FORCED, OTHER = 8, 3
AFTER_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
NEVER = 1 << 60
LEGAL = {(0, 1), (1, 2), (2, 1)}

Costs = tuple[int, int, int, int]
#: Costs to go at the end of a conversation: nothing and after assistant may end, the others insert.
END: Costs = (0, 2 * INSERT, INSERT, 0)


@dataclass(frozen=True)
class Settings:
    long_rows: int = 20_000          # beyond either bound a conversation is cut
    long_bytes: int = 32_000_000
    cut_rows: int = 20_000           # about as many rows in a cut, and bytes
    cut_bytes: int = 32_000_000


# ---- the program over one run of rows ----------------------------------------------------------------------------------------------

def before(after: Costs, code: int, run: int) -> Costs:
    """Costs to go before a row (or `run` rows that can only be deleted), from those behind it."""
    e, s, u, a = after
    if code == FORCED:
        d = DELETE * run
        return e + d, s + d, u + d, a + d
    stay = CUT if code >= 4 else 0
    new_u, new_a = REROLE + stay + u, REROLE + stay + a
    e, s, u, a = min(e + DELETE, new_u), min(s + DELETE, new_u), min(u + DELETE, new_a), min(a + DELETE, new_u)
    kept = code & 3
    if kept == 0:
        e = min(e, stay + after[SYSTEM])
    elif kept == 1:
        k = stay + after[USER]
        e, s, a = min(e, k), min(s, k), min(a, k)
    elif kept == 2:
        u = min(u, stay + after[ASSISTANT])
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(e, INSERT + u), min(s, INSERT + u), u, a


def checkpoints(codes: list[int], runs: list[int], right: Costs) -> tuple[int, list[Costs]]:
    """Block length and the vectors at the left end of every block, from the vector at the right end of all; the last entry is `right`."""
    n = len(codes)
    step = max(1, isqrt(n))
    out, now = [right], right
    for i in range(n - 1, -1, -1):
        now = before(now, codes[i], runs[i])
        if i % step == 0:
            out.append(now)
    return step, out[::-1]


def edits(codes: list[int], runs: list[int], right: Costs, state: int) -> tuple[list[str], int, int]:
    """The edits of each row (inserts before it, then its own) from a state at the left end, the state at the right end, and the cost."""
    step, marks = checkpoints(codes, runs, right)
    out: list[str] = []
    total = marks[0][state]
    for block in range(len(marks) - 1):
        lo, hi = block * step, min((block + 1) * step, len(codes))
        costs = [marks[block + 1]]
        for i in range(hi - 1, lo - 1, -1):
            costs.append(before(costs[-1], codes[i], runs[i]))
        costs.reverse()
        for i in range(lo, hi):
            here, behind, code, lead = costs[i - lo], costs[i - lo + 1], codes[i], ""
            while True:
                if code == FORCED and here[state] == behind[state] + DELETE * runs[i]:
                    out.append(lead + "D" * runs[i])
                    break
                if code != FORCED and here[state] == behind[state] + DELETE:
                    out.append(lead + "D")
                    break
                if here[state] == here[AFTER_NEW[state]] + INSERT:
                    lead, state = lead + "I", AFTER_NEW[state]
                    continue
                stay = CUT if code >= 4 else 0
                kept = AFTER_KEPT.get((state, code & 3)) if code != FORCED else None
                if kept is not None and here[state] == behind[kept] + stay:
                    out.append(lead + "K")
                    state = kept
                    break
                assert code != FORCED and here[state] == behind[AFTER_NEW[state]] + REROLE + stay
                out.append(lead + "R")
                state = AFTER_NEW[state]
                break
    return out, state, total


def closing(state: int) -> str:
    """Inserts at the end of a conversation."""
    return "I" * (END[state] // INSERT)


def replay(state: int, each: list[str], roles: list[str], texts: list[str]) -> Iterator[tuple[int, str, str]]:
    """(row, role, text) of everything that stays or is put in; one entry of `each` more than rows is what follows the last."""
    for i, ops in enumerate(each):
        for op in ops.lstrip("D"):
            if op == "K":
                state = AFTER_KEPT[state, "sua".index(roles[i][0])]
                yield i, roles[i], texts[i]
            elif op in "IR":
                yield i, NEW_ROLE[state], texts[i] if op == "R" else ""
                state = AFTER_NEW[state]


def coded(code: int, copies: int, seen: bool) -> list[tuple[int, int]]:
    """A row with its copies as (code, run): what was seen before, and copies after the first, can only be deleted."""
    if code == FORCED or seen:
        return [(FORCED, copies)]
    return [(code, 1)] + ([(FORCED, copies - 1)] if copies > 1 else [])


# ---- rows ---------------------------------------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with reproducible damage: `copies` is 0 for a dropped row, 2 for a repeated one; null roles and texts are one space."""
    def space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(fault <= 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                                F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that `digests` and `repaired` take."""
    return conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
                                F.lit(1).cast("long").alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(OTHER)
    blank = ~F.col("text").rlike(NO_SPACE)
    return rows.select("conv_id", "turn", "role", "text", "copies", initial.alias("initial"),
                       F.when(blank, FORCED).when(F.col("text").rlike(ENDED), initial).otherwise(initial + 4).alias("code"))


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _split(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of bounded conversations; rows of longer ones (None if there are none) and the number of cuts for them."""
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = stored(sizes.where((F.col("n") > s.long_rows) | (F.col("bytes") > s.long_bytes)), "long-conversations")
    total = long.agg(F.count(F.lit(1)), F.sum("n"), F.sum("bytes")).first()
    if not total[0]:
        return rows, None, 0
    side = small_side(long.select("conv_id"), 100_000)
    on = _same("r", "l", "conv_id")
    return (rows.alias("r").join(side.alias("l"), on, "left_anti"), rows.where("copies > 0").alias("r").join(side.alias("l"), on, "left_semi"),
            -(-total[1] // s.cut_rows) + -(-total[2] // s.cut_bytes))


# ---- conversations of bounded size ----------------------------------------------------------------------------------------------------


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows) of a sorted partition, one conversation at a time."""
    now, held = None, []
    for b in batches:
        ids = b.column("conv_id").to_pylist()
        rest = list(zip(*[b.column(c).to_pylist() for c in ("turn", "role", "text", "copies", "initial", "code")]))
        for conv, row in zip(ids, rest):
            if held and conv != now:
                yield now, held
                held = []
            now = conv
            held.append(row)
    if held:
        yield now, held


def _one(rows: list[tuple]) -> tuple[list[int], list[str], list[str], list[str]]:
    """Counts (gaps, blank, duplicate, truncated, illegal, cost) of one conversation, its edits by row, and the rows' roles and texts."""
    codes, runs, roles, texts, turns, seen = [], [], [], [], set(), set()
    blank = duplicate = truncated = illegal = 0
    last = None
    for turn, role, text, copies, initial, code in rows:
        if not copies:
            continue
        if turn is not None:
            turns.add(turn)
        illegal += (last is not None and (last, initial) not in LEGAL) + copies - 1
        last = initial
        again = (role, text) in seen
        if code == FORCED:
            blank += copies
        else:
            seen.add((role, text))
            duplicate += copies - (not again)
            truncated += not again and code >= 4
        for c, run in coded(code, copies, again):
            codes.append(c)
            runs.append(run)
            roles.append(role)
            texts.append(text)
    each, state, cost = edits(codes, runs, END, START)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return [gaps, blank, duplicate, truncated, illegal, cost], [*each, closing(state)], roles, texts


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _bounded_digests(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out = []

        def table():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *[pa.array(c, pa.int64()) for c in columns[1:7]],
                                               pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())],
                                              ["conv_id", *COUNTS, "audit", "repaired_sha256"])
        ids = None

        def typed():
            nonlocal ids
            for b in batches:
                ids = b.schema.field("conv_id").type
                yield b
        for conv, held in _conversations(typed()):
            counts, each, roles, texts = _one(held)
            lines = "\n".join(f"{role}:{text}" for _, role, text in replay(START, each, roles, texts))
            out.append((conv, *counts, "".join(each), hashlib.sha256(lines.encode()).hexdigest()))
            if len(out) >= 5000:
                yield table()
                out.clear()
        if out:
            yield table()
    return _in_order(_marked(rows)).mapInArrow(
        run, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def _bounded_rows(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        ids = None

        def typed():
            nonlocal ids
            for b in batches:
                ids = b.schema.field("conv_id").type
                yield b

        def table(out):
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                                               pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
                                              ["conv_id", "at", "part", "role", "text"])
        for conv, held in _conversations(typed()):
            _, each, roles, texts = _one(held)
            out = [(conv, i, 0, role, text) for i, (_, role, text) in enumerate(replay(START, each, roles, texts))]
            if out:
                yield table(out)
    return _in_order(_marked(rows)).mapInArrow(run, f"conv_id {kind}, at long, part int, role string, text string")


# ---- longer conversations, cut ----------------------------------------------------------------------------------------------------------

def _cut_rows(rows: DataFrame, cuts: int) -> DataFrame:
    """The distinct rows with counts, in order: `cut` (task of a range partitioning), `at` (place), `seen` (in an earlier turn)."""
    marked = _marked(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    keyed = marked.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(12), "role", "text"))
    moment = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = keyed.groupBy("conv_id", "h1", "h2").agg(F.min(moment).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = keyed.alias("r").join(firsts.alias("f"), _same("r", "f", "conv_id", "h1", "h2"), "left").select(
        "r.conv_id", "turn", "role", "text", "copies", "initial", "code", F.coalesce(moment > F.col("first"), F.lit(False)).alias("seen"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return stored(told.repartitionByRange(cuts, *order).sortWithinPartitions(*order).withColumn("cut", F.spark_partition_id())
                  .withColumn("at", F.monotonically_increasing_id()), "cut-conversations")


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by("at").combine_chunks()


def _codes(group: pa.Table) -> tuple[list[int], list[int], list[int]]:
    """Codes and runs of the rows of a cut, and the row of each."""
    codes, runs, at = [], [], []
    for i, (code, copies, seen) in enumerate(zip(*[group[c].to_pylist() for c in ("code", "copies", "seen")])):
        for c, run in coded(code, copies, seen):
            codes.append(c)
            runs.append(run)
            at.append(i)
    return codes, runs, at


def _summary(kind: str):
    """Matrix and counts of a cut."""
    def run(key, group):
        group = _ordered(group)
        codes, runs, _ = _codes(group)
        matrix = []
        for t in range(4):
            matrix += checkpoints(codes, runs, tuple(0 if x == t else NEVER for x in range(4)))[1][0]
        initial, code, copies, seen = (group[c].to_pylist() for c in ("initial", "code", "copies", "seen"))
        turns = group["turn"].drop_null()
        blank = sum(n for c, n in zip(code, copies) if c == FORCED)
        duplicate = sum(n - (not again) for c, n, again in zip(code, copies, seen) if c != FORCED)
        truncated = sum(c != FORCED and c >= 4 and not again for c, again in zip(code, seen))
        illegal = sum((x, y) not in LEGAL for x, y in zip(initial, initial[1:])) + sum(copies) - len(copies)
        low_high = [turns[0].as_py(), turns[-1].as_py()] if len(turns) else [None, None]
        one = {"matrix": matrix, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "head": initial[0],
               "tail": initial[-1], "low": low_high[0], "high": low_high[1], "turns": len(pc.unique(turns))}
        return pa.table({"conv_id": pa.array([key[0].as_py()], key[0].type), "cut": pa.array([key[1].as_py()], pa.int32()),
                         **{c: pa.array([v], pa.list_(pa.int64()) if c == "matrix" else pa.int64()) for c, v in one.items()}})
    return run, (f"conv_id {kind}, cut int, matrix array<long>, blank long, duplicate long, truncated long, illegal long, head long, tail long, "
                 "low long, high long, turns long")


def _chain_back(kind: str):
    """Vector at the right end of every cut of a conversation, and its totals."""
    def run(key, group):
        rows = group.sort_by("cut").to_pylist()
        now, right = END, []
        for r in reversed(rows):
            right.append(list(now))
            m = r["matrix"]
            now = tuple(min(m[4 * t + s] + now[t] for t in range(4)) for s in range(4))
        with_turns = [r for r in rows if r["turns"]]
        distinct = sum(r["turns"] for r in with_turns) - sum(a["high"] == b["low"] for a, b in zip(with_turns, with_turns[1:]))
        totals = {"gaps": with_turns[-1]["high"] - with_turns[0]["low"] + 1 - distinct if with_turns else 0,
                  **{c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")},
                  "illegal": sum(r["illegal"] for r in rows) + sum((a["tail"], b["head"]) not in LEGAL for a, b in zip(rows, rows[1:])),
                  "cost": now[START]}
        return pa.table({"conv_id": pa.array([key[0].as_py()] * len(rows), key[0].type), "cut": pa.array([r["cut"] for r in rows], pa.int32()),
                         "right": pa.array(right[::-1], pa.list_(pa.int64())),
                         **{c: pa.array([v] * len(rows), pa.int64()) for c, v in totals.items()}})
    return run, f"conv_id {kind}, cut int, right array<long>, {', '.join(f'{c} long' for c in COUNTS)}"


def _walks(kind: str):
    """Of every cut the state at its right end and the edits, for each state at its left end that can be real."""
    def run(key, group, vector):
        codes, runs, _ = _codes(_ordered(group))
        right = tuple(vector["right"][0].as_py())
        walked = [edits(codes, runs, right, state) for state in range(4)]
        return pa.table({"conv_id": pa.array([key[0].as_py()], key[0].type), "cut": pa.array([key[1].as_py()], pa.int32()),
                         "ends": pa.array([[state for _, state, _ in walked]], pa.list_(pa.int32())),
                         "audits": pa.array([["".join(each) for each, _, _ in walked]], pa.list_(pa.string()))})
    return run, f"conv_id {kind}, cut int, ends array<int>, audits array<string>"


def _chain_on(kind: str):
    """State at the left end of every cut of a conversation; the last cut also has the inserts at the end."""
    def run(key, group):
        rows = group.sort_by("cut").to_pylist()
        state, states = START, []
        for r in rows:
            states.append(state)
            state = r["ends"][state]
        return pa.table({"conv_id": pa.array([key[0].as_py()] * len(rows), key[0].type), "cut": pa.array([r["cut"] for r in rows], pa.int32()),
                         "state": pa.array(states, pa.int32()), "close": pa.array([""] * (len(rows) - 1) + [closing(state)], pa.string())})
    return run, f"conv_id {kind}, cut int, state int, close string"


def _replays(kind: str):
    """The repaired rows of a cut."""
    def run(key, group, chosen):
        group = _ordered(group)
        codes, runs, row_of = _codes(group)
        state, right = chosen["state"][0].as_py(), tuple(chosen["right"][0].as_py())
        each = [*edits(codes, runs, right, state)[0], chosen["close"][0].as_py()]
        roles, texts, at = (group[c].to_pylist() for c in ("role", "text", "at"))
        found = list(replay(state, each, [roles[i] for i in row_of], [texts[i] for i in row_of]))
        places = [*row_of, row_of[-1]]
        return pa.table({"conv_id": pa.array([key[0].as_py()] * len(found), key[0].type),
                         "at": pa.array([at[places[i]] for i, _, _ in found], pa.int64()), "part": pa.array(range(len(found)), pa.int32()),
                         "role": pa.array([x for _, x, _ in found], pa.string()), "text": pa.array([x for _, _, x in found], pa.string())})
    return run, f"conv_id {kind}, at long, part int, role string, text string"


def _cut_repairs(rows: DataFrame, cuts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the conversations that are cut: rows in order, chosen walk of every cut, totals of every conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = _cut_rows(rows, cuts)
    small = placed.drop("role", "text")
    summaries = small.groupBy("conv_id", "cut").applyInArrow(*_summary(kind))
    vectors = stored(summaries.groupBy("conv_id").applyInArrow(*_chain_back(kind)), "cut-vectors")
    walks = stored(small.groupBy("conv_id", "cut").cogroup(vectors.select("conv_id", "cut", "right").groupBy("conv_id", "cut"))
                   .applyInArrow(*_walks(kind)), "cut-walks")
    states = walks.select("conv_id", "cut", "ends").groupBy("conv_id").applyInArrow(*_chain_on(kind))
    chosen = stored(states.alias("s").join(walks.alias("w"), _same("s", "w", "conv_id", "cut")).join(
        vectors.alias("v"), _same("s", "v", "conv_id", "cut")).select(
        "s.conv_id", "s.cut", "state", "close", "right", F.concat(F.element_at("audits", F.col("state") + 1), "close").alias("audit")), "chosen-walks")
    return placed, chosen, vectors.drop("cut", "right").dropDuplicates(["conv_id"])


def _cut_output(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    kind = placed.schema["conv_id"].dataType.simpleString()
    return placed.drop("turn", "initial").groupBy("conv_id", "cut").cogroup(
        chosen.select("conv_id", "cut", "state", "close", "right").groupBy("conv_id", "cut")).applyInArrow(*_replays(kind))


def _hashed_streams(rows: DataFrame) -> DataFrame:
    """sha256 of `role:text` lines of each conversation; a task holds the hash, not the rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, digest, ids = None, None, None

        def one():
            return pa.RecordBatch.from_arrays([pa.array([now], ids), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])
        for b in batches:
            ids = b.schema.field("conv_id").type
            for conv, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
                if digest is None or conv != now:
                    if digest is not None:
                        yield one()
                    now, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
        if digest is not None:
            yield one()
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The repaired rows: conv_id, role, text and their order inside a conversation (at, part)."""
    bounded, long, cuts = _split(rows, s)
    out = _bounded_rows(bounded)
    if long is None:
        return out
    placed, chosen, _ = _cut_repairs(long, cuts)
    return out.union(_cut_output(placed, chosen))


def digests(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    bounded, long, cuts = _split(rows, s)
    out = _bounded_digests(bounded)
    if long is None:
        return out
    placed, chosen, totals = _cut_repairs(long, cuts)
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("cut", "audit")))["audit"], "").alias("audit"))
    hashes = _hashed_streams(_cut_output(placed, chosen))
    nothing = hashlib.sha256().hexdigest()
    return out.unionByName(totals.alias("t").join(audits.alias("a"), _same("t", "a", "conv_id")).join(
        hashes.alias("h"), _same("t", "h", "conv_id"), "left").select(
        "t.conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))
