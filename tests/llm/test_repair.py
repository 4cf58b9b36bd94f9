"""Conversation repair against all edit sequences, whole conversations against cut ones, and the awkward rows."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bourseflow.llm import repair
from bourseflow.llm.catalog import op12_checkpointed_repair
from tests.conftest import SMALL

ROWS = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
CUTS = repair.Settings(long_rows=2, long_bytes=40, cut_rows=3, cut_bytes=10_000)


def faults(rows):
    """First fault of each (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) over all edit sequences with at most two inserts in a place."""
    fault = faults(rows)
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for extra in inserts:
            now = out + [(r, "") for r in extra]
            paid, done = cost + 5 * len(extra), audit + "I" * len(extra)
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join((r[:1] or "-") for r, _ in now)):
                    if best is None or (paid, done) < best[:2]:
                        best = (paid, done, now)
                continue
            role, text = rows[i]
            go(i + 1, paid + 2, done + "D", now)
            if fault[i] not in ("blank", "duplicate"):
                stay = 5 if fault[i] == "truncated" else 0
                go(i + 1, paid + stay, done + "K", now + [(role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, paid + 1 + stay, done + "R", now + [(r, text)])
    best = (2 * len(rows), "D" * len(rows), [])
    go(0, 0, "", [])
    return best


def plain(table):
    """The whole result by conv_id, read off the definitions."""
    kept, ids = {}, set()
    for conv, turn, role, text in table:
        ids.add(conv)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        kept.setdefault(conv, []).extend([(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    out = {}
    for conv in ids:
        rows = sorted(kept.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [(r, t) for _, r, t in rows]
        f = faults(pairs)
        cost, audit, repaired = cheapest(pairs)
        illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                     illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def read(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def some_conversations(seed, n):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s"], ["Yes.", "No!", "Why?", "so", "", " \n", None, "Ha. \t"]
    return [(conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for conv in range(n) for _ in range(rng.randint(1, 4))]


AWKWARD = [(None, None, None, None), (None, 3, "user", "Hi."), (77, 1, "user", "Hi."), (77, 1, "user", "Hi."), (78, None, "assistant", "..."),
           (79, 5, "user", "long " * 100_000 + "."), (79, 6, "assistant", "ok.")]


@pytest.fixture(scope="module")
def expected():
    return plain(some_conversations(1, 150) + AWKWARD)


@pytest.mark.parametrize("settings", [repair.Settings(), CUTS], ids=["whole", "cut"])
def test_cheapest_and_least_of_all_edit_sequences(spark, expected, settings):
    table = spark.createDataFrame(some_conversations(1, 150) + AWKWARD, ROWS).selectExpr("*", "1 as copies", "'x' as code", "2 as cut", "3 as at")
    assert read(repair.digests(repair.damaged(table), settings)) == expected


def test_checkpoints_and_matrices_agree_with_a_plain_walk():
    rng = random.Random(3)
    for _ in range(200):
        codes = [rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(1, 40))]
        runs = [rng.randint(1, 5) if c == repair.FORCED else 1 for c in codes]
        vectors = [repair.END]
        for c, r in zip(codes[::-1], runs[::-1]):
            vectors.append(repair.before(vectors[-1], c, r))
        step, marks = repair.checkpoints(codes, runs, repair.END)
        assert marks[0] == vectors[-1] and len(marks) <= len(codes) / step + 2
        each, state, cost = repair.edits(codes, runs, repair.END, repair.START)
        # cut anywhere: the same edits
        k = rng.randint(0, len(codes))
        middle = vectors[len(codes) - k]
        left, at, _ = repair.edits(codes[:k], runs[:k], middle, repair.START)
        right, end, _ = repair.edits(codes[k:], runs[k:], repair.END, at)
        assert left + right == each and end == state and cost == marks[0][repair.START]
        audit = "".join(each) + repair.closing(state)
        stays = sum(5 for ops, c in zip(each, codes) if c != repair.FORCED and c >= 4 and ops[-1] in "KR")
        assert cost == 2 * audit.count("D") + 5 * audit.count("I") + audit.count("R") + stays


def test_one_conversation_with_all_rows(spark):
    rows = spark.range(4000).selectExpr("id % 3 = 0 as hot", "id").selectExpr(
        "5L as conv_id", "if(hot, 7L, id) as turn", "if(hot or id % 2 = 0, 'user', 'assistant') as role",
        "if(hot, 'Same words.', concat('Words ', id % 700, '.')) as text")
    one = read(repair.digests(repair.undamaged(rows)))
    many = read(repair.digests(repair.undamaged(rows), repair.Settings(100, 10**9, 200, 10**9)))
    assert one == many and one[5][2] > 1300 and len(one[5][6]) >= 4000


def test_repaired_rows_are_legal_and_hash_to_the_digest(spark):
    table = repair.damaged(spark.createDataFrame(some_conversations(2, 60), ROWS))
    for settings in (repair.Settings(), CUTS):
        rows = {}
        for r in repair.repaired(table, settings).orderBy("conv_id", "at", "part").collect():
            rows.setdefault(r.conv_id, []).append((r.role, r.text))
        for conv, want in read(repair.digests(table, settings)).items():
            got = rows.get(conv, [])
            assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in got))
            assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got).encode()).hexdigest() == want[7]


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert repair.digests(repair.damaged(empty)).count() == 0 and repair.repaired(repair.damaged(empty)).count() == 0


def test_every_conversation_of_the_sample(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = read(op12_checkpointed_repair(spark, SMALL))
    want = plain([tuple(r) for r in table.where(F.col("conv_id") < 12).select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == table.select("conv_id").distinct().count() and all(got[c] == v for c, v in want.items())
