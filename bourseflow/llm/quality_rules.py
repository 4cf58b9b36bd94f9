"""Quality rules as a bitmask ledger.

Every document is measured once and every rule judged once; what is kept is one row of measurements and one long whose bit r says
that rule r failed. Policies are masks over those bits with a version and are applied to the ledger, never to the texts. What a rule
does inside a policy (documents that fail it, that only it rejects, that the policy would keep without it) comes from the counts of
equal bit patterns: the ledger is summed by pattern first, so nothing grows with the table after that.

Everything is DataFrame functions. The words of a document are an array of its own row; windows of five words are compared by a
64-bit hash inside one document, and only a document that has equal windows sorts them.

Defined results: a null text has no words, lines or symbols and fails `few_words`; rows that repeat a doc_id are judged each for
itself; a null doc_id stays null; an empty table gives no rows. A text of any length is measured whole. Other columns are ignored by
`ledger` and kept by `accepted`. Two different windows of one document count as equal if their 64-bit hashes agree."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bourseflow.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
LETTER_WORD = r"\p{L}[^\x20\x09-\x0D]*"       # from the first letter of a word to its end: once in each word that has one
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_ellipsis_lines", "n_bullet_lines")


@dataclass(frozen=True)
class Rule:
    """A rule owns its bit for ever: a changed rule takes a new bit, so old ledgers and policies keep their meaning."""
    bit: int
    name: str
    fails: str                       # SQL condition over the measurements


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any rule of `never`, or more than `most` rules of `counted`."""
    version: int
    never: tuple[str, ...]
    counted: tuple[str, ...] = ()
    most: int = 0


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "few_letters", "100 * n_letter_words < 30 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "long_words", "word_chars > 100 * n_words"),
    Rule(7, "cut_lines", "100 * n_ellipsis_lines > 30 * n_lines"),
    Rule(8, "lists_only", "n_lines > 2 and 100 * n_bullet_lines > 90 * n_lines"),
)
BASE = ("few_words", "repeated_words")
POLICIES = (
    Policy(1, BASE),
    Policy(2, (*BASE, "symbols", "repeated_lines", "few_letters", "short_words", "long_words"), ("cut_lines", "lists_only"), 1),
)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in names)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often `body` or a function inside it looks at it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice in the document."""
    def covered(starts: Column) -> Column:
        # a window adds the words up to the next one's start, WINDOW at most
        new = F.transform(starts, lambda at, i: F.least(F.lit(WINDOW), F.get(starts, i + 1) - at))
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    def starts_of(ordered: Column) -> Column:
        again = F.filter(ordered, lambda w, i: (F.get(ordered, i - 1)["h"] == w["h"]) | (F.get(ordered, i + 1)["h"] == w["h"]))
        return F.sort_array(F.transform(again, lambda w: w["at"]))

    def of_windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _once(_once(ordered, starts_of), covered))

    def windows(h: Column) -> Column:
        # two words, four words, five words: each the hash of two neighbours
        def both(a: Column, b: Column, ahead: int) -> Column:
            return F.zip_with(a, F.slice(b, ahead + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))
        return _once(both(h, h, 1), lambda two: F.slice(both(both(two, two, 2), h, 4), 1, F.size(h) - WINDOW + 1))

    many = F.size(words) > WINDOW
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(many, _once(_once(hashed, windows), of_windows)).otherwise(F.lit(0))


def measured(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and the measurements of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))
    parts = docs.select(*keep, text.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    w, ln, t = F.col("__words"), F.col("__lines"), F.col("__text")
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOL)),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": _repeat_words(w),
        "n_lines": F.size(ln),
        "n_letter_words": F.regexp_count(t, F.lit(LETTER_WORD)),
        "n_ellipsis_lines": F.size(F.filter(ln, lambda x: x.rlike(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))),
        "n_bullet_lines": F.size(F.filter(ln, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*\x{2022}]"))),
    }
    return parts.select(*keep, *[values[m].cast("long").alias(m) for m in MEASURES])


def _bits(rules: Sequence[Rule]) -> Column:
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own, 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document row: doc_id, the measurements and `fail_bits`."""
    return measured(docs).withColumn("fail_bits", _bits(rules))


def write_ledger(rows: DataFrame, folder: str, run: str) -> None:
    """Add the ledger of a run to a stored one; a run that is written again replaces itself and nothing else."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def passes(policy: Policy, rules: Sequence[Rule] = RULES, bits: Column | None = None) -> Column:
    """The verdict of a policy on a column of failure bits."""
    bits = F.col("fail_bits") if bits is None else bits
    never, counted = (F.lit(mask(names, rules)).cast("long") for names in (policy.never, policy.counted))
    return (bits.bitwiseAND(never) == 0) & (F.bit_count(bits.bitwiseAND(counted)) <= policy.most)


def verdicts(rows: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with one boolean `kept_v<version>` per policy: all versions side by side in one scan of the ledger."""
    return rows.select("*", *[passes(p, rules).alias(f"kept_v{p.version}") for p in policies])


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per policy and rule of it: documents, kept, failed (fail the rule), sole (rejected, kept without the rule) and
    fails_with (bits of all rules that fail together with it)."""
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    bit = {r.name: r.bit for r in rules}
    cases = []
    for p in policies:
        for name in (*p.never, *p.counted):
            without = Policy(p.version, tuple(x for x in p.never if x != name), tuple(x for x in p.counted if x != name), p.most)
            cases.append(F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(bit[name]).alias("bit"),
                                  passes(p, rules).alias("kept"), passes(without, rules).alias("kept_without")))
    seen = patterns.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "c.*")
    fails = F.expr("shiftright(fail_bits, bit) & 1L = 1L")
    return seen.groupBy("version", "rule", "bit").agg(
        F.sum("n").alias("documents"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(~F.col("kept") & F.col("kept_without"), F.col("n")).otherwise(0)).alias("sole"),
        F.coalesce(F.bit_or(F.when(fails, F.col("fail_bits"))), F.lit(0).cast("long")).alias("fails_with"))


def sole_rule(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """The first rule without which the policy would keep a document that it rejects; null if there is none."""
    out = F.lit(None).cast("string")
    for name in reversed((*policy.never, *policy.counted)):
        without = Policy(policy.version, tuple(x for x in policy.never if x != name), tuple(x for x in policy.counted if x != name), policy.most)
        out = F.when(~passes(policy, rules) & passes(without, rules), F.lit(name)).otherwise(out)
    return out


def judged(docs: DataFrame, policy: Policy = POLICIES[-1], rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document row: doc_id, measurements, fail_bits, base_failed, kept, policy, sole_rule, and readmitted: how many
    documents the policy would keep in addition without that rule."""
    rows = stored(ledger(docs, rules), "quality-ledger")
    # one row per rule of the policy
    gain = F.broadcast(ablations(rows, (policy,), rules).select(F.col("rule").alias("sole_rule"), F.col("sole").cast("long").alias("readmitted")))
    base = F.lit(mask(BASE, rules)).cast("long")
    told = rows.select("*", (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), passes(policy, rules).alias("kept"),
                       F.lit(policy.version).alias("policy"), sole_rule(policy, rules).alias("sole_rule"))
    return told.join(gain, "sole_rule", "left").select("doc_id", *MEASURES, "fail_bits", "base_failed", "kept", "policy", "sole_rule", "readmitted")


def accepted(docs: DataFrame, policy: Policy = POLICIES[-1], rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    rows = measured(plain, ("__row",)).where(passes(policy, rules, _bits(rules)))
    return rows.select([F.col("__row").getField(c).alias(c) for c in docs.columns])
