"""Mixing sources to target weights by Poisson replication.

A source with n of N documents and target share w gets the mean repetition rate `epochs * w * N / n`. A document's count is the
Poisson quantile, at that rate, of a uniform number hashed from its doc_id and a seed; the document is repeated that often, and all
copies are shuffled globally by a second hash. Everything is DataFrame functions; the same seed gives the same mixture on any cluster.

Defined results: a null source is a source of its own; rows with equal doc_id and source get equal counts; a null doc_id hashes
as a value of its own; a source without target weight, when weights are given, has rate 0 and vanishes; null and empty texts are
repeated like others; an empty table gives no rows. Extra columns are kept; the added ones, `copy` and `order_key`, replace columns of
these names."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bourseflow.llm.common import small_side, stored

#: Beyond this mean a count is the sum of counts of equal smaller rates, each from its own hash (exp(-rate) stays exact enough).
WHOLE_RATE = 64
#: Most sources whose rates may be broadcast.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Settings:
    weights: Mapping[str | None, float] | None = None    # target share of each source; None: equal shares
    epochs: float = 1.0
    seed: int = 42


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def target(source: Column, weights: Mapping[str | None, float]) -> Column:
    named = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
    out = F.create_map(*named)[source] if named else F.lit(0.0)
    return F.when(source.isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.coalesce(out, F.lit(0.0)))


def rates(docs: DataFrame, s: Settings) -> DataFrame:
    """Per source: rows, mean repetition rate, number of parts, and the cumulative Poisson probabilities of one part."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("weight", F.lit(1.0) if s.weights is None else target(F.col("source"), s.weights))
    total = counts.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weights"))
    rated = counts.join(F.broadcast(total)).withColumn(
        "rate", F.when(F.col("all_weights") > 0, s.epochs * F.col("weight") / F.col("all_weights") * F.col("all_rows") / F.col("rows"))
        .otherwise(F.lit(0.0)))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / WHOLE_RATE)).cast("int")).withColumn(
        "part_rate", F.col("rate") / F.col("parts"))
    none = F.exp(-F.col("part_rate"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("part_rate") + 12 * F.sqrt("part_rate") + 24).cast("int"))

    def step(acc, k):
        p = acc["p"] * F.col("part_rate") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))
    cdf = F.aggregate(steps, F.struct(none.alias("p"), F.array(none).alias("cdf")), step)["cdf"]
    return rated.select("source", "rows", "rate", "parts", cdf.alias("cdf"))


def with_counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents with `rate` and their repetition count `copies`."""
    table = stored(rates(docs, s), "rates")
    rate = small_side(table.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), F.col("parts").alias("_parts"),
                                   F.col("cdf").alias("_cdf")), BROADCAST_ROWS)
    joined = docs.join(rate, docs.source.eqNullSafe(F.col("_source")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))

    def quantile(part):
        u = uniform(F.lit(str(s.seed)), name, part.cast("string"))
        return F.size(F.filter("_cdf", lambda c: c <= u))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda acc, part: acc + quantile(part))
    return joined.withColumn("copies", copies).withColumn("rate", F.col("_rate")).select(*docs.columns, "rate", "copies")


def mixed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The mixture in global random order: every document `copies` times, numbered by `copy`, sorted by `order_key`."""
    docs = docs.drop("copy", "order_key", "rate", "copies")
    repeated = with_counts(docs, s).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.md5(F.concat_ws("|", F.lit(f"{s.seed}-order"), name, F.col("copy").cast("string")))
    return (repeated.withColumn("order_key", key).select(*docs.columns, "copy", "order_key")
            .repartitionByRange("order_key").sortWithinPartitions("order_key"))
