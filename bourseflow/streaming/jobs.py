"""Structured Streaming jobs: bars, filings, load log, volume surges and the newest FX quote."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from bourseflow.operators import cleaning, prices
from bourseflow.operators.incremental import annual_reports
from bourseflow.session import checkpoint_dir
from bourseflow.sources.files import staged, table_exists, upsert, upsert_table, write_partitions


#: Rows of one landed file, about.
LANDED_ROWS = 250_000


def land(df: DataFrame, path: str, part: Column, parts: int) -> DataFrame:
    """Write a table as files that landed one after another, and read them as a stream, one batch for each landing.

    `part` (0 to parts - 1) says when a row lands; each landing is a folder of its own, written after the one before from one stored
    copy of the rows. All landings have the same number of files, by the rows of the largest one, and a batch takes that many: so the number of
    batches does not grow with the rows. Only a landing with hardly any rows beside large ones may have fewer files and share a batch."""
    spark = df.sparkSession
    df.withColumn("_part", part).write.partitionBy("_part").parquet(f"{path}/all")
    whole = spark.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(f"{path}/all")
    largest = whole.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    files = max(1, -(-largest // LANDED_ROWS))
    for k in range(parts):
        whole.where(F.col("_part") == k).drop("_part").repartition(files).write.parquet(f"{path}/landed-{k}")
    return spark.readStream.schema(whole.drop("_part").schema).option("maxFilesPerTrigger", files).parquet(f"{path}/landed-*")


def workspace(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/bourseflow/streams/{uuid.uuid4().hex}"


def month(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def finish(query: StreamingQuery) -> None:
    """Wait for a bounded run; a failed query raises here."""
    query.awaitTermination()


def bars_upsert(bars: DataFrame, stocks: DataFrame, target: str, quarantine: str, checkpoint: str, now: str) -> StreamingQuery:
    """Landed bars -> cleaning -> merge into the monthly partitions. The greatest arrival of a key wins, whichever batch brings it;
    the table keeps it. A replayed batch leaves the table as it was."""
    def load(batch: DataFrame, batch_id: int) -> None:
        # the batch is judged once; its months, the merge and the quarantine read the judged rows
        with staged(cleaning.judge_bars(batch, stocks, now)) as judged:
            good, bad = cleaning.split_bars(judged)
            upsert_table(good.withColumn("month", month("trade_date")), target, ["stock_id", "trade_date"], "month", arrival="arrival")
            write_partitions(bad.withColumn("batch", F.lit(batch_id)), quarantine, "batch")
    return bars.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_dedupe(filings: DataFrame, target: str, checkpoint: str, cursor: str = "") -> StreamingQuery:
    """New annual reports, each receipt number once, late repeats within two days included."""
    new = filings.withWatermark("filed_at", "2 days")
    if cursor:
        new = annual_reports(new, cursor)
    new = new.dropDuplicatesWithinWatermark(["rcept_no"])
    return (new.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def log_quality(logs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Status counts per day and job (tumbling windows), kept complete in the target table."""
    counts = (logs.withWatermark("started_at", "1 day").groupBy(F.window("started_at", "1 day"), "job_type")
              .agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCESS", "FAILED", "SKIPPED")])
              .select(F.col("window.start").cast("date").alias("day"), "job_type", "success", "failed", "skipped"))

    def save(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch, target, ["day", "job_type"], "day")
    return (counts.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


#: Sessions that a surge looks back on, the newest included.
RING = 21
RING_COLUMNS = "stock_id long, trade_date date, volume long, arrival int, bucket int"


def ring_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("stock_id"), F.lit(buckets)).cast("int").alias("bucket")


def newest_sessions(bars: DataFrame) -> DataFrame:
    """The ring: the newest RING sessions of each stock. Rings merge: those of old and new bars together hold the ring of both."""
    return prices.newest_bars(bars, RING).drop("rn")


def start_ring(bars: DataFrame, ring: str, buckets: int) -> None:
    """Fill the ring from stored bars, once."""
    rows = bars.select("stock_id", "trade_date", "volume", F.col("arrival").cast("int").alias("arrival"), ring_bucket(buckets))
    write_partitions(newest_sessions(rows), ring, "bucket")


def volume_surge(bars: DataFrame, ring: str, target: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Each batch of bars is merged into the ring of the newest sessions per stock (greatest arrival of a session wins); the stocks it
    touched are then scored from the merged rings. Bars of earlier batches and late ones count; what is read follows the batch: only
    the buckets of its stocks, at most RING rows a stock, however long the history. One row per stock and newest session."""
    def score(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("stock_id", "trade_date", "volume", F.col("arrival").cast("int").alias("arrival"), ring_bucket(buckets))
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]        # at most `buckets` numbers
        if not touched:
            return
        held = spark.read.schema(RING_COLUMNS).parquet(ring) if table_exists(spark, ring) else spark.createDataFrame([], RING_COLUMNS)
        merged = newest_sessions(upsert(held.where(F.col("bucket").isin(touched)), fresh, ["stock_id", "trade_date"], arrival="arrival"))
        with staged(merged) as now:
            write_partitions(now, ring, "bucket")
            scored = prices.volume_surge(now.withColumn("close", F.lit(None).cast("decimal(18,4)")), fresh.select("stock_id").distinct())
            upsert_table(scored.withColumn("month", month("as_of")), target, ["stock_id", "as_of"], "month")
    return bars.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fx_latest(fx: DataFrame, target: str, checkpoint: str, now: str, ttl_hours: float) -> StreamingQuery:
    """The newest quote per granularity, merged over batches, with its staleness."""
    newest = fx.groupBy("granularity").agg(F.max("rate_at").alias("rate_at"), F.max_by("usd_krw", "rate_at").alias("usd_krw"))
    limit = F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {ttl_hours * 3600})")

    def save(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch.withColumn("stale", F.col("rate_at") <= limit), target, ["granularity"], "granularity", arrival="rate_at")
    return (newest.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


__all__ = ["bars_upsert", "feed_dedupe", "finish", "fx_latest", "land", "log_quality", "table_exists", "volume_surge", "workspace"]
