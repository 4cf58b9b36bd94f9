"""Streaming jobs with a key in more than one batch."""
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from bourseflow.operators import prices
from bourseflow.streaming import feed, jobs


def landed(spark, path, batches, schema):
    """Each list of rows is one file, landed after the one before."""
    rows = spark.createDataFrame([(*r, k) for k, batch in enumerate(batches) for r in batch], schema + ", part int")
    return jobs.land(rows.repartition(1), str(path / "in"), F.col("part"), len(batches)).drop("part")


BARS = "stock_id long, trade_date date, open double, high double, low double, close double, volume long, arrival int"


def test_newest_arrival_wins_over_batches(spark, tmp_path):
    day = date(2024, 1, 2)
    bar = lambda close, arrival, d=day: (1, d, 1.0, 9.0, 1.0, close, 5, arrival)
    stream = landed(spark, tmp_path, [[bar(7.0, 2)], [bar(3.0, 1), bar(4.0, 1, date(2024, 2, 1))], [bar(5.0, 2, date(2024, 2, 1))]], BARS)
    stocks = spark.createDataFrame([(1, "Asia/Seoul")], "stock_id long, timezone string")
    jobs.finish(jobs.bars_upsert(stream, stocks, f"{tmp_path}/bars", f"{tmp_path}/bad", f"{tmp_path}/ckpt", "2024-03-05 05:00:00"))
    assert sorted((r.trade_date, r.close) for r in spark.read.parquet(f"{tmp_path}/bars").collect()) == [(day, 7.0), (date(2024, 2, 1), 5.0)]


def test_surge_counts_bars_of_earlier_batches(spark, tmp_path):
    days = [date(2024, 1, 1) + timedelta(k) for k in range(24)]
    old = spark.createDataFrame([(1, d, 100, 1) for d in days[:20]], "stock_id long, trade_date date, volume long, arrival int")
    jobs.start_ring(old, f"{tmp_path}/ring", 16)
    stream = landed(spark, tmp_path, [[(1, days[20], 1000, 1)], [(1, days[22], 2000, 1)], [(1, days[21], 3000, 1)], [(1, days[23], 50, 1)]],
                    "stock_id long, trade_date date, volume long, arrival int")
    jobs.finish(jobs.volume_surge(stream, f"{tmp_path}/ring", f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    got = {r.as_of: (r.volume, r.avg_volume_20d) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # the late bar of the third batch changes the mean of the newer one
    assert got == {days[20]: (1000, 100), days[22]: (2000, (18 * 100 + 1000 + 3000) / 20), days[23]: (50, (17 * 100 + 1000 + 3000 + 2000) / 20)}


def test_counts_of_a_day_grow_over_batches(spark, tmp_path):
    at = datetime(2024, 1, 2, 10)
    stream = landed(spark, tmp_path, [[(at, "A", "SUCCESS")], [(at + timedelta(hours=20), "A", "FAILED")], [(at - timedelta(hours=1), "A", "SUCCESS")]],
                    "started_at timestamp, job_type string, status string")
    jobs.finish(jobs.log_quality(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    got = {(str(r.day), r.success, r.failed) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("2024-01-02", 2, 0), ("2024-01-03", 0, 1)}


def test_repeats_in_later_batches_are_dropped(spark, tmp_path):
    at = datetime(2024, 1, 2, 10)
    row = lambda no, hours=0: (no, "사업보고서", at + timedelta(hours=hours))
    stream = landed(spark, tmp_path, [[row("2")], [row("2"), row("3", 5)], [row("3", 5), row("2"), row("1")]], "rcept_no string, title string, filed_at timestamp")
    jobs.finish(jobs.feed_dedupe(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", cursor="1"))
    assert sorted(r.rcept_no for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["2", "3"]


def test_newest_quote_over_batches(spark, tmp_path):
    at = datetime(2024, 1, 2, 10)
    stream = landed(spark, tmp_path, [[("S", at, 1300.0)], [("S", at + timedelta(hours=2), 1310.0)], [("S", at + timedelta(hours=1), 1305.0)]],
                    "granularity string, rate_at timestamp, usd_krw double")
    jobs.finish(jobs.fx_latest(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", "2024-01-02 15:00:00", 4))
    assert [(r.usd_krw, r.stale) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1310.0, False)]


def surge_bars(spark, first, days, stocks=(1, 2, 3), volume=100, arrival=1):
    rows = [(s, date(2024, 1, 1) + timedelta(days=d), volume + s * 10 + d % 7, arrival) for s in stocks for d in range(first, first + days)]
    return spark.createDataFrame(rows, "stock_id long, trade_date date, volume long, arrival int")


def test_ring_equals_the_whole_history(spark, tmp_path):
    """Late, repeated and corrected bars: the ring gives what the newest row of each session gives."""
    first = surge_bars(spark, 0, 60)
    late = surge_bars(spark, 55, 3, volume=900, arrival=2).unionByName(surge_bars(spark, 0, 60))
    more = surge_bars(spark, 60, 5, stocks=(1, 3)).unionByName(surge_bars(spark, 57, 2, stocks=(2,), volume=10, arrival=0))
    parts = [first, late, more]
    whole = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        whole = p if whole is None else whole.unionByName(p)
    stream = jobs.land(whole, str(tmp_path / "in"), F.col("part"), 3).drop("part")
    jobs.finish(jobs.volume_surge(stream, f"{tmp_path}/ring", f"{tmp_path}/out", f"{tmp_path}/ckpt", 4))
    w = Window.partitionBy("stock_id", "trade_date").orderBy(F.desc("arrival"))
    best = whole.withColumn("k", F.row_number().over(w)).where("k = 1").withColumn("close", F.lit(None).cast("decimal(18,4)"))
    want = {(r.stock_id, str(r.as_of)): (r.volume, r.value) for r in prices.volume_surge(best, best.select("stock_id").distinct()).collect()}
    got = spark.read.parquet(f"{tmp_path}/out")
    newest = got.groupBy("stock_id").agg(F.max("as_of").alias("as_of"))
    assert {(r.stock_id, str(r.as_of)): (r.volume, r.value) for r in got.join(newest, ["stock_id", "as_of"]).collect()} == want
    ring = spark.read.parquet(f"{tmp_path}/ring")
    assert ring.groupBy("stock_id").count().where("count > 21").isEmpty() and ring.count() == 63


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    stocks = tuple(range(1, 30))
    jobs.start_ring(surge_bars(spark, 0, 40, stocks), f"{tmp_path}/ring", 8)
    bucket_of = {r.stock_id: r.bucket for r in spark.read.parquet(f"{tmp_path}/ring").select("stock_id", "bucket").distinct().collect()}
    other = next(b for b in set(bucket_of.values()) if b != bucket_of[1])
    for f in (tmp_path / "ring" / f"bucket={other}").glob("*.parquet"):
        f.write_bytes(b"not a parquet file")
    stream = jobs.land(surge_bars(spark, 40, 1, (1,)).withColumn("part", F.lit(0)), str(tmp_path / "in"), F.col("part"), 1).drop("part")
    jobs.finish(jobs.volume_surge(stream, f"{tmp_path}/ring", f"{tmp_path}/out", f"{tmp_path}/ckpt", 8))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def filings(spark, first, days):
    rows = [(f"{date(2024, 1, 1) + timedelta(days=d):%Y%m%d}{k:06d}", str(d % 3), "사업보고서" if k else "[첨부추가]사업보고서", date(2024, 1, 1) + timedelta(days=d))
            for d in range(first, first + days) for k in (0, 1)]
    return spark.createDataFrame(rows, "rcept_no string, company string, title string, filed_at date").withColumn("filed_at", F.col("filed_at").cast("timestamp"))


FEED = "rcept_no string, company string, title string, filed_at timestamp, stock_id long"


def test_windows_cover_every_day_once():
    got = feed.windows(date(2024, 1, 1), date(2024, 12, 31))
    assert got[0] == (date(2024, 1, 1), date(2024, 3, 30)) and got[-1][1] == date(2024, 12, 31) and all((b - a).days < 90 for a, b in got)
    assert all(b + timedelta(days=1) == c for (_, b), (c, _) in zip(got, got[1:])) and feed.windows(date(2024, 1, 2), date(2024, 1, 1)) == []


def test_failed_window_leaves_the_cursor(spark, tmp_path):
    """The second window fails: no row is visible and the cursor stays; the run after it asks only for what is missing."""
    stocks = spark.createDataFrame([(10, "0"), (11, "1")], "stock_id long, company string")
    rows, target, asked = filings(spark, 0, 300), str(tmp_path / "feed"), []
    feed.start_at(spark, target, "20240110000000", date(2024, 1, 10))
    broken = [True]

    def pull(a, b):
        asked.append(a)
        if broken[0] and len(asked) == 2:
            raise RuntimeError("no answer")
        return rows.where(F.col("filed_at").cast("date").between(F.lit(a), F.lit(b)))
    with pytest.raises(RuntimeError):
        feed.load(spark, pull, stocks, target, 0, date(2024, 9, 30))
    assert feed.cursor(spark, target) == ("20240110000000", date(2024, 1, 10)) and feed.loaded(spark, target, FEED).count() == 0
    broken[0] = False
    assert feed.load(spark, pull, stocks, target, 0, date(2024, 9, 30)) == "loaded"
    assert len(asked) == 4 and asked[0] == date(2024, 1, 8) and asked[1] == asked[2]
    want = sorted(r.rcept_no for r in rows.where("company <> '2' AND rcept_no > '20240110000000' AND rcept_no < '20241001' AND rcept_no LIKE '%1'").collect())
    assert sorted(r.rcept_no for r in feed.loaded(spark, target, FEED).collect()) == want
    assert feed.cursor(spark, target) == ("20240930000001", date(2024, 9, 30))
    # the same batch adds nothing; a batch without news keeps the cursor
    assert feed.load(spark, pull, stocks, target, 0, date(2024, 9, 30)) == "skipped"
    assert feed.load(spark, pull, stocks, target, 1, date(2024, 9, 30)) == "loaded"
    assert feed.loaded(spark, target, FEED).count() == len(want) and feed.cursor(spark, target) == ("20240930000001", date(2024, 9, 30))


def test_first_load_without_a_cursor(spark, tmp_path):
    stocks = spark.createDataFrame([(10, "0")], "stock_id long, company string")
    empty = filings(spark, 0, 1).limit(0)
    target = str(tmp_path / "feed")
    assert feed.cursor(spark, target) is None
    assert feed.load(spark, lambda a, b: empty, stocks, target, 0, date(2024, 5, 10)) == "loaded"
    assert feed.cursor(spark, target) == ("20240503000000", date(2024, 5, 3))


def test_a_large_landing_is_one_batch(spark, tmp_path):
    rows = spark.range(900_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), F.xxhash64("id", F.lit(2)).alias("c"), F.expr("cast(id % 3 div 2 AS int)").alias("part"))
    stream = jobs.land(rows, str(tmp_path / "in"), F.col("part"), 2).drop("part")
    sizes = []
    jobs.finish(stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).option("checkpointLocation", f"{tmp_path}/ckpt")
                .trigger(availableNow=True).start())
    assert sizes == [600_000, 300_000]
