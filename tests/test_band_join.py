"""Band join against every pair, and the number of rows it makes for a key with many."""
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from bourseflow.operators.band_join import band_pairs, candidates


def test_every_pair_within_the_band(spark):
    rng = random.Random(4)
    day = lambda: date(1969, 12, 1) + timedelta(days=rng.randrange(120))
    a = [(rng.choice([1, 1, 1, 2, None]), rng.choice([day(), day(), day(), None]), i) for i in range(150)]
    b = [(rng.choice([1, 1, 1, 2, None]), rng.choice([day(), day(), day(), None]), i) for i in range(150)]
    left = spark.createDataFrame(a, "k long, p date, i long")
    right = spark.createDataFrame(b, "k long, q date, j long")
    for days in (0, 1, 7, 30):
        want = sorted((i, j) for k, p, i in a for m, q, j in b if k is not None and k == m and p and q and abs((p - q).days) <= days)
        assert sorted((r.i, r.j) for r in band_pairs(left, right, ["k"], "p", "q", days).collect()) == want


def test_one_key_with_100_000_periods(spark):
    days = spark.range(100_000).select(F.lit(1).alias("k"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("p"))
    other = days.withColumnRenamed("p", "q").withColumn("q", F.date_add("q", 3))
    made = candidates(days, other, ["k"], "p", "q", 7)
    assert made.count() <= 22 * 100_000
    kept = band_pairs(days, other, ["k"], "p", "q", 7)
    assert kept.count() == sum(len(range(max(0, i - 10), min(100_000, i + 5))) for i in range(100_000))
