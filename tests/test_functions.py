"""Ranks, medians, quantile, rounding and neighbours against plain Python."""
import random
import statistics

from pyspark.sql import functions as F

from bourseflow.functions import exprs, ordering, ranking


def rows(seed=3, n=400):
    rnd = random.Random(seed)
    vals = [rnd.choice([-5.5, 0.0, 0.1, 7.25, 1e9, -1e-7]) if rnd.random() < 0.6 else round(rnd.uniform(-100, 100), 3) for _ in range(n)]
    # one group and one value hold a large share of the rows
    return [(i, "hot" if rnd.random() < 0.7 else rnd.choice("ab"), v) for i, v in enumerate(vals)]


def test_rank_and_average_rank_match_definition(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, g string, v double")
    got = {r.id: (r["rank"], r.total) for r in ranking.with_rank(df, ["g"], "v", total="total").collect()}
    asc = {r.id: r["rank"] for r in ranking.with_rank(df, ["g"], "v", descending=False).collect()}
    avg = {r.id: (r["rank"], r.n) for r in ranking.with_average_rank(df, ["g"], "v").collect()}
    for i, g, v in data:
        peers = [x for _, h, x in data if h == g]
        assert got[i] == (1 + sum(x > v for x in peers), len(peers))
        assert asc[i] == 1 + sum(x < v for x in peers)
        assert avg[i] == (sum(x < v for x in peers) + (sum(x == v for x in peers) + 1) / 2, len(peers))


def test_rank_over_everything(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "id int, v double")
    assert {r.id: r["rank"] for r in ranking.with_rank(df, [], "v").collect()} == {1: 1, 2: 1, 3: 3}


def test_median(spark):
    data = rows(9)
    df = spark.createDataFrame(data, "id int, g string, v double")
    for r in ranking.medians(df, ["g"], "v").collect():
        assert r["median"] == statistics.median(v for _, g, v in data if g == r.g)


def test_crowded_values_spread_over_parts(spark):
    """A million distinct values within a tenth of a percent, and a crowd inside a crowd: bounded parts, exact positions."""
    df = spark.range(1_000_000).select(F.when(F.col("id") < 300_000, 1.0 + F.col("id") * 1e-12).otherwise(1.0 + F.col("id") * 1e-9).alias("v"))
    counts = df.withColumn("ties", F.lit(1).cast("long"))
    placed, path = ranking.parts(counts, [], "v")
    sizes = placed.groupBy(*path).count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("parts")).first()
    assert sizes.most <= 3 * ranking.MOST and sizes.parts > 200
    order = sorted([1.0 + i * 1e-12 for i in range(300_000)] + [1.0 + i * 1e-9 for i in range(300_000, 1_000_000)])
    less = {}
    for i, v in enumerate(order):
        less.setdefault(v, i)
    got = ranking.positions(df, [], "v").where("pmod(xxhash64(v), 1000) = 0").collect()
    assert len(got) > 500 and all(r.less == less[r.v] and r.n == 1_000_000 for r in got)


def test_parts_keep_the_order_of_decimals_and_longs(spark):
    rnd = random.Random(8)
    vals = sorted({10**15 + rnd.randrange(4000) for _ in range(2000)} | {-(10**15) - k for k in range(900)} | {0})
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v long")
    for kind in ("long", "decimal(38,6)"):
        x = df.select("g", F.col("v").cast(kind).alias("v"))
        got = ranking.weights_below(x.withColumn("w", F.lit(1).cast("long")), ["g"], "v", "w", most=20)
        assert [int(r.v) for r in got.orderBy("less").collect()] == vals


def test_normal_quantile(spark):
    n = 400
    ps = [(i - 0.5) / n for i in range(1, n + 1)] + [1e-6, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("z", exprs.normal_quantile(F.col("p")))
    for p, z in df.collect():
        assert abs(z - statistics.NormalDist().inv_cdf(p)) < 1e-7


def test_half_up_and_ratio(spark):
    df = spark.createDataFrame([(1234.56785, 0.0), (-0.6430125, 2.0), (None, 1.0)], "a double, b double")
    got = df.select(exprs.half_up("a", 4), exprs.half_up("a", 6), exprs.ratio("a", "b")).collect()
    assert got[0][0] == 1234.5679 and got[0][2] is None
    assert got[1][1] == -0.643013
    assert got[2][0] is None


def test_clean_number(spark):
    texts = ["1,234.5", " 7 ", "", "-", "N/A", "NaN", "inf", "x1", "-3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(exprs.clean_number("t", 18, 2).cast("double"))
    assert [r[0] for r in df.collect()] == [1234.5, 7.0, None, None, None, None, None, None, -3.0]


def test_position_and_neighbours_across_blocks(spark):
    n = 57
    df = spark.createDataFrame([(i, float(i * i)) for i in range(n)], "i int, v double").select(
        F.lit("k").alias("g"), (F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, i * 17000)")).alias("ts"), "i", "v")
    p = ordering.with_position(df, ["g"], "ts")
    assert {r.i: r.pos for r in p.collect()} == {i: i + 1 for i in range(n)}
    near = {r.i: r.near for r in ordering.with_neighbours(p, ["g"], "pos", "v", 5, block=10).collect()}
    for i in range(n):
        assert near[i] == [float(j * j) for j in range(max(0, i - 5), i)] + [float(j * j) for j in range(i + 1, min(n, i + 6))]
