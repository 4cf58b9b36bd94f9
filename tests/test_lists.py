"""Searches by grams against plain containment, and pages at any depth against a sorted list."""
import random

from pyspark.sql import functions as F

from bourseflow.functions import ordering, ranking
from bourseflow.operators import text_search


def stock_rows(n=300):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeÄ가나_%") for _ in range(rnd.randint(2, 9)))
    return [(i, "M", "KR", f"{i:05d}", word().title(), None if i % 4 == 0 else word().upper(), "listed" if i % 3 else "featured", i % 11 != 0) for i in range(n)]


def plain(rows, q, limit):
    low = q.lower()
    found = []
    for i, _, _, ticker, name, en, coverage, active in rows:
        texts = [ticker.lower(), name.lower(), (en or "").lower() if en is not None else None]
        if active and any(t is not None and low in t for t in texts):
            bucket = 0 if ticker.upper() == q.upper() else 1 if texts[0].startswith(low) else 2 if texts[1].startswith(low) or (
                texts[2] is not None and texts[2].startswith(low)) else 3
            found.append((bucket, coverage == "listed", len(name), name.encode(), i))
    return [(i, bucket) for bucket, _, _, _, i in sorted(found)[:limit]]


def test_10_000_searches_equal_containment(spark):
    rows = stock_rows()
    rnd = random.Random(3)
    texts = [t for r in rows for t in (r[3], r[4], r[5]) if t]
    queries = {"", "%", "_", "가", "ä", "zzz", "00", "0000", "a_", "no such text"}
    while len(queries) < 10_000:
        t = rnd.choice(texts)
        a = rnd.randrange(len(t))
        q = t[a:a + rnd.randint(1, 6)]
        queries.add(rnd.choice([q, q.swapcase(), q + rnd.choice("abx"), f"{rnd.randrange(10**6)}"]))
    stocks = spark.createDataFrame(rows, "stock_id long, market string, country string, ticker string, name string, name_en string, coverage string, is_active boolean")
    got = {}
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    for r in text_search.search(stocks, asked.unionByName(asked.limit(50)), 10).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.stock_id, r.bucket))
    for q in queries:
        assert got.get(q, []) == plain(rows, q, 10), q


def test_rarest_gram_bounds_the_candidates(spark):
    """Queries that share a common gram but also have a rare one meet few rows."""
    rows = spark.range(5000).select("id", F.concat(F.lit("common "), F.lpad(F.col("id").cast("string"), 6, "x")).alias("t"))
    asked = rows.where("id % 50 = 7").select(F.col("t").alias("q"))
    assert text_search.candidates(rows, "id", ("t",), asked).count() <= 100 * 60


def test_pages_at_any_depth(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST", 50)
    rnd = random.Random(6)
    data = [(i, None if rnd.random() < 0.1 else rnd.choice([7.0, rnd.uniform(1.0, 1.0001), rnd.uniform(-5, 5)])) for i in range(6000)]
    df = spark.createDataFrame(data, "id long, v double").repartition(4)
    for descending in (True, False):
        order = sorted(data, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[0]))
        for offset, limit in ((0, 7), (1990, 40), (5370, 60), (5990, 50), (7000, 5)):
            got = ordering.page(df, "v", "id", offset, limit, descending=descending).orderBy("place").collect()
            assert [r.id for r in got] == [r[0] for r in order[offset:offset + limit]]
            assert [r.place for r in got] == list(range(offset, min(6000, offset + limit))) and all(r.total == 6000 for r in got)
            for r in got:
                assert r["rank"] == 1 + next(i for i, x in enumerate(order) if x[1] == r.v)


def test_page_of_an_empty_table(spark):
    assert ordering.page(spark.createDataFrame([], "id long, v double"), "v", "id", 0, 5).count() == 0


def test_medians_order_only_the_middle(spark):
    """Groups of 1000 distinct values: at most the values of the middle buckets reach the ordering; results are exact."""
    import statistics
    from unittest import mock
    from bourseflow.functions import ranking
    rows = [(g, float(v * v + 1) if v % 2 else -float(v * 7 + 1)) for g in ("a", "b") for v in range(1000 if g == "a" else 999)] + [(None, 1.0), ("a", None), ("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    seen = []
    placed = ranking.positions

    def watched(d, keys, value):
        seen.append(d.count())
        return placed(d, keys, value)
    with mock.patch.object(ranking, "positions", watched):
        got = {r.g: (r.median, r.n) for r in ranking.medians(df, ["g"], "v").collect()}
        whole = ranking.medians(df, [], "v").first()
    want = {g: [v for k, v in rows if k == g and v is not None] for g in ("a", "b", "c")}
    assert got == {g: (statistics.median(v), len(v)) for g, v in want.items()}
    known = [v for _, v in rows if v is not None]
    assert (whole.median, whole.n) == (statistics.median(known), len(known))
    assert max(seen) < 200
