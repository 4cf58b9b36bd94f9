import pytest
from pyspark.sql import functions as F

from bourseflow.llm.revisit import Settings, canonical, captures_of, resolve, resolved_text

FIELDS = "record_id string, url string, time long, kind string, headers map<string,string>, digest string, status string"


def run(spark, rows, **kw):
    full = [(*r, "extra") for r in rows]
    return {r.record_id: r for r in resolve(spark.createDataFrame(full, FIELDS), Settings(**kw)).collect()}


def test_canonical_url(spark):
    cases = {"HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2", "https://e.org": "e.org", "https://e.org/": "e.org",
             "e.org/x/?ref=y": "e.org/x", None: "", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", canonical(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in rows} == cases


@pytest.mark.parametrize("bucket", [10, 3600])
def test_latest_earlier_response_and_merging(spark, bucket):
    old, new = {"ETag": '"1"', "Content-Length": "5", "Cache-Control": "no"}, {"etag": '"2"', "Content-Length": "7"}
    got = run(spark, [
        ("a", "http://x.org/p", 100, "response", old, "d1"), ("b", "https://www.x.org/p/", 200, "response", new, "d2"),
        ("r0", "http://x.org/p", 100, "revisit", {"etag": '"1"'}, None), ("r1", "http://x.org/p#f", 150, "revisit", {"etag": 'W/"1"', "Cache-Control": "yes", "Content-Length": "0"}, None),
        ("r2", "http://x.org/p", 900, "revisit", {"ETag": '"1"'}, None), ("r3", "http://x.org/p", 100_000, "revisit", {}, None),
        ("r4", "http://y.org/", 100, "revisit", None, None), ("r5", "http://x.org/p", None, "revisit", {"etag": '"1"'}, None)], bucket=bucket)
    assert got["r0"].status == "orphan" and got["r4"].status == "orphan" and got["r5"].status == "orphan"
    assert got["r1"].status == "resolved" and got["r1"].response_id == "a" and got["r1"].digest == "d1"
    assert [tuple(x) for x in got["r1"].headers] == [("cache-control", "yes"), ("content-length", "5"), ("etag", 'W/"1"')]
    assert got["r2"].status == "mismatch" and got["r2"].response_id == "b" and got["r2"].headers is None
    assert got["r3"].status == "unverified" and got["r3"].digest == "d2"


def test_dates_ties_and_nulls(spark):
    u = "x.org"
    got = run(spark, [("a", u, 5, "response", {"Last-Modified": "m"}, "d1"), ("b", u, 5, "response", {"Last-Modified": "n"}, "d2"),
                      (None, u, 6, "response", {}, "d3"), ("c", u, None, "response", {}, "d4"), ("r", u, 7, "revisit", {"last-modified": "n"}, None),
                      ("q", u, 7, "revisit", {"last-modified": "x", "etag": '"e"'}, None), ("q2", u, 7, "revisit", {"last-modified": "n"}, None)])
    assert got["r"].status == got["q2"].status == "resolved" and got["r"].response_id == "b" and got["q"].status == "mismatch"
    assert resolve(spark.createDataFrame([], FIELDS)).count() == 0


def test_captures_without_url_serve_no_one(spark):
    got = run(spark, [("a", None, 1, "response", {"etag": '"1"'}, "page A"), ("b", "https://", 1, "response", {"etag": '"1"'}, "page B"),
                      ("r", None, 5, "revisit", {"etag": '"1"'}, None), ("q", "", 5, "revisit", {}, None), ("n", None, None, "revisit", None, None)])
    assert {(i, r.status, r.canonical, r.digest, r.response_id) for i, r in got.items()} == {(i, "orphan", "", None, None) for i in "rqn"}


def test_one_url_with_most_captures(spark):
    """Against a scan over all captures: one address holds nearly all rows, many of them in the same second; repeated rows stay."""
    rows = [(f"c{i}", "hot.org/p" if i % 9 else f"x.org/{i % 5}", (i * i) % 700 // 7, "response" if i % 4 == 0 else "revisit", {"etag": f'"{i % 3}"'}, f"d{i}")
            for i in range(900)]
    full = [(*r, "extra") for r in rows] + [(*rows[1], "extra")]
    got = resolve(spark.createDataFrame(full, FIELDS), Settings(bucket=20)).collect()
    assert len(got) == sum(r[3] == "revisit" for r in full)
    for r in got:
        before = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == r.canonical and x[2] < r.time]
        assert (r.response_time, r.response_id) == (max(before) if before else (None, None))


def test_captures_of_awkward_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>x"), (None, None, None), (1, "http://a.org/", "<p>x")], "page_id long, url string, html string")
    captures = captures_of(pages.selectExpr("*", "1 as time", "2 as n", "3 as kind"))
    assert captures.count() == 9
    assert resolved_text(resolve(captures)).count() == captures.where("kind = 'revisit'").count()
    assert captures_of(pages.limit(0)).count() == 0
