"""Resolving not-modified revisits of a web archive.

A revisit record says that a page had not changed; its content is that of the latest full response captured earlier under the same
canonical URL. The revisit is resolved if its validators agree with that response (entity tags when both have one, compared weakly;
else the modification dates), and its headers are then merged into the stored ones: the headers that a not-modified answer may
update replace them, all others stay as stored.

The as-of join has three steps, each on less than the one before. Responses are first reduced to one per URL and second (a map-side
combined maximum); seconds fall into time buckets, and the last response of each bucket is carried forward over the buckets of the URL;
only the seconds inside one bucket are ordered in one task, so that no window holds more rows than a bucket has seconds, however many
captures a URL has. Revisits then meet their second by an equality join, which may be split where one second holds many of them.

Defined results: a capture without URL (null, or nothing left of it) has no canonical address: it serves no one and a revisit without
URL is an orphan (canonical is empty text); records without time or with a null record_id never serve as response, and a revisit without
time is an orphan; an earlier response is one with a smaller time (equal times do not count), and of several at that time the one with
the largest record_id; header names compare in lower case, of repeated names the last in text order stays; no validators on either side:
unverified. Extra columns are ignored. Empty tables give no rows."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Headers that a not-modified answer may update (HTTP caching rules).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


@dataclass(frozen=True)
class Settings:
    permitted: tuple[str, ...] = PERMITTED
    tracking: str = r"^(utm_[a-z]+|ref|fbclid|gclid)="      # parameters that do not change the page
    bucket: int = 3600                                      # seconds


def canonical(url: Column, s: Settings = Settings()) -> Column:
    """Host in lower case without `www.` and default port, path without a last slash, other parameters in order, no scheme or fragment."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(head, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(s.tracking)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def tidy(headers: Column) -> Column:
    """Sorted (name, value) pairs with names in lower case, one for each name."""
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                        lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    return F.array_sort(pairs)


def header(pairs: Column, name: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda e: e["name"] == name), F.lit(-1))["value"]


def merged(stored_pairs: Column, fresh: Column, s: Settings) -> Column:
    """Stored headers updated by the permitted ones of the revisit, sorted by name."""
    update = F.filter(fresh, lambda e: e["name"].isin(*s.permitted))
    stay = F.filter(stored_pairs, lambda e: ~F.exists(update, lambda u: u["name"] == e["name"]))
    return F.array_sort(F.concat(stay, update))


def resolve(captures: DataFrame, s: Settings = Settings()) -> DataFrame:
    """captures: record_id string, url string, time long (seconds), kind ('response' or 'revisit'), headers map, digest string.

    One row per revisit: record_id, canonical, time, status (resolved, mismatch, unverified, orphan), and for all but orphans
    response_id, response_time; for resolved and unverified ones also digest and headers (merged, array of name and value)."""
    rows = captures.select("record_id", canonical(F.col("url"), s).alias("canonical"), "time", "kind", tidy(F.col("headers")).alias("headers"),
                           "digest").withColumn("bucket", F.floor(F.col("time") / s.bucket))
    placed = (F.col("canonical") != "") & F.col("time").isNotNull()
    served = F.when((F.col("kind") == "response") & F.col("record_id").isNotNull(), F.struct("time", "record_id", "digest", "headers"))
    seconds = rows.where(placed).groupBy("canonical", "bucket", "time").agg(F.max(served).alias("served"))
    lasts = seconds.groupBy("canonical", "bucket").agg(F.max("served").alias("last"))
    earlier = W.partitionBy("canonical").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select("canonical", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = W.partitionBy("canonical", "bucket").orderBy("time").rowsBetween(W.unboundedPreceding, -1)
    before = (seconds.withColumn("near", F.max("served").over(inside)).join(carried, ["canonical", "bucket"])
              .select("canonical", "time", F.coalesce("near", "carried").alias("of")))
    revisits = rows.where("kind = 'revisit'")
    asked = revisits.where(placed).join(before, ["canonical", "time"], "left").unionByName(
        revisits.where(~F.coalesce(placed, F.lit(False))), allowMissingColumns=True)
    tag, old_tag = (F.regexp_replace(header(F.col(c), "etag"), r"^W/", "") for c in ("headers", "of.headers"))
    date, old_date = (header(F.col(c), "last-modified") for c in ("headers", "of.headers"))
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).when(date.isNotNull() & old_date.isNotNull(), date == old_date)
    status = (F.when(F.col("of").isNull(), "orphan").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch"))
    usable = F.col("status").isin("resolved", "unverified")
    return asked.withColumn("status", status).select(
        "record_id", "canonical", "time", "status", F.col("of.record_id").alias("response_id"), F.col("of.time").alias("response_time"),
        F.when(usable, F.col("of.digest")).alias("digest"),
        F.when(usable, merged(F.col("of.headers"), F.col("headers"), s)).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures as an archive would hold them, derived from pages: each page is fetched three times, an hour and a half apart.

    The first fetch gives a full response but for one page in 16; later ones mostly give a revisit that repeats the entity tag,
    sometimes as a weak one, sometimes another tag, a date only, or none."""
    n = F.col("n")
    digit = F.conv(F.substring(F.md5(F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), n.cast("string"))), 1, 1), 16, 10).cast("int")
    html = F.coalesce("html", F.lit(""))
    digest = F.md5(html)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.coalesce("page_id", F.lit(0)) % 97).cast("string"))
    full = F.when(n == 0, digit > 0).otherwise(digit == 15)
    response = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(html).cast("string"),
                            F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Date"), F.col("time").cast("string"))
    base = F.create_map(F.lit("Date"), F.col("time").cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60"))
    revisit = (F.when(digit < 9, F.map_concat(base, F.create_map(F.lit("etag"), tag)))
               .when(digit < 11, F.map_concat(base, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))))
               .when(digit < 12, F.map_concat(base, F.create_map(F.lit("etag"), F.lit('"other"'))))
               .when(digit < 14, F.map_concat(base, F.create_map(F.lit("last-modified"), day))).otherwise(base))
    rows = pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).withColumn(
        "time", F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0)) % 86_400 + n * 5_400)
    return rows.select(F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), n.cast("string")).alias("record_id"), "url",
                       F.col("time").cast("long").alias("time"), F.when(full, "response").otherwise("revisit").alias("kind"),
                       F.when(full, response).otherwise(revisit).alias("headers"), digest.alias("digest"))


def resolved_text(resolved: DataFrame) -> DataFrame:
    """The same with the merged headers as lines of text."""
    lines = F.array_join(F.transform("headers", lambda e: F.concat(e["name"], F.lit(": "), e["value"])), "\n")
    return resolved.withColumn("headers", lines)
