"""Many contained-text searches at once, by grams.

Every text is posted under its one-, two- and three-character grams (lower case); only grams that some query asks for are kept. A query
takes the rarest of its own grams, meets the rows posted there and is then checked against their whole texts. So queries meet rows that
share their rarest gram instead of all rows, and a query with a gram that no row has meets none."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

GRAM = 3


def _pieces(text: Column, size: int) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.transform(at, lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def query_grams(queries: DataFrame) -> DataFrame:
    """(q, gram): the three-character pieces of a query, or the query itself where it is shorter."""
    low = F.lower("q")
    grams = F.when(F.length(low) >= GRAM, _pieces(low, GRAM)).otherwise(F.array(low))
    return queries.select("q", F.explode(F.array_distinct(grams)).alias("gram"))


def postings(rows: DataFrame, key: str, texts: Sequence[str]) -> DataFrame:
    """(gram, key) for the grams of all sizes of a row's texts; the empty gram stands for every row."""
    every = F.array(F.lit(""))
    for c in texts:
        low = F.lower(F.coalesce(F.col(c), F.lit("")))
        for size in range(1, GRAM + 1):
            every = F.concat(every, _pieces(low, size))
    return rows.select(key, F.explode(F.array_distinct(every)).alias("gram"))


def candidates(rows: DataFrame, key: str, texts: Sequence[str], queries: DataFrame) -> DataFrame:
    """(q, key): the rows that have the rarest gram of a query."""
    asked = query_grams(queries.select("q").distinct())
    posted = postings(rows, key, texts).join(asked.select("gram").distinct(), "gram", "left_semi")
    held = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a query with a gram that nobody has is left without one
    chosen = (asked.join(held, "gram", "left").groupBy("q")
              .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0"))
    return chosen.select("q", "gram").join(posted, "gram").select("q", key)


def contains(text: Column, q: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lower(q)), F.lit(False))


def search(stocks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Autocomplete for any number of search texts (column q): exact ticker, ticker prefix, name prefix, then contained. The best `limit`
    rows of each text, with `bucket` and `place`; a text's rows are cut inside each task before the shuffle."""
    rows = stocks.where("is_active").select("stock_id", "market", "country", "ticker", "name", "name_en", "coverage")
    met = candidates(rows, "stock_id", ("ticker", "name", "name_en"), queries).join(rows, "stock_id")
    q, ticker, name, en = F.col("q"), F.col("ticker"), F.col("name"), F.col("name_en")

    def begins(text: Column) -> Column:
        return F.coalesce(F.startswith(F.lower(text), F.lower(q)), F.lit(False))
    found = met.where(contains(ticker, q) | contains(name, q) | contains(en, q)).withColumn(
        "bucket", F.when(F.upper(ticker) == F.upper(q), 0).when(begins(ticker), 1).when(begins(name) | begins(en), 2).otherwise(3))
    w = Window.partitionBy("q").orderBy("bucket", F.col("coverage") == "listed", F.length("name"), "name", "stock_id")
    return (found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
            .select("q", "stock_id", "market", "country", "ticker", "name", "coverage", "bucket", "place"))
