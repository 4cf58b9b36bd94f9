"""Small tables with the awkward rows that every operator must take."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(seed: int, n: int) -> str:
    """Invented words, the same for the same seed."""
    out, x = [], seed * 2654435761 % 2**32 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("bcdfglmnprst"[(x >> k) % 12] + "aeiou"[(x >> (k + 3)) % 5] for k in (5, 11, 17)))
    return " ".join(out)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text, clashing extra columns."""
    base = docs_of(spark, [(1, words(1, 60)), (2, words(1, 60)), (2, words(1, 60)), (3, None), (4, ""), (5, " \t\n "), (None, words(5, 40)),
                           (None, None), (7, words(7, 200_000), None, None), (8, "..., ---"), (9, "one"), (10, "one two"), (11, words(11, 80), "de", "b")])
    return base.selectExpr("*", "'x' as score", "1 as shard", "2 as copies", "3 as component", "4 as id", "5 as key", "6 as rate", "7 as count", "8 as version")
