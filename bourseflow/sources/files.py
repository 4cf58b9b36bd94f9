"""Landed files in and partitioned tables out."""
from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bourseflow import constants as K
from bourseflow.accounts import BULK_COLUMNS, BULK_CURRENCY, BULK_REPORT, BULK_STATEMENTS
from bourseflow.functions.exprs import clean_number, number_beyond
from bourseflow.session import checkpoint_dir


# ------------------------------------------------------------------ sources
def read_csv(spark: SparkSession, path: str, schema: str, dims: DataFrame, natural_key: Sequence[str], surrogate: str) -> tuple[DataFrame, DataFrame]:
    """CSV with a header; blanks are NULL; the natural key is replaced by the id of the dimension table.

    Returns the rows, and the rejected ones (reason, row as JSON) whose natural key the dimension does not have."""
    rows = spark.read.option("header", True).option("nullValue", "").option("enforceSchema", False).schema(schema).csv(path)
    known = rows.join(dims.select(*natural_key, F.col(surrogate)), list(natural_key), "left")
    bad = known.where(F.col(surrogate).isNull()).select(F.lit(K.BAD_UNKNOWN).alias("reason"), F.to_json(F.struct(*rows.columns)).alias("row"))
    return known.where(F.col(surrogate).isNotNull()).drop(*natural_key), bad


def read_statement_files(spark: SparkSession, folder: str, encoding: str = "cp949") -> DataFrame:
    """Bulk statement text files: annual-report rows with the statement kind read from its name.

    An amount beyond the column is an error here; `split_statement_files` sets such rows aside."""
    rows = _statement_rows(spark, folder, encoding)
    checked = F.when(F.col("_beyond"), F.raise_error(F.concat(F.lit(f"{K.BAD_NUMBER}: "), F.col("_text")))).otherwise(F.col("amount"))
    return rows.withColumn("amount", checked).drop("_beyond", "_text")


def split_statement_files(spark: SparkSession, folder: str, encoding: str = "cp949") -> tuple[DataFrame, DataFrame]:
    """The rows of the statement files, and the rejected ones (reason, row as JSON) whose amount is a number beyond the column."""
    rows = _statement_rows(spark, folder, encoding)
    kept = [c for c in rows.columns if c not in ("_beyond", "_text")]
    whole = F.struct(*[F.col("_text").alias("amount") if c == "amount" else F.col(c) for c in kept])
    return rows.where(~F.col("_beyond")).select(*kept), rows.where("_beyond").select(F.lit(K.BAD_NUMBER).alias("reason"), F.to_json(whole).alias("row"))


def _statement_rows(spark: SparkSession, folder: str, encoding: str) -> DataFrame:
    """Annual-report rows with the amount also as text and whether it is beyond the column (_text, _beyond)."""
    # Spark 4 reads only Unicode and Latin-1 text unless Java charsets are allowed
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.option("header", True).option("sep", "\t").option("encoding", encoding).option("quote", "").csv(folder)
    names = {c.strip(): c for c in raw.columns}
    missing = [c for c in BULK_COLUMNS.values() if c not in names]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    col = {k: F.trim(F.col(f"`{names[v]}`")) for k, v in BULK_COLUMNS.items()}
    balance, comprehensive, income, consolidated = BULK_STATEMENTS
    kind = (F.when(col["kind"].startswith(balance), "BS").when(col["kind"].contains(comprehensive), "CIS")
            .when(col["kind"].contains(income), "IS"))
    code = F.regexp_replace(col["code"], r"[\[\]]", "")
    currency = F.upper(F.trim(F.col(f"`{names[BULK_CURRENCY]}`"))) if BULK_CURRENCY in names else F.lit(None).cast("string")
    rows = raw.select(code.alias("stock_code"), col["period_end"].cast("date").alias("period_end"), col["kind"].endswith(consolidated).alias("consolidated"),
                      kind.alias("statement"), col["account_id"].alias("account_id"), col["account_nm"].alias("account_nm"),
                      clean_number(col["amount"], 24, 2).alias("amount"), F.nullif(currency, F.lit("")).alias("currency"), col["report"].alias("report"),
                      number_beyond(col["amount"], 24, 2).alias("_beyond"), col["amount"].alias("_text"))
    return rows.where(F.col("statement").isNotNull() & F.col("stock_code").rlike("^[0-9]+$") & (F.col("report") == BULK_REPORT)).drop("report")


# ------------------------------------------------------------------ merging
def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *, update: bool = True, arrival: str | None = None) -> DataFrame:
    """Rows of both sides, one per key; the new row wins (or the old one when `update` is off). Running it twice changes nothing.

    With an `arrival` column, kept by the table, the greatest arrival wins whichever batch brings it, and the new row of equal ones."""
    cols = old.columns
    fresh = new.select(*cols, F.lit(1 if update else -1).alias("_side"))
    stored = old.select(*cols, F.lit(0).alias("_side"))
    order = ([F.desc(arrival)] if arrival else []) + [F.desc("_side")]
    w = Window.partitionBy(*keys).orderBy(*order)
    return stored.unionByName(fresh).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_side")


def replace_keys(old: DataFrame, new: DataFrame, entity: str, keys: Sequence[str], types: Sequence[str], type_col: str = "period_type") -> DataFrame:
    """Upsert that also drops an entity's rows of the given types that the new batch no longer has."""
    touched = new.select(entity).distinct().withColumn("_touched", F.lit(True))
    stale = F.col("_touched").isNotNull() & F.col(type_col).isin(*types)
    kept = old.join(touched, entity, "left")
    rest = kept.where(~F.coalesce(stale, F.lit(False))).drop("_touched")
    return upsert(rest, new, list(keys))


# ------------------------------------------------------------------ tables
def write_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Replace exactly the partitions present in the frame (all rows of one date are regenerated together).

    Rows are dealt by partition first, so a partition has few files however many tasks there are; one with many rows is cut again."""
    df.hint("rebalance", partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    system, p = _hadoop(spark, path)
    return system.exists(p)


def upsert_table(batch: DataFrame, path: str, keys: Sequence[str], partition_by: str, arrival: str | None = None) -> None:
    """Merge a batch into a partitioned table. Only the touched partitions are read and rewritten; the merged rows go to a
    staging table first, so the table is never read while it is replaced, and the staging table goes when they are in place.

    A table that is a plain folder has no readers during a merge: partitions are replaced one after another."""
    spark = batch.sparkSession
    if table_exists(spark, path):
        touched = batch.select(partition_by).distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched), partition_by, "left_semi").select(*batch.columns)
        merged = upsert(old, batch, keys, arrival=arrival)
    else:
        merged = upsert(batch.limit(0), batch, keys, arrival=arrival)
    with staged(merged) as now:
        write_partitions(now, path, partition_by)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """The frame written to the shared folder and read back, for the time of a block; the copy is deleted at its end."""
    spark = df.sparkSession
    staging = f"{checkpoint_dir(spark)}/bourseflow/staging/{uuid.uuid4().hex}"
    df.write.parquet(staging)
    try:
        yield spark.read.schema(df.schema).parquet(staging)
    finally:
        system, p = _hadoop(spark, staging)
        system.delete(p, True)
