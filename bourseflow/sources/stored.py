"""Derived tables written once to the cluster's shared folder and read back.

A stored table cuts the lineage of deep jobs: later steps scan a small columnar file instead of recomputing the bars, and a
lost executor only repeats the scan."""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from bourseflow.session import checkpoint_dir

_STORED: dict[tuple[str, str], str] = {}
_KEPT: list[str] = []


def stored(spark: SparkSession, key: str, build, partition_by: str | None = None) -> DataFrame:
    """Read the table `key` of this application, building and writing it on first use."""
    app = spark.sparkContext.applicationId
    if (app, key) not in _STORED:
        name = hashlib.sha256(key.encode()).hexdigest()[:16]
        path = f"{checkpoint_dir(spark)}/bourseflow/{app}/{name}"
        writer = build().write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        _STORED[(app, key)] = path
    return spark.read.parquet(_STORED[(app, key)])


def kept(df: DataFrame) -> DataFrame:
    """Write an intermediate result to a folder of its own and read it back; `forget` deletes it."""
    path = f"{checkpoint_dir(df.sparkSession)}/bourseflow/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete the stored tables and intermediate results of the running application; the next use builds them again."""
    spark = SparkSession.getActiveSession()
    paths = [*[path for (app, _), path in _STORED.items() if spark and app == spark.sparkContext.applicationId], *_KEPT]
    for path in paths if spark else ():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _STORED.clear()
    _KEPT.clear()
