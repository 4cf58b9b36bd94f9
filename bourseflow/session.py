"""Session defaults for a session of our own, and the few settings the operators rely on."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a key that holds a large share of the rows is split at join time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Dates are computed in UTC whatever the cluster's zone; everything else stays as the session has it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_OWN: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a session whose tasks all run on this
    machine (tests) gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _OWN.get(sc.applicationId)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="bourseflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def local(cpus: int | str = "*", app: str = "bourseflow") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
                       "spark.sql.shuffle.partitions": "8", "spark.driver.bindAddress": "127.0.0.1",
                       "spark.driver.host": "127.0.0.1"}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
