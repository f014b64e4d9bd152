"""Session settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# One hash exchange on the page key must serve every later window, aggregation and join that
# also has that key; the co-partition switch extends this from windows to joins.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Tokenising multiplies rows, so partitions of raw pages are kept smaller than the default.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every column expression is most of the cost of building a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "pagesheaf", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PAGESHEAF_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


# Folders made by this process; nothing else is ever removed.
_MADE: list[str] = []


def remove_shared_folders(spark: SparkSession) -> int:
    """Delete the intermediate folders this process has made, once no table that reads them is needed; returns how many."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    gone = 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate data, below the cluster's shared checkpoint folder.

    A machine-local folder is used only where the session names none and runs on one machine, as in tests. On a
    cluster executors would each write to their own disk, so the folder has to be named there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pagesheaf-")
    _MADE.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a narrow table to the shared folder and read it back.

    Later stages then neither recompute it nor depend on the executors that made it.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
