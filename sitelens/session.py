"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Options every job relies on.  Partition counts are left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # JSON.parse keeps the last of two equal keys; so must we.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Facts are structs read field by field.  Splitting such reads into one
    # expression per field would lex the page once per field.
    "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sitelens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        # Call-site capture makes building large expressions ten times slower.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**REQUIRED, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few scan splits; larger inputs are left alone.

    A file of one row group is one task.  The shuffle this adds only happens
    where the whole input has fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder the cluster names.

    A local master without one gets a temporary folder; a cluster must name one, as its
    executors don't share the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="sitelens-"))
    return _OWN_FOLDER[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sitelens-{name}-{uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Computed once, safe against lost executors, and readers prune columns;
    a checkpoint would compute the rows twice and be read whole."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
