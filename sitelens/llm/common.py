"""What the operators share: tables in the shared folder, row counts, word tokens."""

from __future__ import annotations

import sys
import tempfile
from types import ModuleType
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sitelens-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: later jobs reread the files, also after executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(column: Column, modulus: int) -> Column:
    """crc32 of a column as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def worker_cache(user: str) -> dict:
    """A dictionary that lives as long as the Python worker: code shipped by value has new
    module variables in every task.

    Workers outlive the stages of a pipeline: what another user kept is dropped."""
    name = "sitelens_llm_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = ModuleType(name)
        sys.modules[name].user, sys.modules[name].held = user, {}
    own = sys.modules[name]
    if own.user != user:
        own.held.clear()
        own.user = user
    return own.held
