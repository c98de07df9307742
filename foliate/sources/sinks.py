"""Tables that outlive a query: a shared scratch folder, upserts and caches on Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.results import upsert
from ..operators.scoring import latest


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session that names none."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliate-"))
    return sc.getCheckpointDir()


def _places(spark: SparkSession, path: str):
    """The folder's path, its backup's, and their file system."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, backup = fs_path(path.rstrip("/")), fs_path(f"{path.rstrip('/')}.bak")
    return here, backup, here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path; where an upsert broke off, the version before; where there is none, an empty one of that schema."""
    here, backup, fs = _places(spark, path)
    for place in (here, backup):
        if fs.exists(place):
            return spark.read.schema(schema).parquet(place.toString())
    return spark.createDataFrame([], schema)


def upsert_table(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], schema: str) -> None:
    """Replaces rows of the same keys. The new version is written whole beside the old, which then becomes path.bak; tables that must
    never be without a current version, or change with others, belong into a sources.store.Store."""
    here, backup, fs = _places(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    upsert(read_or_empty(spark, path, schema), rows, keys).write.parquet(beside.toString())
    if fs.exists(here):
        fs.delete(backup, True)
        fs.rename(here, backup)
    fs.rename(beside, here)


def append_cache(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last result of each key."""
    return latest(read_or_empty(spark, path, schema))
