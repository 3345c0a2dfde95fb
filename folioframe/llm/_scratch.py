"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs on this machine alone (tests), a folder of our own is set as the checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path, removed by release() or at the end of the driver."""
    path = f"{shared_folder(spark)}/folioframe-{name}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    _paths.append(path)
    return path


#: Shuffle files go when the table that they were for is written; should its DataFrame run again, Spark makes them anew.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it again: cuts the lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioframe_path = path
    return out


def settle(df: DataFrame, name: str, since: int, keep: tuple[DataFrame, ...] = ()) -> DataFrame:
    """materialise(), then remove all tables made after the first `since`, but for those in `keep` and the new one."""
    out = materialise(df, name)
    stay = {x._folioframe_path for x in (*keep, out)}
    spark = df.sparkSession
    for path in [x for x in _paths[since:] if x not in stay]:
        fs, at = _hadoop(spark, path)
        fs.delete(at, True)
        _paths.remove(path)
    return out


def release(spark: SparkSession, keep: int = 0) -> None:
    """Remove all tables made since the first `keep`; call it once nothing reads them any more."""
    while len(_paths) > keep:
        fs, at = _hadoop(spark, _paths.pop())
        fs.delete(at, True)


def held() -> int:
    return len(_paths)
