"""A folder tree as a table of paths, and hashes of chosen files. Every executor has to reach the paths."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST = "path string, is_dir boolean, length long"
#: Bytes of a file that are read at a time.
CHUNK = 1 << 20
#: Folders that one task lists.
FOLDERS = 256
HASHES = "path string, length long, sha256 string, error string"


def _listed(folders: DataFrame, root: str) -> DataFrame:
    """The entries of each folder (column path, relative to root; '' is root itself); links are not followed."""

    def entries(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                paths, dirs, sizes = [], [], []
                with os.scandir(os.path.join(root, at) if at else root) as found:
                    for e in found:
                        is_dir = e.is_dir(follow_symlinks=False)
                        paths.append(f"{at}/{e.name}" if at else e.name)
                        dirs.append(is_dir)
                        sizes.append(0 if is_dir else e.stat(follow_symlinks=False).st_size)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(dirs, pa.bool_()), pa.array(sizes, pa.int64())], names=["path", "is_dir", "length"])

    return folders.mapInArrow(entries, MANIFEST)


def scan(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """Every entry below root, relative to it, hidden and oddly named ones included (Spark's own listing leaves some out).

    Level by level: the folders of a level are listed by tasks, FOLDERS each; the driver learns only how many there are.
    depth: levels below root, None for all (a catalogue's files are three deep). A level is kept until the session ends.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    level = _listed(spark.createDataFrame([("",)], "path string"), root).persist()
    out, below = level, 1
    while depth is None or below < depth:
        folders = level.where("is_dir").select("path")
        n = folders.count()
        if not n:
            break
        level = _listed(folders.repartition(-(-n // FOLDERS)), root).persist()
        out, below = out.unionByName(level), below + 1
    return out


def file_hashes(paths: DataFrame, column: str = "path") -> DataFrame:
    """path, length, sha256, error of the files in a column of paths; a file is read CHUNK bytes at a time, whatever its size.

    What can't be read has an error and no hash.
    """

    def hashed(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                try:
                    with open(path, "rb") as f:
                        while part := f.read(CHUNK):
                            digest.update(part)
                            size += len(part)
                except (OSError, TypeError, ValueError) as e:
                    rows.append((path, None, None, str(e).splitlines()[-1][:240]))
                    continue
                rows.append((path, size, digest.hexdigest(), None))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[x.split()[0] for x in HASHES.split(", ")])

    return paths.select(F.col(column).cast("string").alias("path")).mapInArrow(hashed, HASHES)


def hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of the given files, a task for every few; one that can't be read is an error."""
    if not paths:
        return spark.createDataFrame([], "path string, length long, sha256 string")
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism))
    found = file_hashes(rows)
    return found.select("path", "length", F.when(F.col("error").isNull(), F.col("sha256")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error"))).alias("sha256"))


def real_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """The rows of paths with `real`, the path without links; a root and the paths below it compare only in this form."""
    place, schema = paths.columns.index(column), StructType([*paths.schema.fields, StructField("real", StringType())])

    def resolved(batches):
        for batch in batches:
            yield batch.append_column("real", pa.array([None if p is None else os.path.realpath(p) for p in batch.column(place).to_pylist()], pa.string()))

    return paths.mapInArrow(resolved, schema)
