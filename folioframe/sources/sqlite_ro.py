"""A read-only batch source for SQLite files: spark.read.format("sqlite_ro").option("path", ...).option("table", ...).

The file is opened with mode=ro, so nothing can be written through it; every executor has to reach the path. Tables with
an integer id are read in ranges of it. Filters stay with Spark: a reader that takes them keeps them for every later use of
the same DataFrame, and a catalogue's tables are used many times.
"""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructType

from .catalog_tables import SCHEMAS, Catalog, MissingCatalog


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise MissingCatalog(path)
    return sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def table_names(path: str) -> list[str]:
    with connect(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]


def table_schema(path: str, table: str) -> str:
    """Columns by their declared kind; what is not an integer, a real or a boolean is text."""
    kinds = []
    with connect(path) as db:
        for _, name, kind, *_ in db.execute(f"PRAGMA table_info({_quoted(table)})"):
            kind = (kind or "").upper()
            kinds.append(f"`{name}` " + ("bigint" if "INT" in kind else "double" if "REAL" in kind or "DOUB" in kind else "boolean" if "BOOL" in kind else "string"))
    return ", ".join(kinds)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table = options["path"], options["table"]
        self.parts, self.schema = int(options.get("partitions", "1")), schema

    def partitions(self):
        if self.parts > 1 and "id" in self.schema.fieldNames() and self.schema["id"].dataType == LongType():
            with connect(self.path) as db:
                low, high = db.execute(f"SELECT min(id), max(id) FROM {_quoted(self.table)}").fetchone()
            if low is not None:
                step = -(-(high - low + 1) // self.parts)
                return [_Range(a, a + step) for a in range(low, high + 1, step)]
        return [_Range(None, None)]

    def read(self, part: _Range):
        where = [("id", ">=", part.low), ("id", "<", part.high)] if part.low is not None else []
        text = f"SELECT {', '.join(_quoted(f.name) for f in self.schema.fields)} FROM {_quoted(self.table)}"
        if where:
            text += " WHERE " + " AND ".join(f"{_quoted(c)} {sign} ?" for c, sign, _ in where)
        kinds = [f.dataType.typeName() for f in self.schema.fields]
        cast = {"string": str, "long": int, "double": float, "boolean": bool}
        db = connect(self.path)
        try:
            for row in db.execute(text, [v for *_, v in where]):
                yield tuple(None if v is None else cast[k](v) for v, k in zip(row, kinds, strict=True))
        finally:
            db.close()


class SqliteReadOnly(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        return table_schema(self.options["path"], self.options["table"])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), schema)


def open_catalog(spark: SparkSession, path: str, root: str = "", partitions: int = 1) -> Catalog:
    """Every table of a SQLite catalogue, custom columns' tables included."""
    names = table_names(path)
    spark.dataSource.register(SqliteReadOnly)
    read = lambda t: spark.read.format("sqlite_ro").option("path", path).option("table", t).option("partitions", str(partitions)).load()
    wanted = [t for t in names if t in SCHEMAS or t == "custom_columns" or "custom_column_" in t]
    return Catalog({t: read(t) for t in wanted}, root or os.path.dirname(path))
