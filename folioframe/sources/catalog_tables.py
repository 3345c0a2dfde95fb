"""The tables of a catalogue, their columns, and ways to open them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The relational layout of a catalogue.
SCHEMAS = {
    "books": "id bigint, title string, sort string, timestamp string, pubdate string, path string, uuid string, last_modified string",
    "authors": "id bigint, name string",
    "books_authors_link": "id bigint, book bigint, author bigint",
    "tags": "id bigint, name string",
    "books_tags_link": "id bigint, book bigint, tag bigint",
    "publishers": "id bigint, name string",
    "books_publishers_link": "id bigint, book bigint, publisher bigint",
    "data": "id bigint, book bigint, format string, uncompressed_size bigint, name string",
    "identifiers": "id bigint, book bigint, type string, val string",
}


class MissingCatalog(FileNotFoundError):
    """There is no catalogue at this place."""


class WrongSchema(ValueError):
    """Tables or columns are absent."""


@dataclass
class Catalog:
    """A catalogue's tables by name, and the folder its books' paths are relative to."""

    tables: dict[str, DataFrame]
    root: str = ""

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def probe(self) -> dict[str, list[str]]:
        """What is absent, by table; {} for a good catalogue."""
        out = {}
        for name, schema in SCHEMAS.items():
            if name not in self.tables:
                out[name] = ["<table absent>"]
            elif gone := sorted({c.split()[0] for c in schema.split(", ")} - set(self.tables[name].columns)):
                out[name] = gone
        return out

    def checked(self) -> Catalog:
        if gone := self.probe():
            raise WrongSchema(str(gone))
        return self

    def custom_column(self, label: str) -> int | None:
        """The id of a custom column; its tables' names are known only from it."""
        if "custom_columns" not in self.tables:
            return None
        row = self["custom_columns"].where(self["custom_columns"]["label"] == label).select("id").first()
        return None if row is None else int(row.id)


def from_parquet(spark: SparkSession, folder: str, root: str = "", names: tuple[str, ...] | None = None) -> Catalog:
    """A folder with <table>.parquet for each table; tables that can't be read are left out for probe() to tell.

    Custom columns are known from custom_columns alone: the values and links of each are read where they are there.
    """
    from pyspark.errors import AnalysisException

    out: dict[str, DataFrame] = {}

    def read(*tables: str) -> None:
        for name in tables:
            try:
                out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
            except AnalysisException:
                continue

    read(*(names or (*SCHEMAS, "custom_columns")))
    if not out:
        raise MissingCatalog(folder)
    if names is None and "custom_columns" in out:
        # One row for each column that somebody has defined.
        for r in out["custom_columns"].select("id").distinct().collect():
            read(f"custom_column_{r.id}", f"books_custom_column_{r.id}_link")
    return Catalog(out, root or folder)
