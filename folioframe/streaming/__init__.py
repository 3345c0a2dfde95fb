"""Row-level expressions on streams. The catalogue has no event time and no state, so nothing else is needed here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import isbn, text


def keyed(stream: DataFrame, title: str = "title", authors: str = "authors", number: str = "isbn") -> DataFrame:
    """Arriving records with their search, group and surname keys and cleaned ISBN; works on streams and batches alike."""
    return stream.withColumns({"search_key": text.search_key(F.col(title)), "group_key": text.group_key(F.col(title)), "surname_key": text.surname_key(F.col(authors)), "isbn_clean": isbn.clean(F.col(number)), "isbn_valid": isbn.valid(F.col(number))})
