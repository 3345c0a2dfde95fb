"""ISBN cleaning, checking, conversion and extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, strip

#: Fixed value: a labelled ISBN as it stands in running text.
CANDIDATE = r"(?iU)(?:ISBN(?:-1[03])?[\s:]*)(97[89][-\s]?)?(?:\d[-\s]?){9,12}[\dxX]"
# Digits that look right and stand for nothing.
NOUGHT = ("0000000000", "0000000000000", "000000000X")


def clean(c: Column) -> Column:
    """Digits (and a final X of ten) alone; '' for what has not 10 or 13 of them."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^\s*isbn(?:-1[03])?\s*[-: ]*", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^0-9Xx]", ""), "x$", "X")
    return bound(s, lambda x: F.when(x.rlike(r"^(?:[0-9]{9}[0-9X]|[0-9]{13})$") & ~x.isin(*NOUGHT), x).otherwise(F.lit("")))


def _digit(s: Column, i: int) -> Column:
    d = F.substring(s, i, 1)
    return F.when(d == "X", F.lit(10)).otherwise(d.try_cast("int"))


def _sum(s: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + _digit(s, i) * w
    return total


def is_10(cleaned: Column) -> Column:
    return F.coalesce((F.length(cleaned) == 10) & (_sum(cleaned, list(range(10, 0, -1))) % 11 == 0), F.lit(False))


def is_13(cleaned: Column) -> Column:
    return F.coalesce(cleaned.rlike("^97[89]") & (F.length(cleaned) == 13) & (_sum(cleaned, [1, 3] * 6 + [1]) % 10 == 0), F.lit(False))


def valid(c: Column) -> Column:
    return bound(clean(c), lambda s: is_10(s) | is_13(s))


def to_13(c: Column) -> Column:
    """A valid ISBN-10 as its ISBN-13; anything else cleaned."""
    as_13 = lambda s: bound(F.concat(F.lit("978"), F.substring(s, 1, 9)), lambda stem: F.concat(stem, ((10 - _sum(stem, [1, 3] * 6) % 10) % 10).cast("string")))
    return bound(clean(c), lambda s: F.when(is_10(s), as_13(s)).otherwise(s))


# The registrant ranges of the large groups, first to last by their digits; a range's registrants have as many
# digits as its ends.
REGISTRANTS = {
    "0": "00-19 200-699 7000-8499 85000-89999 900000-949999 9500000-9999999",
    "1": "00-09 100-399 4000-5499 55000-86979 869800-998999 9990000-9999999",
    "2": "00-19 200-349 35000-39999 400-699 7000-8399 84000-89999 900000-949999 9500000-9999999",
    "3": "00-02 030-033 0340-0369 03700-03999 04-19 200-699 7000-8499 85000-89999 900000-949999 9500000-9539999 95400-96999 9700000-9899999 99000-99999",
    "4": "00-19 200-699 7000-8499 85000-89999 900000-949999 9500000-9999999",
    "5": "00-19 200-699 7000-8499 85000-89999 900000-909999 91000-91999 9200-9299 93000-94999 9500000-9500999 9501-9799 98000-98999 9900000-9909999 9910-9999",
    "7": "00-09 100-499 5000-7999 80000-89999 900000-999999",
}


def _masked(s: Column) -> Column:
    """Group, registrant, publication and check digit of a cleaned number; the number itself if its group or registrant is not known."""
    long = F.length(s) == 13
    body = F.when(long, F.substring(s, 4, 10)).otherwise(s)

    ranges = [(g, *(e.ljust(7, fill) for e, fill in zip(r.split("-"), "09", strict=True)), len(r.split("-")[0])) for g, rs in REGISTRANTS.items() for r in rs.split()]
    table = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(a).alias("a"), F.lit(z).alias("z"), F.lit(n).alias("n")) for g, a, z, n in ranges))

    def parts(x: Column) -> Column:
        digits = F.substring(x, 2, 7)
        size = F.get(F.filter(table, lambda r: (r["g"] == F.substring(x, 1, 1)) & digits.between(r["a"], r["z"])), 0)["n"]
        told = lambda n: F.concat_ws("-", F.substring(x, 1, 1), F.substr(x, F.lit(2), n), F.substr(x, n + 2, 8 - n), F.substring(x, 10, 1))
        return bound(size, lambda n: F.when(n.isNotNull(), told(n)))

    masked = bound(body, parts)
    return F.coalesce(F.when(long & s.startswith("978"), F.concat(F.lit("978-"), masked)), F.when(~long, masked), s)


def hyphenate(c: Column) -> Column:
    """For display, never for comparison: parts by REGISTRANTS, the cleaned form where they don't say."""
    return bound(clean(c), _masked)


def extract(text: Column) -> Column:
    """Valid ISBNs of a text, distinct, those of 13 digits first."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CANDIDATE), 0), clean)
    good = F.array_distinct(F.filter(found, lambda s: is_10(s) | is_13(s)))
    return F.transform(F.array_sort(F.transform(good, lambda s: F.struct((F.length(s) != 13).alias("k"), s.alias("s")))), lambda x: x["s"])
