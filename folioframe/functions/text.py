"""Text keys and cleaning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The scripts that are never folded, letters whose mark is part of the code point, words that a title key
# drops, name suffixes, and the apostrophes that join one name.
CJK = "぀-ヿ㐀-䶿一-鿿가-힯"
ATOMIC = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ħ": "h",
    "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i", "ŋ": "n", "Ŋ": "N", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ß": "ss",
}
ORDINAL = r"(?:\d+(?:st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)"
EDITION = r"\b(?:edition|ed|revised|rev|si)\b"
MANUAL = r"\b(?:solutions?|manual|instructor)\b"
ARTICLES = r"\b(?:the|a|an)\b"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq")
APOSTROPHES = "'’ʼʾ′`"
ENTITIES = ("&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&apos;", "&nbsp;")


def _is_cjk(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "䶿" or "一" <= ch <= "鿿" or "가" <= ch <= "힯"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row, however often `use` names it; Catalyst writes an expression out each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Characters whose compatibility forms hold no other marks than the general ones, and none of the scripts above.
_COMMON = re.compile("[\u0000-\u036f\u1e00-\u1eff\u2000-\u2069]*\\Z")
_MARKS = re.compile("[\u0300-\u034e\u0350-\u036f]+")  # all but the joiner, which is no mark
_ATOMS = str.maketrans(ATOMIC)


def fold_text(s: str | None) -> str:
    """Latin letters without their marks; the scripts above as they are."""
    if _COMMON.match(s or ""):  # whole strings at a time, with the same result
        return _MARKS.sub("", unicodedata.normalize("NFKD", s or "")).translate(_ATOMS)

    def one(ch: str) -> str:
        if _is_cjk(ch):
            return ch
        bare = (c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        return "".join(ATOMIC.get(c, c) for c in bare)

    return "".join(map(one, unicodedata.normalize("NFC", s or "")))


def _tiers() -> tuple[str, str, dict[str, str]]:
    """The precomposed Latin letters that fold to one character, those characters, and the others with what they fold to."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.category(chr(c))[0] == "L"]
    folded = {c: fold_text(c) for c in letters}
    single = {c: f for c, f in folded.items() if len(f) == 1 and f.isascii() and f != c}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1 and f.isascii()}


_FROM, _TO, _LONGER = _tiers()
_SHORT = "ßæœþÆŒÞ"


def _fold_rest(c: Column) -> Column:
    return pandas_udf(lambda s: s.map(lambda x: None if x is None else fold_text(x)), StringType())(c)


def fold(c: Column, *, native: bool = False) -> Column:
    """fold_text(): ASCII is left as it is, other rows go through Arrow and Python's own tables.

    native: by translate() alone, for text known to be ASCII, precomposed Latin and CJK, or where no UDF may be.
    """
    c = F.coalesce(c, F.lit(""))
    if native:
        out = F.translate(c, _FROM, _TO)
        for letter, into in _LONGER.items():
            if letter in _SHORT:
                out = F.replace(out, F.lit(letter), F.lit(into))
        return out
    plain = F.length(c) == F.octet_length(c)
    return F.coalesce(F.when(plain, c), _fold_rest(F.when(~plain, c)), F.lit(""))


def _caseless(c: Column, native: bool) -> Column:
    return F.lower(F.replace(fold(c, native=native), F.lit("ẞ"), F.lit("ss")))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end (trim() takes spaces alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search_key(c: Column, *, native: bool = False) -> Column:
    """Folded, lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(_caseless(c, native), f"[^a-z0-9{CJK}]+", " "))


def group_key(c: Column, *, drop_manual: bool = False, native: bool = False) -> Column:
    """A title's key for grouping: no brackets, editions or articles. The order of the steps matters."""
    s = F.regexp_replace(_caseless(c, native), r"(?d)\(.*?\)|\[.*?\]|（.*?）", " ")
    s = F.regexp_replace(s, rf"(?U){ORDINAL}\s+edition\b", " ")
    s = F.regexp_replace(s, rf"(?U){EDITION}", " ")
    if drop_manual:
        s = F.regexp_replace(s, rf"(?U){MANUAL}", " ")
    s = F.regexp_replace(s, rf"(?U){ARTICLES}", " ")
    return F.trim(F.regexp_replace(s, f"[^a-z0-9{CJK}]+", " "))


def _first_author(c: Column) -> Column:
    """The first author's name up to a comma."""
    return bound(strip(F.substring_index(F.coalesce(c, F.lit("")), "&", 1)), lambda x: F.when(F.contains(x, F.lit(",")), F.substring_index(x, ",", 1)).otherwise(x))


def _surname(folded: Column) -> Column:
    s = F.lower(F.replace(folded, F.lit("ẞ"), F.lit("ss")))
    s = F.regexp_replace(s, rf"(?U)[^a-z0-9\s{CJK}-]+", " ")
    words = F.filter(F.transform(F.split(s, r"(?U)\s+"), lambda w: F.regexp_replace(w, "^-+|-+$", "")), lambda w: w != "")
    last = lambda ws: F.coalesce(F.try_element_at(F.filter(ws, lambda w: (F.length(w) > 1) & ~w.isin(*SUFFIXES)), F.lit(-1)), F.try_element_at(ws, F.lit(-1)), F.lit(""))
    return bound(words, last)


def surname_key(c: Column, *, native: bool = False) -> Column:
    """The first author's surname: 'Surname, First' or the last word that is no initial or suffix; '' without one."""
    return _surname(F.regexp_replace(fold(_first_author(c), native=native), f"[{APOSTROPHES}]", ""))


def split_authors(c: Column) -> Column:
    """Names of an 'A & B' or 'A and B' string."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?U)\s*&\s*|\s+and\s+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def author_keys(names: Column, *, native: bool = False) -> Column:
    """Distinct non-empty surname keys of an array of names.

    No UDF may run inside an array, so the names are folded as one string, parted by a control character.
    """
    firsts = F.transform(names, lambda x: F.translate(_first_author(x), "\x1f", " "))
    folded = F.split(F.regexp_replace(fold(F.array_join(firsts, "\x1f"), native=native), f"[{APOSTROPHES}]", ""), "\x1f")
    return F.when(names.isNotNull(), F.array_distinct(F.filter(F.transform(folded, _surname), lambda x: x != "")))


def short_authors(names: Column) -> Column:
    """Up to three names, then how many more."""
    return F.when(F.size(names) <= 3, F.array_join(names, " & ")).otherwise(F.concat(F.array_join(F.slice(names, 1, 3), " & "), F.lit(" & +"), (F.size(names) - 3).cast("string")))


def has_entity(c: Column) -> Column:
    """Any of the seven literal HTML entities; null has none."""
    return F.coalesce(c.rlike("&(amp|lt|gt|quot|#39|apos|nbsp);"), F.lit(False))


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def folder_id(c: Column) -> Column:
    """The id in a folder's trailing '(digits)', else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"\((\d+)\)$", 1), F.lit("")), F.lit("9999999999999999999")).cast("long")


def reported_ids(c: Column) -> Column:
    """The integers after the last 'ids:' of a tool's output; none without that mark."""
    found = F.transform(F.regexp_extract_all(F.substring_index(c, "ids:", -1), F.lit(r"\b(\d+)\b")), lambda x: x.cast("long"))
    return F.when(F.contains(c, F.lit("ids:")), found).otherwise(F.array().cast("array<bigint>"))


def deep_link(uuid: Column, prefix: str) -> Column:
    return F.when(F.length(uuid) > 0, F.concat(F.lit(prefix), uuid))
