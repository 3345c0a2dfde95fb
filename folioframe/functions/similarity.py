"""Similarity of strings. Spark has no longest common subsequence and no Ratcliff-Obershelp, so these are Arrow UDFs."""

from __future__ import annotations

import difflib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & at.get(ch, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """1 less the insertions and deletions needed, over both lengths."""
    n = len(a) + len(b)
    return 1 - (n - 2 * lcs_length(a, b)) / n if n else 1.0


_word = lru_cache(1 << 16)(indel)


def score_text(query: str, candidate: str) -> float:
    """Both normalised: 1 for a substring, else the better of the whole strings and the mean of each query word's best."""
    if not candidate:
        return 0.0
    if query in candidate:
        return 1.0
    qs, cs = query.split(), set(candidate.split())
    words = sum(max(_word(q, c) for c in cs) for q in qs) / len(qs) if qs and cs else 0.0
    # Whole strings share at most the shorter one; where even that is no better, they need not be compared.
    if 2 * min(len(query), len(candidate)) <= words * (len(query) + len(candidate)):
        return words
    return max(indel(query, candidate), words)


def _best_scores(query, *forms):
    known: dict[tuple, float] = {}
    out = []
    for q, *cs in zip(query, *forms, strict=True):
        best = None
        for c in cs:
            if q is None or c is None:
                continue
            if (q, c) not in known:
                known[q, c] = score_text(q, c)
            best = known[q, c] if best is None else max(best, known[q, c])
        out.append(best)
    return type(query)(out, dtype="float64")


def best_ratio(left: str, rights: list[str]) -> float:
    """difflib's largest ratio of `left` with any of `rights`; a pair that its upper bounds rule out is not compared."""
    best = 0.0
    matcher = difflib.SequenceMatcher(None, "", "")
    for r in dict.fromkeys(rights):
        if r == left:
            return 1.0
        matcher.set_seqs(left, r)
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
            best = max(best, matcher.ratio())
    return best


def _best_ratios(left, *rights):
    known: dict[tuple, float] = {}
    out = []
    for x, *rs in zip(left, *rights, strict=True):
        key = (x, *rs)
        if key not in known:
            known[key] = None if x is None else best_ratio(x, [r for r in rs if r is not None])
        out.append(known[key])
    return type(left)(out, dtype="float64")


def _ratios(left, right):
    return left.combine(right, lambda a, b: None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio())


def _lengths(left, right):
    return left.combine(right, lambda a, b: None if a is None or b is None else lcs_length(a, b))


def score(query: Column, *candidates: Column) -> Column:
    """The best score_text() of the candidates; null candidates are passed over, substrings never reach Python."""
    done = F.when(F.greatest(*(F.coalesce(F.contains(c, query) & (c != ""), F.lit(False)).cast("int") for c in candidates), F.lit(0)) == 1, F.lit(1.0))
    return F.coalesce(done, pandas_udf(_best_scores, DoubleType())(F.when(done.isNull(), query), *(F.when(done.isNull(), c) for c in candidates)))


def lcs(left: Column, right: Column) -> Column:
    return pandas_udf(_lengths, LongType())(left, right)


def ratio(left: Column, right: Column) -> Column:
    """difflib's ratio, with its own rule for long strings."""
    return pandas_udf(_ratios, DoubleType())(left, right)


def closest(left: Column, *rights: Column) -> Column:
    """The largest ratio() of `left` with any of `rights`; nulls among them are passed over, 0 if all are null."""
    return pandas_udf(_best_ratios, DoubleType())(left, *rights)


def round3(c: Column) -> Column:
    """Three decimals of the exact binary value, as Python rounds (Spark's round() goes by the decimal text)."""
    return F.format_number(c, 3).cast("double")
