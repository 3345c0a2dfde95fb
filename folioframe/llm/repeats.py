"""Removal of repeated byte strings: deep-shallow sorting of the suffixes that can repeat.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else. Only such strings have to be
sorted whose like may exist, and only next to those that may equal them:

1. In every string of that length the rightmost smallest hash of a k-gram is its anchor. Equal strings have equal anchors
   at equal offsets, so strings are compared within an anchor's value alone. The strings of one anchor start side by side;
   together they are a context of length to 2 * length bytes. A context that comes again in just the same bytes is one class
   with a count, so copies of any number are sorted once; a class is named by a 128-bit hash of its bytes.
2. Anchor values that occur once in the corpus leave. Of each other class, one context's bytes go to the sort.
3. Strings of one anchor value are ordered by deep-shallow sorting. A multikey sort with 8-byte characters goes to a
   shallow depth; what is still tied then goes to blind tries: the members of a tied group are compared with the group's
   first one, leave it at the depth and character where they differ, and those that differ alike form the group below.
   Strings that reach one leaf are equal, and they repeat if their classes count two or more. Many anchor values are
   sorted in one go, and a large one some offsets at a time.
   An anchor value with more than CROWD classes (a passage that very many documents have in different surroundings) would
   be one task's: its contexts are compared by 128-bit hashes of ever smaller pieces instead, see _crowded_offsets(). It
   gives the same offsets.
4. The repeating offsets of each class go back to all its contexts, and their spans to the documents.

The same steps find passages of many words that other documents have too, whatever their bytes: there a unit is not a byte but
the 64-bit hash of a word, and a string repeats only if it is in two documents.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import tokenizing as T
from .decontaminate import _mix, merge, word_hashes
from ._workers import map_batches

LENGTH = 400
GRAM = 32
#: Bytes of text whose anchors are found at a time, so few that the arrays stay in a core's cache.
SEGMENT = 1 << 16
#: Strings that are sorted at a time.
STRINGS = 400_000
#: Classes of one anchor value that meet in one task at most.
CROWD = 4096
#: At most so many chosen contexts are told to every task, by a bit set of 16 bits each; more are joined to their texts.
TOLD = 1 << 23
SHALLOW = 4
_TURN = 0xD6E8FEB86659FD93
_RANDOM = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_POSITION = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Kind:
    """Strings of `length` units whose anchors are grams of `gram` units; across: only what two documents have repeats."""

    length: int
    gram: int
    words: bool = False

    @property
    def unit(self) -> int:
        """Bytes of a unit: a byte, or a word's hash."""
        return 8 if self.words else 1

    def units(self, texts: list[str]) -> list[bytes]:
        raws = [t.encode() for t in texts]
        if not self.words:
            return raws
        starts, hashes = word_hashes(b" ".join(raws), _NOT_SPACE)
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raws]))
        return [x.tobytes() for x in np.split(hashes, ends)[: len(raws)]]

    def contexts(self, texts: list[str]):
        return contexts(self.units(texts), self.length, self.gram, words=self.words)


_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def _anchors(raw: bytes, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: each string's anchor's place, and each gram's hash. Fewer than 2^24 units."""
    n = len(raw) // kind.unit - kind.length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    value, have = _mix(np.frombuffer(raw, np.uint64)) if kind.words else _RANDOM[np.frombuffer(raw, np.uint8)], 1
    while have < kind.gram:  # a polynomial of the units' random numbers, mixed at the end
        more = min(have, kind.gram - have)
        value, have = value[: len(value) - more] * np.uint64(pow(_TURN, more, 1 << 64)) + value[more:], have + more
    value = _mix(value)
    # The later of two equal hashes is the smaller one.
    least = (value & ~_POSITION) | (_POSITION - np.arange(len(value), dtype=np.uint64))
    window, have = kind.length - kind.gram + 1, 1
    while have < window:
        more = min(have, window - have)
        least, have = np.minimum(least[: len(least) - more], least[more:]), have + more
    return (_POSITION - (least & _POSITION)).astype(np.int64), value.view(np.int64)


def contexts(raws: list[bytes], length: int = LENGTH, gram: int = GRAM, *, words: bool = False):
    """(text, anchor, hash, low offset, high offset, bytes) of every anchor's context; an offset is the anchor's place less a string's start."""
    kind = Kind(length, gram, words)
    unit = kind.unit
    sizes = [len(x) // unit for x in raws]

    def some(members: list[int], whole: bytes, edges: np.ndarray, skipped: int):
        place, value = _anchors(whole, kind)
        text = np.repeat(np.arange(len(members)), np.diff(edges))[: len(place)]
        inside = np.flatnonzero(np.arange(len(place)) <= edges[text + 1] - length)  # a string lies in one text
        if not len(inside):
            return
        place, text = place[inside], text[inside]
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
        start, end = inside[first], inside[np.append(first[1:], len(inside)) - 1]
        place, text = place[first], text[first]
        at = place - edges[text] + skipped
        for i, p, h, low, high, s, e in zip(text.tolist(), at.tolist(), value[place].tolist(), (place - end).tolist(), (place - start).tolist(), (start * unit).tolist(), ((end + length) * unit).tolist(), strict=True):
            yield members[i], p, h, low, high, whole[s:e]

    group: list[int] = []
    total = 0
    for i, size in enumerate([*sizes, None]):
        if size is not None and size < length:
            continue
        if group and (size is None or total + size > SEGMENT):
            yield from some(group, b"".join(raws[j] for j in group), np.cumsum([0] + [sizes[j] for j in group]), 0)
            group, total = [], 0
        if size is None:
            break
        if size > SEGMENT:  # its parts overlap so that each string lies in one
            for at in range(0, size - length + 1, SEGMENT):
                part = raws[i][at * unit : (at + SEGMENT + length - 1) * unit]
                yield from some([i], part, np.array([0, len(part) // unit]), at)
            continue
        group.append(i)
        total += size


def _class(low: int, high: int, part: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return _two(xxh3_128_digest(part, (high << 20) + low))


def _two(digest: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", digest)


def equal_groups(buffer: np.ndarray, starts: np.ndarray, length: int, apart: np.ndarray | None = None) -> np.ndarray:
    """For each string buffer[start : start + length] a label that only equal strings share; the deep-shallow sort.

    apart: strings with different values of it are kept apart.
    """
    n = len(starts)
    label = np.arange(n)
    if n < 2:
        return label
    chars = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    depths = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    # Shallow: a multikey sort; each round orders what is still tied by the next character.
    order, group = np.arange(n), np.zeros(n, np.int64)
    if apart is not None:
        order = np.argsort(apart, kind="stable")
        group = np.cumsum(np.diff(apart[order], prepend=apart[order[0]]) != 0)
        tied = np.bincount(group)[group] > 1
        order, group = order[tied], group[tied]
        if not len(order):
            return label
    for depth in depths[:SHALLOW]:
        key = chars[starts[order] + depth].astype(np.uint64)
        by = np.lexsort((key, group))
        order, key, group = order[by], key[by], group[by]
        new = np.empty(len(order), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        order, group = order[tied], group[tied]
        if not len(order):
            return label
    # Deep: blind tries, all groups a level at a time. at: how many characters a group is known to share.
    at = np.full(len(order), min(SHALLOW, len(depths)))
    while len(order):
        head = np.empty(len(order), bool)
        head[0] = True
        head[1:] = group[1:] != group[:-1]
        first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        leaves = np.full(len(order), len(depths))
        char = np.zeros(len(order), np.uint64)
        live = np.flatnonzero(~head)
        for d in range(int(at.min()), len(depths)):
            if not len(live):
                break
            mine = chars[starts[order[live]] + depths[d]].astype(np.uint64)
            differ = (mine != chars[starts[first[live]] + depths[d]]) & (at[live] <= d)
            out = live[differ]
            leaves[out], char[out] = d, mine[differ]
            live = live[~differ]
        same = leaves == len(depths)
        label[order[same]] = first[same]
        rest = np.flatnonzero(~same)
        rest = rest[np.lexsort((char[rest], leaves[rest], group[rest]))]
        if not len(rest):
            break
        new = np.empty(len(rest), bool)
        new[0] = True
        new[1:] = (group[rest][1:] != group[rest][:-1]) | (leaves[rest][1:] != leaves[rest][:-1]) | (char[rest][1:] != char[rest][:-1])
        below = np.cumsum(new) - 1
        tied = np.bincount(below)[below] > 1
        order, group, at = order[rest][tied], below[tied], leaves[rest][tied] + 1
    return label


def repeating_offsets(classes: list[tuple], kind: Kind) -> list[tuple[int, int, int]]:
    """Of classes (anchor, first, last, low, high, bytes): runs (place in the list, first and last offset) of the strings that repeat.

    first and last: the least and the largest holder of the class; a string repeats if it has two. Only strings of one
    anchor and offset can be equal. What is sorted at a time is bounded by STRINGS and by the classes.
    """
    if not classes:
        return []
    buffer = np.frombuffer(b"".join(x[5] for x in classes) + bytes(8), np.uint8)
    base = np.cumsum([0] + [len(x[5]) for x in classes])[:-1]
    anchor, least, largest, low, high = (np.array([x[i] for x in classes], np.int64) for i in range(5))
    anchor = np.unique(anchor, return_inverse=True)[1]
    low, top = _within_reach(buffer, base, anchor, low, high, kind)
    total = int(np.maximum(0, top - low + 1).sum())
    if not total:
        return []
    step = int(top.max() - low.min()) + 1
    step = step if total <= STRINGS else max(1, step * STRINGS // total)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(int(low.min()), int(top.max()) + 1, step):
        a, b = np.maximum(low, at), np.minimum(top, at + step - 1)
        size = np.maximum(0, b - a + 1)
        if size.sum() == 0:
            continue
        who = np.repeat(np.arange(len(classes)), size)
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + a[who]
        label = equal_groups(buffer, base[who] + (high[who] - offset) * kind.unit, kind.length * kind.unit, anchor[who] << 32 | offset)
        one, other = least[who].copy(), largest[who].copy()
        np.minimum.at(one, label, least[who])
        np.maximum.at(other, label, largest[who])
        twice = one[label] != other[label]
        found.append((who[twice], offset[twice]))
    if not found:
        return []
    who, offset = (np.concatenate(x) for x in zip(*found, strict=True))
    return _offset_runs(who, offset)


def _shared(chars: np.ndarray, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """For each string a bound, in bytes, of what it has in common with the most alike other of its group: a multikey sort that stops where a string is alone."""
    out = np.zeros(len(starts), np.int64)
    order = np.argsort(group, kind="stable")
    group = np.cumsum(np.diff(group[order], prepend=group[order[0]]) != 0)
    for depth in range(0, most, 8):
        tied = np.bincount(group)[group] > 1
        out[order[~tied]] = np.maximum(0, depth - 1)
        order, group = order[tied], group[tied]
        if not len(order):
            return out
        key = chars[np.minimum(starts[order] + depth, len(chars) - 1)].astype(np.uint64)
        by = np.lexsort((key, group))
        order, key, group = order[by], key[by], group[by]
        group = np.cumsum(np.append(False, (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
    out[order] = most
    return out


def _within_reach(buffer: np.ndarray, base: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) offsets of each class whose strings another class of the anchor may have; first > last: none.

    A string at offset o has o units before the anchor's place and the others from it on, so some class has to agree with
    its own for o units to the left, and some class for the rest to the right.
    """
    unit, most = kind.unit, kind.length * kind.unit
    at = base + high * unit
    forth = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    mirror = np.concatenate([buffer[::-1], np.zeros(8, np.uint8)])
    back = np.ndarray((len(mirror) - 7,), ">u8", mirror, strides=(1,))
    right = _shared(forth, at, anchor, most)
    left = _shared(back, len(buffer) - at, anchor, most)
    return np.maximum(low, kind.length - right // unit), np.minimum(high, left // unit)


def _offset_runs(who: np.ndarray, offset: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(who):
        return []
    order = np.lexsort((offset, who))
    who, offset = who[order], offset[order]
    first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1)))
    last = np.append(first[1:], len(who)) - 1
    return list(zip(who[first].tolist(), offset[first].tolist(), offset[last].tolist(), strict=True))


ANCHORS = "h long, c1 long, c2 long, low int, high int, n long, step int, doc_id long, text_key long, place int"


def _anchor_rows(narrow: DataFrame, kind: Kind) -> DataFrame:
    """A row for each context, or for each run of equal ones that follow in equal steps (periodic text)."""

    def made(batches):
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            for at, part in T.in_parts(texts, 4 << 20):
                rows: list[list] = []
                for i, p, h, low, high, raw in kind.contexts(part):
                    c1, c2 = _class(low, high, raw)
                    if rows and (r := rows[-1])[10] == i and r[0] == h and r[1] == c1 and r[2] == c2:
                        last = r[9] + (r[5] - 1) * r[6]
                        if r[5] == 1 or p - last == r[6]:
                            r[6], r[5] = p - last, r[5] + 1
                            continue
                    rows.append([h, c1, c2, low, high, 1, 0, ids[at + i], keys[at + i], p, i])
                if rows:
                    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=[x.split()[0] for x in ANCHORS.split(", ")])

    return map_batches(narrow, made, ANCHORS)


def _wanted(live: DataFrame, bits: int, *by: str) -> np.ndarray:
    """A bit set of fixed size that has the chosen contexts' places or texts (and, by chance, some others)."""
    at = F.pmod(F.xxhash64(*by), F.lit(1 << bits))  # at most 2^bits / 8 bytes come back
    words = live.select((F.shiftright(at, 15)).alias("part"), (at % (1 << 15)).alias("bit")).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("map")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in words:
        out[r.part << 12 : (r.part << 12) + len(r.map)] = np.frombuffer(r.map, np.uint8)
    return out


def _spark_hash(values: list[tuple[int | None, int]]) -> int:
    """Spark's xxhash64 of longs and an int (a null leaves the hash as it is)."""
    from xxhash import xxh64_intdigest

    h = 42
    for v, size in values:
        if v is not None:
            h = xxh64_intdigest(v.to_bytes(size, "little", signed=True), h)
    return h


RAW = "h long, c1 long, c2 long, low int, high int, raw binary"
_RAW_KINDS = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]


def _bytes_of(narrow: DataFrame, live: DataFrame, kind: Kind, told: int) -> DataFrame:
    """RAW rows with the bytes of the chosen contexts in live (doc_id, text_key, place), and of some others by chance."""
    names = [x.split()[0] for x in RAW.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(_RAW_KINDS)], names=names)

    n = live.count()
    if n > told:  # a bit set would have no proven bound: the chosen places go to their texts by a shuffle
        places = live.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.collect_set("place").alias("places"))
        one = narrow.dropDuplicates(["doc_id", "text_key"])
        texts = one.join(places, one["doc_id"].eqNullSafe(places["of_id"]) & (one["text_key"] == places["of_key"])).select("text", "places")

        def joined(batches):
            for batch in batches:
                for at, part in T.in_parts(batch.column(0).to_pylist(), 4 << 20):
                    wanted = [set(x) for x in batch.column(1).slice(at, len(part)).to_pylist()]
                    rows = [(h, *_class(low, high, raw), low, high, raw) for i, p, h, low, high, raw in kind.contexts(part) if p in wanted[i]]
                    if rows:
                        yield batch_of(rows)

        return map_batches(texts, joined, RAW)
    bits = max(15, math.ceil(math.log2(16 * max(n, 1))))
    shared = narrow.sparkSession.sparkContext.broadcast((_wanted(live, bits, "doc_id", "text_key", "place"), _wanted(live, bits, "doc_id", "text_key")))
    mask = (1 << bits) - 1

    def chosen(batches):
        from xxhash import xxh64_intdigest

        have, texts_of = shared.value
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            of = [_spark_hash([(x, 8), (y, 8)]) & mask for x, y in zip(ids, keys, strict=True)]
            there = [i for i, bit in enumerate(of) if texts_of[bit >> 3] >> (bit & 7) & 1]
            ids, keys, texts = ([x[i] for i in there] for x in (ids, keys, texts))
            for at, part in T.in_parts(texts, 4 << 20):
                rows, before = [], None
                for i, p, h, low, high, raw in kind.contexts(part):
                    if before is None or before[0] != i:
                        before = (i, _spark_hash([(ids[at + i], 8), (keys[at + i], 8)]))
                    bit = xxh64_intdigest(p.to_bytes(4, "little"), before[1]) & mask
                    if have[bit >> 3] >> (bit & 7) & 1:
                        rows.append((h, *_class(low, high, raw), low, high, raw))
                if rows:
                    yield batch_of(rows)

    return map_batches(narrow, chosen, RAW)


OFFSETS = "h long, c1 long, c2 long, least int, most int"


def _offset_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate([pa.int64()] * 3 + [pa.int32()] * 2)], names=[x.split()[0] for x in OFFSETS.split(", ")])


def _sorted_offsets(counts: DataFrame, held: DataFrame, tasks: int, kind: Kind) -> DataFrame:
    """OFFSETS of the anchor values that are not crowded: their classes meet in one task and are sorted."""
    none = F.lit(None).cast("long")
    held = held.select("h", "c1", "c2", "low", "high", none.alias("x"), none.alias("y"), "raw")
    rows = counts.select("h", "c1", "c2", "low", "high", "x", "y", F.lit(None).cast("binary").alias("raw")).unionByName(held)
    dealt = rows.repartition(tasks, "h").sortWithinPartitions("h", "c1", "c2", F.col("raw").isNotNull())

    def sorted_out(batches):
        group: list[list] = []  # classes: [h, c1, c2, first, last, low, high, bytes]
        strings = 0

        def out():
            missing = [x for x in group if x[7] is None]
            if missing:
                raise RuntimeError(f"no bytes came for {len(missing)} classes, the first of anchor {missing[0][0]}")
            runs = repeating_offsets([(x[0], *x[3:]) for x in group], kind)
            return _offset_batch([(*group[i][:3], a, b) for i, a, b in runs])

        for batch in batches:
            for h, c1, c2, low, high, x, y, raw in zip(*(batch.column(j).to_pylist() for j in range(8)), strict=True):
                if raw is None:
                    if strings > STRINGS and group[-1][0] != h:
                        yield out()
                        group, strings = [], 0
                    group.append([h, c1, c2, x, y, low, high, None])
                    strings += high - low + 1
                elif group and group[-1][7] is None and group[-1][:3] == [h, c1, c2]:
                    group[-1][7] = raw
        if group:
            yield out()

    return map_batches(dealt, sorted_out, OFFSETS)


PIECES = "h long, c1 long, c2 long, least int, most int, x long, y long, raw binary, block int, k1 long, k2 long, w1 long, w2 long"
_PIECE_KINDS = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary(), pa.int32()] + [pa.int64()] * 4


def _pieces(rows: DataFrame, size: int, kind: Kind) -> DataFrame:
    """PIECES of contexts (h, c1, c2, least, most, x, y, raw): a piece for each block of `size` offsets.

    k: the bytes that all strings of the block have in common; w: all bytes of the piece.
    """

    def cut(batches):
        from xxhash import xxh3_128_digest

        unit, length = kind.unit, kind.length
        for batch in batches:
            out = []
            for h, c1, c2, low, high, x, y, raw in zip(*(batch.column(j).to_pylist() for j in range(8)), strict=True):
                for block in range(low // size, high // size + 1):
                    first, last = block * size, block * size + size - 1
                    a, z = max(low, first), min(high, last)
                    piece, core = raw[(high - z) * unit : (high - a + length) * unit], raw[(high - first) * unit : (high - last + length) * unit]
                    out.append((h, c1, c2, a, z, x, y, piece, block, *_two(xxh3_128_digest(core)), *_two(xxh3_128_digest(piece))))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(_PIECE_KINDS)], names=[x.split()[0] for x in PIECES.split(", ")])

    return map_batches(rows, cut, PIECES)


def _crowded_offsets(counts: DataFrame, held: DataFrame, kind: Kind) -> DataFrame:
    """OFFSETS of crowded anchor values, by 128-bit hashes and groupings that are summed in the task before the shuffle.

    Contexts are cut into pieces of a few offsets. A piece whose common bytes no other class has holds no string that repeats,
    and goes. A piece that other holders have just so repeats as a whole; one of them stays to be found by others. What
    is left is cut into smaller pieces, down to single offsets. So only pieces that hold both kinds of strings are cut, a
    few for each end of a passage, and no group of them ever meets in one task.
    """
    size = 1
    while size * 8 <= kind.length:
        size *= 2
    own, out = F.struct("c1", "c2"), None
    rows = held.join(counts.select("h", "c1", "c2", "x", "y"), ["h", "c1", "c2"]).select("h", "c1", "c2", F.col("low").alias("least"), F.col("high").alias("most"), "x", "y", "raw")
    while True:
        pieces = _scratch.materialise(_pieces(rows, size, kind), "pieces")
        same = pieces.groupBy("h", "least", "most", "w1", "w2").agg(F.min(own).alias("first"), F.min("x").alias("gx"), F.max("y").alias("gy")).where("gx <> gy")
        same = _scratch.materialise(same, "same")
        found = pieces.join(same, ["h", "least", "most", "w1", "w2"]).select("h", "c1", "c2", "least", "most")
        out = found if out is None else out.unionByName(found)
        if size == 1:
            break
        shared = pieces.groupBy("h", "block", "k1", "k2").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").drop("x", "y")
        shared = _scratch.materialise(shared, "shared")
        # Of pieces that are the same one stands for all, with their least and largest holder.
        rows = pieces.join(shared, ["h", "block", "k1", "k2"]).join(same, ["h", "least", "most", "w1", "w2"], "left").where(F.col("first").isNull() | (own == F.col("first"))).select("h", "c1", "c2", "least", "most", F.coalesce("gx", "x").alias("x"), F.coalesce("gy", "y").alias("y"), "raw")
        size = max(1, size // 4)
    return out


def _spans(narrow: DataFrame, kind: Kind, told: int, crowd: int) -> DataFrame:
    """(of_id, of_key, spans): the units, [start, end), that strings which repeat cover; a row for each text that has any."""
    spark, since = narrow.sparkSession, _scratch.held()
    anchors = _scratch.materialise(_anchor_rows(narrow, kind), "anchors")
    # The holders of a class: documents, or where one document is enough, places.
    holder = F.xxhash64("doc_id", "text_key") if kind.words else F.xxhash64("doc_id", "text_key", "place")
    several_places = F.lit(False) if kind.words else F.max("n") > 1
    x, y = F.min(holder), F.max(holder)
    classes = anchors.groupBy("h", "c1", "c2").agg(x.alias("x"), F.when(several_places & (x == y), y + 1).otherwise(y).alias("y"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("place").alias("place"), F.count("*").alias("rows"))
    if not kind.words:  # rows of one id and text are documents of their own, at the same places
        classes = classes.withColumn("y", F.when((F.col("rows") > 1) & (F.col("x") == F.col("y")), F.col("y") + 1).otherwise(F.col("y")))
    classes = _scratch.materialise(classes, "all-classes")
    by_anchor = classes.groupBy("h").agg(F.min("x").alias("first"), F.max("y").alias("last"), F.count("*").alias("kinds")).where("first <> last").select("h", "kinds")
    by_anchor = _scratch.materialise(by_anchor, "shared-anchors")  # so that the join reads two plain shuffles and a crowded anchor can be split
    live = _scratch.settle(classes.join(by_anchor, "h"), "classes", since, keep=(anchors,))
    # A class that has two holders repeats as a whole, and needs a sort only so that others can be found equal to it.
    whole = live.where("x <> y").select("h", "c1", "c2", F.col("low").alias("least"), F.col("high").alias("most"))
    several = live.where("kinds > 1")
    held = _bytes_of(narrow, several, kind, told)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(several.count() * 2 * kind.length * kind.unit / (64 << 20)))
    many = several.where(F.col("kinds") > crowd)
    if many.head(1):
        held = _scratch.materialise(held, "bytes")
        few = _sorted_offsets(several.where(F.col("kinds") <= crowd), held.join(many.select("h").distinct(), "h", "left_anti"), tasks, kind)
        offsets = few.unionByName(_crowded_offsets(many, held, kind))
    else:
        offsets = _sorted_offsets(several, held, tasks, kind)
    partly = offsets.join(whole.select("h", "c1", "c2"), ["h", "c1", "c2"], "left_anti")
    offsets = _scratch.settle(partly.unionByName(whole), "offsets", since, keep=(anchors,))
    hits = anchors.select("h", "c1", "c2", "n", "step", "doc_id", "text_key", "place").join(offsets, ["h", "c1", "c2"])
    spans = hits.select("doc_id", "text_key", (F.col("place") - F.col("most")).cast("long").alias("start"), (F.col("place") + (F.col("n") - 1) * F.col("step") - F.col("least") + kind.length).cast("long").alias("end"))
    spans = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return _scratch.settle(spans, "spans", since)


def _runs_of(spans: list | None) -> list:
    return merge(np.array([(x["start"], x["end"]) for x in spans], np.int64)).tolist() if spans else []


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int = 0, filter_bits: int | None = None, crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes, [start, end)).

    Null counts as empty; texts shorter than `length` lose nothing; equal rows are documents of their own, so each
    repeats the other; null ids are kept apart by their texts; an empty table gives no rows; other columns are not read.
    words: also n_repeated_words, how many words (parted by ASCII white space, compared as they are) lie in a passage of
    at least so many words that another document has too; rows of one id and text are one document there. It removes nothing.
    filter_bits: contexts are told to every task up to 2^filter_bits / 16 of them (default TOLD), beyond that by a join;
    crowd: classes of one anchor value that one task sorts. Neither changes a result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    told = TOLD if filter_bits is None else 1 << filter_bits >> 4
    spans = _spans(narrow, Kind(length, gram), told, crowd)
    if words:
        more = _spans(narrow, Kind(words, min(8, words), words=True), told, crowd).withColumnRenamed("spans", "passages")
        more = more.select(F.col("of_id").alias("id2"), F.col("of_key").alias("key2"), "passages")
        both = spans.join(more, F.col("of_id").eqNullSafe(F.col("id2")) & (F.col("of_key") == F.col("key2")), "full")
        spans = both.select(F.when(F.col("of_key").isNotNull(), F.col("of_id")).otherwise(F.col("id2")).alias("of_id"), F.coalesce("of_key", "key2").alias("of_key"), "spans", "passages")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("array<struct<start: bigint, end: bigint>>"))
    joined = narrow.join(spans, narrow["doc_id"].eqNullSafe(spans["of_id"]) & (narrow["text_key"] == spans["of_key"]), "left").select("doc_id", "text", "spans", "passages")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["n_repeated_words"] * bool(words)]

    def removed(batches):
        for batch in batches:
            texts, spans, passages = (batch.column(j).to_pylist() for j in (1, 2, 3))
            rows = []
            for t, s, q in zip(texts, spans, passages, strict=True):
                raw = t.encode()
                runs = _runs_of(s)
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), runs, sum(b - a for a, b in _runs_of(q))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.int64()][: len(names) - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], names=names)

    return map_batches(joined, removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", n_repeated_words long" * bool(words))
