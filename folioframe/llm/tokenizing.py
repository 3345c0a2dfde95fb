"""Exact token ids and counts of whole texts through per-worker caches of white-space chunks.

A library tokenizer is slow on words that it has not met lately. Where its pre-tokenizer never lets a token span the
start of a white-space run, a text's ids are its chunks' ids one after the other, so a chunk is encoded by the library
once a worker and looked up afterwards. Texts for which that can't be shown (special strings inside, unusual white
space, characters that compose) go through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np

#: About so many chunks stay in a worker's cache (some 200 bytes each); when it is full, the latest third goes.
CACHE_ENTRIES = 400_000
#: Characters of plain text that are hashed at a time (some 60 bytes of arrays each).
PART = 1 << 20
#: Chunks longer than this are not kept.
LONG_CHUNK = 64

_COMPOSING = re.compile("[\u0300-\U0010ffff]")
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_GPT_CHUNKS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+").findall

# Chunks of printable ASCII and Latin-1 letters, and their pre-tokens by the tokenizers' own patterns; for these characters
# letter, digit and white space are what the patterns say, and normalisation is str.lower().
_PLAIN = re.compile(r"[\n\t\r -~À-ÖØ-öø-ÿ]*")
_PRE_TOKENS = {
    "words": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall,
    "spaced": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+").findall,
}


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: visible Latin-1 characters stand for themselves, the others for 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()

# Byte classes of plain text in lower case: white space, letters (bytes from 0x80 on are parts of Latin-1 letters there),
# digits, and the rest.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(b" \t\n\r")] = 0
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2
_RANDOM = np.random.default_rng(7).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


class WordTable:
    """Ids of pre-tokens by two 64-bit hashes of their bytes, in sorted arrays; looked up a batch at a time."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.filled = np.empty(1 << 16, np.uint32), 0

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of known pre-tokens, -1 for others."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def add(self, first: np.ndarray, second: np.ndarray, ids: list) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        total = int(size.sum())
        while self.filled + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.ids[self.filled : self.filled + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        begin = np.cumsum(size) - size + self.filled
        self.filled += total
        order = np.argsort(np.concatenate([self.first, first]), kind="stable")
        for name, new in (("first", first), ("second", second), ("begin", begin), ("size", size)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])


def _segments(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the pre-tokens of plain text without apostrophes begin, how long they are, and both hashes."""
    a = np.frombuffer(raw, np.uint8)
    kind = _CLASS[a]
    change = np.empty(len(a), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= kind == 2
    at = np.flatnonzero(change)
    size = np.diff(at, append=len(a))
    place = np.arange(len(a)) - np.repeat(at, size)
    word = kind[at] != 0
    hashes = []
    for random, base in zip(_RANDOM, _BASE, strict=True):
        power = np.cumprod(np.full(int(size.max()), base))
        h = np.add.reduceat(random[a] * power[place], at)[word]
        h = (h ^ (h >> np.uint64(31))) * base
        hashes.append(h ^ (h >> np.uint64(29)))
    return at[word], size[word], *hashes


_encoders: dict[tuple, ChunkEncoder] = {}


def read_tokenizer(path: str) -> str:
    """A tokenizer file's text; only the driver needs the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _kind(spec: dict) -> str:
    """words: white space is dropped; spaced: byte-level, a space may lead a token; whole: nothing is known."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex"):
        return "spaced"
    parts = pre.get("pretokenizers") or [{}]
    steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in (norm or {}).get("normalizers", [])]
    if (
        steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
        and parts[0].get("type") == "Split"
        and parts[0].get("invert")
        and parts[0].get("behavior") == "Removed"
        and (parts[0].get("pattern") or {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ):
        return "words"
    return "whole"


class ChunkEncoder:
    """Ids (as little-endian unsigned 32-bit bytes) or counts of texts, equal to the library's on the whole text."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.kind = _kind(parsed)
        self.special = [x["content"] for x in parsed.get("added_tokens", [])]
        self.model = self.library.model
        self.ids: dict = {}
        self.counts: dict = {}
        self.pieces: dict = {}
        self.table = WordTable()

    def chunks(self, text: str) -> list | None:
        """None: the text has to go through the library whole."""
        if self.kind == "whole" or any(x in text for x in self.special):
            return None
        if self.kind == "words":
            # Lower case first only where no character can compose, so that it can't change what composes.
            raw = text.encode()
            return (raw if _COMPOSING.search(text) else raw.lower()).split()
        return None if _ODD_SPACE.search(text) else _GPT_CHUNKS(text)

    def _missing(self, chunks: list):
        """(chunk, ids) of chunks that no cache has; the library's model alone encodes plain ones' pre-tokens."""
        rest = []
        for chunk in chunks:
            text = chunk.decode() if isinstance(chunk, bytes) else chunk
            if _PLAIN.fullmatch(text):
                found = _PRE_TOKENS[self.kind](text.lower() if self.kind == "words" else text)
                yield chunk, [i for p in found for i in self._piece(p)]
            else:
                rest.append((chunk, text))
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            for (chunk, _), enc in zip(part, self.library.encode_batch_fast([x for _, x in part], add_special_tokens=False), strict=True):
                yield chunk, enc.ids

    def _piece(self, piece: str) -> array:
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece.encode().decode("latin-1").translate(_LETTERS)
            ids = array("I", [t.id for t in self.model.tokenize(text)])
            if len(piece) <= LONG_CHUNK:
                _trim(self.pieces)
                self.pieces[piece] = ids
        return ids

    def _each(self, texts: list, cache: dict, made, joined) -> list:
        split = [self.chunks(x) for x in texts]
        _trim(cache)
        met: set = set()
        for x in split:
            if x is not None:
                met.update(x)
        missing = [c for c in met if c not in cache]
        for chunk, ids in self._missing(missing):
            cache[chunk] = made(ids)
        out = [joined(map(cache.__getitem__, x)) if x is not None else made(self.library.encode(text, add_special_tokens=False).ids) for text, x in zip(texts, split, strict=True)]
        for chunk in missing:
            if len(chunk) > LONG_CHUNK:
                del cache[chunk]
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [x or "" for x in texts]
        made = lambda ids: array("I", ids).tobytes()
        simple = [self.kind == "words" and "'" not in x and _PLAIN.fullmatch(x) is not None and not any(t in x for t in self.special) for x in texts]
        out: list[bytes] = [b""] * len(texts)
        rest = [i for i, x in enumerate(simple) if not x]
        for i, ids in zip(rest, self._each([texts[i] for i in rest], self.ids, made, b"".join), strict=True):
            out[i] = ids
        easy = [i for i, x in enumerate(simple) if x]
        for at, part in in_parts([texts[i] for i in easy], PART):
            for i, ids in zip(easy[at : at + len(part)], self._words(part), strict=True):
                out[i] = ids
        return out

    def _words(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts by arrays: hash all pre-tokens, encode those not met before, gather."""
        raws = [x.encode().lower() for x in texts]
        raw = b" ".join(raws)
        if not raw:
            return [b""] * len(texts)
        edges = np.cumsum([0] + [len(x) + 1 for x in raws])
        start, size, first, second = _segments(raw)
        values, where, back = np.unique(first, return_index=True, return_inverse=True)
        if not (second == second[where][back]).all():  # two pre-tokens share a hash
            return self._each(texts, self.ids, lambda ids: array("I", ids).tobytes(), b"".join)
        if len(self.table.first) > 4 * CACHE_ENTRIES:
            self.table.clear()
        other = second[where]
        at = self.table.find(values, other)
        if (new := np.flatnonzero(at < 0)).size:
            ids = [self._ids(raw[a : a + n].decode().lower()) for a, n in zip(start[where[new]].tolist(), size[where[new]].tolist(), strict=True)]
            self.table.add(values[new], other[new], ids)
            at = self.table.find(values, other)
            if (at < 0).any():  # a hash that the table has for another pre-token
                self.table.clear()
                return self._each(texts, self.ids, lambda ids: array("I", ids).tobytes(), b"".join)
        at = at[back]
        n = self.table.size[at]
        ends = np.cumsum(n)
        flat = self.table.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.table.begin[at] - ends + n, n)]
        cuts = np.concatenate([[0], ends])[np.searchsorted(start, edges)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ids(self, piece: str) -> list[int]:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.model.tokenize(text)]

    def know(self, keys: list, lengths: bytes) -> None:
        """Put frequent chunks' lengths first in the worker's cache, so that they stay in it."""
        if not self.counts:
            self.counts.update(zip(keys, np.frombuffer(lengths, "<u2").tolist(), strict=True))

    def count(self, texts: Iterable[str | None]) -> list[int]:
        return self._each([x or "" for x in texts], self.counts, len, sum)

    def frequent(self, texts: Iterable[str | None], most: int) -> tuple[list, bytes]:
        """The most frequent chunks of texts, and each one's token count in two bytes."""
        seen: Counter = Counter()
        for text in texts:
            seen.update(c for c in self.chunks(text or "") or () if len(c) <= LONG_CHUNK)
        keys = sorted(sorted(seen), key=lambda c: -seen[c])[:most]
        lengths = {c: len(ids) for c, ids in self._missing(keys)}
        return keys, np.array([lengths[c] for c in keys], dtype="<u2").tobytes()


def _trim(cache: dict) -> None:
    """The oldest entries, which tend to be the most frequent, stay."""
    if len(cache) > CACHE_ENTRIES:
        for _ in range(len(cache) - CACHE_ENTRIES * 2 // 3):
            cache.popitem()


def encoder(spec: str, key: str | None = None) -> ChunkEncoder:
    """This process's encoder for a tokenizer; workers are reused, so its caches outlive a task."""
    key = key or hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(spec)
    return _encoders[key]


def in_parts(values: list, most: int = 16 << 20) -> Iterable[tuple[int, list]]:
    """Slices of a list of texts with a bounded sum of lengths each, and where each begins."""
    at = size = 0
    for i, x in enumerate(values):
        size += len(x or "")
        if size >= most:
            yield at, values[at : i + 1]
            at, size = i + 1, 0
    if at < len(values):
        yield at, values[at:]
