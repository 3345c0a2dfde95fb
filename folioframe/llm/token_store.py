"""Token ids as binary shards: one concatenated id array and Elias-Fano coded document boundaries.

A shard file holds, in this order: the magic, the ids (2 bytes each where the vocabulary allows it, else 4), two
Elias-Fano sequences (low bits, high bits, select samples), and a footer of fixed size. The first are the boundaries:
boundary i is the number of ids before document i; with n documents and u ids it takes about 2 + log2(u / n) bits. The second
are the document ids, which rise within a file, less the first one; rows without an id come before them and are only
counted. Every 64th entry's place in the high bits is sampled, so select() scans a few words, and some() decodes a stretch;
no table of 64-bit offsets is made for a file.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _scratch
from . import tokenizing as T
from ._workers import map_batches

MAGIC = b"FOLIOEF1"
FOOTER = struct.Struct("<QQQQqQQBBBxxxxx8s")  # shard, documents, without an id, ids, first id, both high bits in bytes, id size, both low bits, magic
SAMPLE = 64
SUFFIX = ".ffef"
#: A shard is closed at so many ids, so that a file stays well under the 2 GB a reader can hold.
SHARD_IDS = 32 << 20
#: Bytes of text that a task encodes.
TASK_BYTES = 128 << 20
#: Documents that are decoded at a time.
DECODED = 4096
#: At most so many files' rows are sent to every task (40 bytes each); more are joined by a shuffle.
SENT = 1 << 20


class EliasFano:
    """A rising sequence of integers, the first 0: low bits packed as they are, high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.empty((n, width), np.uint8)
        for j in range(width):
            bits[:, j] = (values >> np.uint64(j)) & np.uint64(1)
        low = np.packbits(bits.ravel(), bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i alone, from the nearest sample on."""
        at, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = at // 8, 0
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")) + byte * 8
            ones = ones[ones >= at]
            if seen + len(ones) > need:
                place = int(ones[need - seen])
                break
            seen, byte = seen + len(ones), byte + 64
            at = byte * 8
        value = (place - i) << self.width
        for j in range(self.width):
            bit = i * self.width + j
            value |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << j
        return value

    def some(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1, from the sample before the first one on; what is held goes with their number."""
        if first >= last:
            return np.empty(0, np.uint64)
        anchor = first // SAMPLE * SAMPLE
        at = int(self.samples[anchor // SAMPLE])
        end = int(self.samples[-(-last // SAMPLE)]) if -(-last // SAMPLE) < len(self.samples) else len(self.high) * 8 - 1
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8 : end // 8 + 1], bitorder="little")) + at // 8 * 8
        ones = ones[ones >= at][first - anchor : last - anchor]
        value = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bit = first * self.width
            raw = np.unpackbits(self.low[bit // 8 : (last * self.width + 7) // 8], bitorder="little")[bit % 8 :][: (last - first) * self.width]
            for j in range(self.width):
                value |= raw[j :: self.width].astype(np.uint64) << np.uint64(j)
        return value

    def all(self) -> np.ndarray:
        return self.some(0, self.n).astype(np.int64)


class ShardWriter:
    """Streams documents to a file object; holds 16 bytes a document besides."""

    def __init__(self, out, shard: int, id_size: int):
        self.out, self.shard, self.id_size = out, shard, id_size
        self.ends, self.docs, self.total = [0], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        self.out.write(np.frombuffer(ids, "<u4").astype(f"<u{self.id_size}").tobytes())
        self.total += len(ids) // 4
        self.ends.append(self.total)
        self.docs.append(doc_id)

    def close(self) -> None:
        """Ids have to rise, after the rows without one."""
        known = [x for x in self.docs if x is not None]
        nulls, base = len(self.docs) - len(known), known[0] if known else 0
        if any(x is not None for x in self.docs[:nulls]) or any(a > b for a, b in zip(known, known[1:], strict=False)):
            raise ValueError("documents have to come in the order of their ids, null first")
        both = EliasFano.of(np.array(self.ends, np.uint64)), EliasFano.of(np.array([x - base for x in known], np.uint64))
        for ef in both:
            for part in (ef.low, ef.high, ef.samples):
                self.out.write(part.tobytes())
        self.out.write(FOOTER.pack(self.shard, len(self.docs), nulls, self.total, base, *(len(ef.high) for ef in both), self.id_size, *(ef.width for ef in both), MAGIC))


class Shard:
    """A shard file's contents, read without copying."""

    def __init__(self, content):
        view = memoryview(content)
        self.shard, n, self.nulls, total, self.base, *high, size, width, id_width, magic = FOOTER.unpack(view[-FOOTER.size :])
        if magic != MAGIC or bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.total = n, total
        at = len(MAGIC)

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(view, kind, count, at)
            at += got.nbytes
            return got

        self.ids = take(total, f"<u{size}")

        def sequence(count: int, bits: int, high_bytes: int) -> EliasFano:
            low, unary = take((count * bits + 7) // 8, "u1"), take(high_bytes, "u1")
            return EliasFano(count, bits, low, unary, take(-(-count // SAMPLE), "<u4"))

        self.bounds = sequence(n + 1, width, high[0])
        self.known = sequence(n - self.nulls, id_width, high[1])

    @property
    def null(self) -> np.ndarray:
        return np.arange(self.n) < self.nulls

    @property
    def docs(self) -> np.ndarray:
        return self.doc_ids(0, self.n).fill_null(0).to_numpy()

    def doc_ids(self, first: int, last: int) -> pa.Array:
        """Ids of documents first to last - 1."""
        none = max(0, min(last, self.nulls) - first)
        ids = self.known.some(max(0, first - self.nulls), max(0, last - self.nulls))
        return pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array((ids + np.array(self.base, np.int64).view(np.uint64)).view(np.int64), pa.int64())])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, write shards in ascending doc_id order; returns their manifest.

    A range shuffle by doc_id deals the texts; ties and rows with no id are told apart by their text, so no id can fill a
    task. A task streams its rows to a file of its own name that is moved into place once complete, so one that runs again
    writes the same. Null ids come first. The manifest has one row a file: part, seq, n_docs, n_ids, first_id (ids in all
    files before it); its length is bounded by the number of tasks, not by the documents.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spec = T.read_tokenizer(tokenizer)
    key = hashlib.sha256(spec.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(spec)
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    dealt = narrow.repartitionByRange(tasks, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def written(batches):
        from pyarrow import fs as pafs

        enc = T.encoder(shared.value, key)
        size = 2 if enc.library.get_vocab_size() <= 65_536 and (end_id or 0) < 65_536 else 4
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, seq, writer, made = TaskContext.get().partitionId(), 0, None, []

        def closed():
            writer.close()
            writer.out.close()
            final = f"{root}/{part:06d}-{seq:06d}{SUFFIX}"
            try:
                fs.move(temp, final)
            except OSError:  # where a move can't replace: an earlier attempt's file is the same
                if fs.get_file_info(final).type != pafs.FileType.File:
                    raise
                fs.delete_file(temp)
            made.append((part, seq, len(writer.docs), writer.total))

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in T.in_parts(texts):
                for doc_id, ids in zip(doc_ids[at : at + len(some)], enc.encode(some), strict=True):
                    if writer is None:
                        temp = f"{root}/.{uuid.uuid4().hex}"
                        writer = ShardWriter(io.BufferedWriter(fs.open_output_stream(temp), 1 << 20), (part << 20) + seq, size)
                    writer.add(doc_id, ids + end)
                    if writer.total >= SHARD_IDS:
                        closed()
                        writer, seq = None, seq + 1
        if writer is not None:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.int64()) for i in range(4)], names=["part", "seq", "n_docs", "n_ids"])

    made = sorted(tuple(r) for r in map_batches(dealt, written, "part long, seq long, n_docs long, n_ids long").collect())
    rows, first = [], 0
    for part, seq, n_docs, n_ids in made:
        rows.append((part, seq, n_docs, n_ids, first))
        first += n_ids
    return spark.createDataFrame(rows, "part long, seq long, n_docs long, n_ids long, first_id long")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = Shard(batch.column(0)[i].as_buffer())
                for at in range(0, x.n, DECODED):
                    end = min(x.n, at + DECODED)
                    bounds = x.bounds.some(at, end + 1).astype(np.int64)
                    crc = [zlib.crc32(x.ids[a:b].astype("<u4")) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(end - at, x.shard >> 20)), pa.array(np.full(end - at, x.shard & 0xFFFFF)), x.doc_ids(at, end), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        schema=pa.schema([(c, pa.int64()) for c in ("part", "seq", "doc_id", "at", "n_tokens", "ids_crc32")]),
                    )

    rows = map_batches(files, read, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    first = manifest.select("part", "seq", "first_id")  # a row a file
    first = F.broadcast(first) if manifest.limit(SENT + 1).count() <= SENT else first
    return rows.join(first, ["part", "seq"]).select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame, tokenizer: str, *, folder: str | None = None, **how) -> DataFrame:
    """Write the shards (to a scratch folder if none is given) and read them back."""
    folder = folder or _scratch.new_path(docs.sparkSession, "token-shards")
    return read_shards(docs.sparkSession, folder, write_shards(docs, tokenizer, folder, **how))
