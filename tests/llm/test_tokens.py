"""Token counts, the token store and packing, against the library on whole texts."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from folioframe.llm import packing, queries, token_count, token_store, tokenizing  # noqa: E402

ODD = [
    None,
    "",
    "   ",
    "a",
    "two  spaces\n\n and\tTabs \r\n end ",
    "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>",
    "don't I'll WE'VE it's",
    "naïve café Ünïcödé Straße İstanbul ǰ J̌ K ﬁ ½",
    "café J̌ Å",
    "nbsp\xa0here there\x0bvt\x1cfs\x85nel",
    "日本語テキスト 한국어 🙂🙂 emoji",
    "word " * 30_000,
    "z" * 5_000,
    "!!! ??? ... ,;: 123 4567 a1b2",
    "ÀÉÎõü×÷ ÆØÅ æøå ßß ªº µ Ÿ ÿ ¿¡ É's 'S 'll x'lly''t 1'd",
    "".join(map(chr, range(32, 256))) + " " + "".join(map(chr, range(32, 127))) * 3,
    " a  b   c\n d\t\te \n\n  f\r\n",
]


def _docs(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    rows += [(0, texts[0], "again"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_caches_equal_the_library(table, name):
    path = str(P.path(name))
    library, enc = Tokenizer.from_file(path), tokenizing.ChunkEncoder(tokenizing.read_tokenizer(path))
    texts = ODD + table.text.tolist()
    expect = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == expect
    assert enc.count(texts) == [len(x) for x in expect]
    known = tokenizing.ChunkEncoder(tokenizing.read_tokenizer(path))
    known.know(*known.frequent(texts, 50))
    assert known.count(texts) == [len(x) for x in expect]


def test_word_table(table):
    path = str(P.path("word_bpe_49k.json"))
    library, enc = Tokenizer.from_file(path), tokenizing.ChunkEncoder(tokenizing.read_tokenizer(path))
    texts = ["", "A1b22 ..c,D", "É é ÉÉ×÷ü", "tab\tnew\nline\r x", "", *(t for t in table.text.tolist()), "z" * 300]
    expect = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == expect
    assert len(enc.table.first) > 1000


def test_word_table_with_colliding_hashes(monkeypatch, table):
    real = tokenizing._segments

    def weak(raw):
        start, size, first, second = real(raw)
        return start, size, first % np.uint64(50), second

    path = str(P.path("word_bpe_49k.json"))
    library, enc = Tokenizer.from_file(path), tokenizing.ChunkEncoder(tokenizing.read_tokenizer(path))
    monkeypatch.setattr(tokenizing, "_segments", weak)
    for t in ["one", "two three", *table.text.tolist()[:20]]:
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_ENTRIES", 7)
    path = str(P.path("word_bpe_49k.json"))
    library, enc = Tokenizer.from_file(path), tokenizing.ChunkEncoder(tokenizing.read_tokenizer(path))
    texts = [" ".join(f"w{i % 11}x{j}" for i in range(30)) for j in range(5)]
    assert enc.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert enc.count(texts[::-1]) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts[::-1]]


def test_counts_query(spark, sf_dir, table):
    library = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op10_token_counts(spark, sf_dir).collect()}
    expect = {d: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for d, t in zip(table.doc_id, table.text, strict=True)}
    assert got == expect


def test_counts_cases(spark):
    out = token_count.count_tokens(_docs(spark, ODD), str(P.path("byte_bpe_50k.json")))
    rows = out.collect()
    assert len(rows) == len(ODD) + 2 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sum(r.doc_id is None for r in rows) == 1
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id == 0} == {(0, 0)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_count.count_tokens(empty, str(P.path("byte_bpe_50k.json"))).collect() == []


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9, 1_000_000], list(range(0, 100_000, 7)), [0, *([3] * 500), 2**33]])
def test_elias_fano(values):
    ef = token_store.EliasFano.of(np.array(values, np.uint64))
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), max(1, len(values) // 97))] == values[:: max(1, len(values) // 97)]
    assert (ef.low.nbytes + ef.high.nbytes) * 8 <= len(values) * (3 + np.log2(max(2, values[-1] / len(values)))) + 64


def test_store_query(spark, sf_dir, table):
    library = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    got = sorted(tuple(r) for r in queries.op9_token_store(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    expect, at = [], 0
    for d, t in sorted(zip(table.doc_id, table.text, strict=True)):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        expect.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expect


def test_store_cases(spark, tmp_path, monkeypatch):
    path = str(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/shards"
    docs = _docs(spark, ODD)
    manifest = token_store.write_shards(docs, path, folder)
    rows = token_store.read_shards(spark, folder, manifest).collect()
    assert len(rows) == len(ODD) + 2
    assert sum(r.n_tokens for r in rows) == manifest.groupBy().sum("n_ids").first()[0]
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert next(r for r in rows if r.doc_id is None).start == 0
    by_doc = {}
    for name in os.listdir(tmp_path / "shards"):
        if name.endswith(token_store.SUFFIX):
            x = token_store.Shard((tmp_path / "shards" / name).read_bytes())
            by_doc |= {None if x.null[i] else int(x.docs[i]): x.document(i).tolist() for i in range(x.n)}
    assert by_doc[5] == [*library.encode(ODD[5], add_special_tokens=False).ids, 2]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.store_tokens(empty, path).collect() == []


def _check_packing(rows, capacity=4096):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in docs.values():
        at = 0
        for start, length, n in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == n
    waste = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        waste += 0 if at & (at - 1) == 0 else capacity - at
    return waste, total


def test_packing_query(spark, sf_dir, table):
    library = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    rows = queries.op1_packing(spark, sf_dir).collect()
    waste, total = _check_packing(rows)
    assert waste <= 4096 + 0.005 * total
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in zip(table.doc_id, table.text, strict=True)}
    assert {r.doc_id for r in rows} == set(ids)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_packing_cases(spark):
    path = str(P.path("word_bpe_49k.json"))
    docs = _docs(spark, ODD).where("not (doc_id = 0 and n_tokens = 'again')")
    waste, total = _check_packing(packing.pack(docs, path).collect())
    assert waste <= 4096
    again = spark.createDataFrame([(7, "same text here")] * 3000, "doc_id long, text string")
    rows = packing.pack(again, path, capacity=64).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 128, 40))
    demand = rng.integers(1, 5000, len(sizes))
    plan = packing.solve(sizes, demand, 1024)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all((p * sizes).sum() <= 1024 for p, _ in plan)
    assert sum(n for _, n in plan) <= (sizes * demand).sum() / 1024 * 1.001 + len(sizes) / 8 + 2


def test_one_awkward_length():
    plan = packing.solve(np.array([700]), np.array([1000]), 4096)
    assert sum(n for _, n in plan) == 200
