"""Repeated byte strings, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioframe.llm import queries, repeats


def _brute(pairs, length):
    raws = [(t or "").encode() for _, t in pairs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(pairs, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        n_spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        out.append((d, len(r), sum(gone), n_spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _got(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    got = _got(queries.op8_repeats(spark, sf_dir))
    expect = _brute(list(zip(table.doc_id, table.text, strict=True)), 400)
    assert got == expect
    assert any(x[2] for x in expect)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "STRINGS", 64)
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("abé"), int(n))) for n in rng.integers(0, 400, 40)]
    for _ in range(25):
        a, b = texts[int(rng.integers(40))], texts[int(rng.integers(40))]
        i, n = int(rng.integers(0, len(a) + 1)), int(rng.integers(10, 60))
        texts.append(b[: int(rng.integers(0, 50))] + a[i : i + n] + b[-int(rng.integers(1, 50)) :])
    texts += [None, "", "short", "xyz" * 300, "a" * 500, "xyz" * 40 + "!", texts[3], texts[3]]
    pairs = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, None)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in pairs], "doc_id long, text string, n_spans string")
    assert _got(repeats.repeats(docs, length=24, gram=8)) == _brute(pairs, 24)


def test_long_texts_in_segments(spark, monkeypatch):
    rng = np.random.default_rng(1)
    body = "".join(rng.choice(list("abcdefgh"), 5000))
    texts = [body + body[100:900], body[2000:2600] + "zz", "".join(rng.choice(list("abcdefgh"), 3000))]
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    parts = sorted((i, p, lo, hi, raw) for i, p, h, lo, hi, raw in repeats.contexts([t.encode() for t in texts], 100, 8))
    starts = [Counter(s for i, p, lo, hi, _ in parts if i == j for s in range(p - hi, p - lo + 1)) for j in range(3)]
    assert all(sorted(c) == list(range(len(t) - 99)) and set(c.values()) == {1} for c, t in zip(starts, texts, strict=True))
    assert all(texts[i].encode()[p - hi : p - lo + 100] == raw for i, p, lo, hi, raw in parts)


@pytest.mark.parametrize("length", [8, 20, 33, 100])
def test_deep_shallow_sort(length):
    rng = np.random.default_rng(length)
    pool = [bytes(rng.integers(97, 99, length, dtype=np.uint8)) for _ in range(30)]
    pool += [pool[0][: length - k] + b"z" * k for k in (1, 2, 5, 8)] + [b"a" * length, b"a" * (length - 1) + b"b"]
    strings = [pool[int(i)] for i in rng.integers(0, len(pool), 400)]
    label = repeats.equal_groups(np.frombuffer(b"".join(strings) + bytes(8), np.uint8), np.arange(400) * length, length)
    assert [strings[i] for i in label] == strings
    assert len(set(label.tolist())) == len(set(strings))


def test_crowded_filter_and_empty(spark):
    rng = np.random.default_rng(9)
    body = "".join(rng.choice(list("abcdefgh"), 900))
    pairs = [(1, body), (2, "q" + body[:500]), (3, body[::-1]), (4, body[300:] + "r")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert _got(repeats.repeats(docs, length=50, gram=8, filter_bits=15)) == _brute(pairs, 50)
    assert repeats.repeats(docs.where("false"), length=50, gram=8).collect() == []


def test_all_ways_to_the_same_result(spark, monkeypatch):
    """Crowded anchor values by hashes, chosen contexts by a join, small portions to sort: the spans stay what they are."""
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    passage = text(90)
    texts = [text(int(rng.integers(0, 120))) + passage[int(rng.integers(0, 20)) :] + text(int(rng.integers(0, 120))) for _ in range(60)]
    texts += [texts[0], texts[3], passage * 3, None, "", texts[7][5:]]
    pairs = list(enumerate(texts)) + [(2, texts[2]), (None, texts[4])]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    expect = _brute(pairs, 40)
    assert any(0 < x[2] < x[1] for x in expect)
    for crowd, bits in ((1024, None), (3, None), (1024, 4), (3, 4)):
        assert _got(repeats.repeats(docs, length=40, gram=8, crowd=crowd, filter_bits=bits)) == expect
    monkeypatch.setattr(repeats, "STRINGS", 50)
    assert _got(repeats.repeats(docs, length=40, gram=8)) == expect


def test_bytes_that_do_not_come_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" + "abcdefgh" * 9), (2, "y" + "abcdefgh" * 9 + "z")], "doc_id long, text string")
    monkeypatch.setattr(repeats, "_bytes_of", lambda narrow, *_: narrow.selectExpr("0L h", "0L c1", "0L c2", "0 low", "0 high", "cast(null as binary) raw").where("false"))
    with pytest.raises(Exception, match="no bytes came"):
        repeats.repeats(docs, length=40, gram=8).collect()


def _passages(pairs, words):
    """Words in a run of `words` that another document has; rows of one id and text are one document."""
    split = [re.findall(r"[^ \t-\r]+", t or "") for _, t in pairs]
    holders = defaultdict(set)
    for (d, t), w in zip(pairs, split, strict=True):
        for i in range(len(w) - words + 1):
            holders[tuple(w[i : i + words])].add((d, t))
    out = []
    for (d, _), w in zip(pairs, split, strict=True):
        out.append((d, len({j for i in range(len(w) - words + 1) if len(holders[tuple(w[i : i + words])]) > 1 for j in range(i, i + words)})))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1024, 2])
def test_passages_that_other_documents_have(spark, crowd):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(rng.choice(["a", "bb", "É", "d.", "the", "Of"], int(n)))
    passage = say(40).split()
    pairs = [(i, say(rng.integers(0, 40)) + "\n" + "\t ".join(passage[int(rng.integers(0, 15)) : int(rng.integers(18, 40))]) + " " + say(rng.integers(0, 30))) for i in range(60)]
    pairs += [(100, " ".join(passage * 3)), (101, "only here " * 30), (102, None), (103, "\x0b\x0c "), (104, pairs[5][1]), (5, pairs[5][1]), (None, pairs[9][1])]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = repeats.repeats(docs, length=60, gram=8, words=12, crowd=crowd)
    expect = _passages(pairs, 12)
    assert sorted(((r.doc_id, r.n_repeated_words) for r in got.collect()), key=str) == expect
    assert len({n for _, n in expect}) > 5 and dict(expect)[101] == 0
    assert _got(got) == _brute(pairs, 60)
