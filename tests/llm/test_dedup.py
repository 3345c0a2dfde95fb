"""Exact and near duplicates, and decontamination, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from folioframe.llm import components, decontaminate, exact_dedup, queries, simhash

LONG = "lorem ipsum dolor " * 40_000


def _rows(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, kept string, n_words string")


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()


def _exact(pairs):
    groups = defaultdict(list)
    for d, t in pairs:
        groups[t or ""].append(d)
    return sorted((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in pairs)


def test_exact_query(spark, sf_dir, table):
    rows = queries.op3_exact_dedup(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, rows)) == _exact(list(zip(table.doc_id, table.text, strict=True)))


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_exact_cases(spark, block):
    texts = [None, "", "a", "a", "ab", "abab", "ababab", "ababab", "é" * 5, "é" * 5, "é" * 4, "abcabcabc", "abcabcabd", "abcabcabc", "x" * 13, "x" * 12, "x" * 13, "x" * 26, "yx" * 13]
    texts += [LONG, LONG + "!", LONG] if block == 4096 else []
    got = exact_dedup.exact_groups(_rows(spark, texts), block=block)
    assert sorted(map(tuple, got.collect())) == _exact(list(enumerate(texts)))


def test_exact_is_native(spark, sf_dir):
    plan = queries.op3_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_exact_ties_and_empty(spark):
    docs = _rows(spark, ["t", "t", "t", "u", "u", None, None], [5, 5, 2, None, None, 1, 1])
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter([(5, 5, 3, True), (5, 5, 3, False), (2, 5, 3, False), (None, None, 2, True), (None, None, 2, False), (1, 1, 2, True), (1, 1, 2, False)])
    left = exact_dedup.drop_exact(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(5, "t"), (None, "u"), (1, None)])
    empty = _rows(spark, ["a"]).where("false")
    assert exact_dedup.exact_groups(empty).collect() == [] and exact_dedup.drop_exact(empty).collect() == []


def test_keys_that_collide_are_made_anew(spark, monkeypatch):
    from pyspark.sql import functions as F

    real, salts = exact_dedup._key, []

    def weak(x, salt):
        salts.append(salt)
        return [F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")] if salt == 0 else real(x, salt)

    monkeypatch.setattr(exact_dedup, "_key", weak)
    texts = ["a", "b", "a", "b", "c"]
    assert sorted(map(tuple, exact_dedup.exact_groups(_rows(spark, texts)).collect())) == _exact(list(enumerate(texts)))
    assert 1 in salts


def _prints(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found)] if len(found) < words else [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def _near(pairs, words, radius):
    prints = np.array([_prints(t, words) for _, t in pairs], np.uint64)
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            root[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{int(prints[i]):016x}", least[find(i)]) for i, (d, _) in enumerate(pairs))


def test_simhash_query(spark, sf_dir, table):
    got = queries.op5_simhash(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == _near(list(zip(table.doc_id, table.text, strict=True)), 3, 2)


def test_simhash_cases(spark):
    texts = [None, "", " \n\t", "One", "one", "one two", "One TWO", "é è ê ë", "É è ê ë", "a\x0bb\x0cc d\x1ce", LONG, LONG + "end", "a b c d e f g", "a b c d e f h"]
    got = simhash.near_groups(_rows(spark, texts)).collect()
    assert sorted(map(tuple, got)) == _near(list(enumerate(texts)), 3, 2)
    ties = simhash.near_groups(_rows(spark, ["same words here now", "same words here now", "alone it stands"], [4, None, None])).collect()
    assert sorted(r.component_id or -1 for r in ties) == [-1, 4, 4]
    empty = _rows(spark, ["a"]).where("false")
    assert simhash.near_groups(empty).collect() == [] and simhash.drop_near(empty).collect() == []
    assert sorted(r.doc_id for r in simhash.drop_near(_rows(spark, ["w x y z u v", "w x y z u v", "q r s t"], [9, 3, 5])).collect()) == [3, 5]


def test_near_copies_with_repeated_and_null_ids(spark):
    a, b, c = "w x y z u v", "q r s t and other words that are not near", "here is a third text of its own with more to say"
    rows = [(2, a), (7, a), (7, b), (3, c), (3, c + " "), (3, c.upper()), (None, a), (None, "only here and only once"), (None, " only here and only once"), (5, "k l m n"), (5, "k l m n")]
    left = sorted(simhash.drop_near(_rows(spark, [t for _, t in rows], [d for d, _ in rows])).collect(), key=str)
    assert Counter(r.doc_id for r in left) == Counter([2, 7, 3, None, 5])
    assert {r.doc_id: r.text for r in left}[7] == b


def test_link_connects_all_within_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = set(map(int, base))
    for b in map(int, base[:20]):
        for _ in range(60):
            for _ in range(int(rng.integers(1, 5))):
                b ^= 1 << int(rng.integers(64))
            values.add(b)
    values = np.array(sorted(values), np.uint64)
    rows = [(int(x),) for x in values.view(np.int64)]
    got = simhash.link(spark.createDataFrame(rows, "fp long")).collect()
    assert all((int(np.uint64(r.a % 2**64)) ^ int(np.uint64(r.b % 2**64))).bit_count() <= 2 for r in got)
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(got, "a long, b long"), "a", "b").collect()}
    expect = _near([(i, None) for i in range(0)], 3, 2)
    assert expect == []
    parent = {x[0]: x[0] for x in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    signed = values.view(np.int64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 2):
            a, b = find(int(signed[i])), find(int(signed[j]))
            parent[max(a, b)] = min(a, b)
    assert all(roots.get(x[0], x[0]) == find(x[0]) for x in rows)


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = np.random.default_rng(0)
    for _ in range(500):
        diff = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(not diff & m for m in masks)


def test_components_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _contaminated(docs, items, window=13):
    grams = defaultdict(set)
    for item, text in items:
        w = _words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for d, text in docs:
        w, hit, which = _words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    which |= grams[g]
        names = ",".join(sorted(str(x) for x in which if x is not None))
        out.append((d, len(w), len(hit), len(which), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination_query(spark, sf_dir, table):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op2_decontamination(spark, sf_dir).select(COLUMNS).collect()
    expect = _contaminated(list(zip(table.doc_id, table.text, strict=True)), items)
    assert sorted(map(tuple, got), key=str) == expect
    assert any(r[-1] for r in expect)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_random(spark, block_bytes):
    rng = np.random.default_rng(5)
    pool = ["a", "B", "c9", "é", "the"]
    text = lambda n: " ".join(rng.choice(pool, n))
    items = [(i, text(int(n))) for i, n in enumerate([1, 2, 5, 12, 13, 14, 20, 40, 40, 60])] + [(50, None), (51, "!?"), (9, text(15)), (52, "the " * 30), (None, text(14))]
    items += [items[7]]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 400, 60))] + [(100, None), (101, ""), (102, "The.the,THE " * 2000), (None, items[8][1])]
    for i in range(30):
        at = int(rng.integers(0, 25))
        docs.append((200 + i, text(30) + " zz " + " ".join(items[7 + i % 3][1].split()[at : at + 16]) + "; qq " + text(5)))
    docs_df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    marked = decontaminate.digest(decontaminate.mark(docs_df, bench, block_bytes=block_bytes))
    assert sorted(map(tuple, marked.collect()), key=str) == _contaminated(docs, items)
    long_items = [x for x in items if x[1] and len(_words(x[1])) >= 13]
    bench = spark.createDataFrame(long_items, "item_id long, text string")
    expect = _contaminated(docs, long_items)
    assert sorted(map(tuple, decontaminate.digest(decontaminate.mark(docs_df, bench)).collect()), key=str) == expect
    left = decontaminate.drop_contaminated(docs_df, bench)
    assert left.columns == docs_df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in expect if not r[-1])


def test_decontamination_with_an_item_of_a_million_words(spark):
    """Beside 2,000 short ones: what is held grows with the words, and windows at the cuts of the long item are found."""
    rng = np.random.default_rng(8)
    long = rng.integers(0, 50_000, 1_000_000)
    say = lambda xs: " ".join(f"w{x}" for x in xs)
    items = [(0, say(long))] + [(i, say(rng.integers(60_000, 90_000, int(rng.integers(1, 30))))) for i in range(1, 2001)]
    edge = decontaminate.PIECE
    docs = [(1, "before " + say(long[edge - 6 : edge + 7]) + " after"), (2, "before " + say(long[edge - 6 : edge + 6]) + " after"), (3, say(long[-40:])), (4, items[5][1]), (5, say(long[2 * edge - 30 : 2 * edge + 40]))]
    docs_df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (32 << 20, 3 << 20):
        got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.mark(docs_df, bench, block_bytes=block_bytes).collect()}
        assert got[1] == (15, 13, [0]) and got[2] == (14, 0, []) and got[3] == (40, 40, [0]) and got[5] == (70, 70, [0])
        assert got[4][1] == got[4][0] and 5 in got[4][2]


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = _rows(spark, ["a b c", None])
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.digest(decontaminate.mark(docs, none)).orderBy("doc_id").collect()] == [(3, 0, False), (0, 0, False)]
    assert decontaminate.mark(docs.where("false"), none).collect() == []


def test_long_text_in_segments(monkeypatch):
    raw = b"some words " * 400 + b"w" * 9000 + b" end"
    whole = decontaminate.word_hashes(raw)
    monkeypatch.setattr(decontaminate, "_SEGMENT", 100)
    parts = decontaminate.word_hashes(raw)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
