"""Expressions, against vectors with known results."""

import random
import unicodedata

from pyspark.sql import functions as F

from folioframe.functions import isbn, quality, similarity, text
from folioframe.operators import search


def _apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_search_key(spark):
    pairs = [("Können", "konnen"), ("Łódź", "lodz"), ("ǿrn", "orn"), ("Æsop", "aesop"), ("Œuvres", "oeuvres"), ("ẞ", "ss"), (None, ""), ("  A--b  ", "a b"), ("ıŋħ", "inh"), ("ﬁne", "fine")]
    assert _apply(spark, [a for a, _ in pairs], text.search_key) == [b for _, b in pairs]
    nfd, nfc, ga, ka, half, full = _apply(spark, [unicodedata.normalize("NFD", "한국어"), "한국어", "が", "か", "ｷｬﾗｸﾀｰ", "キャラクター"], text.search_key)
    assert nfd == nfc != "" and ga != ka and half == full


def test_fold_tiers_agree(spark):
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(32, 0x250), *range(0x1E00, 0x1F00), 0x301, 0x308, 0x3042, 0x304C, 0xAC00, 0x4E00, 0xFF76, 0xFF9E)]
    values = ["".join(rng.choices(pool, k=12)) for _ in range(400)] + ["plain", "", None]
    assert _apply(spark, values, text.fold) == [text.fold_text(v) for v in values]


def test_group_key(spark):
    k = _apply(spark, ["The Craft of Research (4th Edition)", "The Craft of Research, Fifth Edition", "The Second Tutorial", "Some Book, Second Edition", "Straße", "Introduction to Logic: Solutions Manual", "Introduction to Logic", "()", "A (x\ry) B"], text.group_key)
    assert k[0] == k[1] == "craft of research" and k[2] == "second tutorial" and k[3] == "some book" and k[4] == "strasse" and k[5] != k[6] and k[7] == "" and k[8] == "b"
    assert _apply(spark, ["Introduction to Logic: Solutions Manual"], lambda c: text.group_key(c, drop_manual=True)) == ["introduction to logic"]


def test_surname_key(spark):
    pairs = [
        ("Remzi H. Arpaci-Dusseau & Andrea Arpaci-Dusseau", "arpaci-dusseau"), ("Josef Müller-Brockmann", "muller-brockmann"), ("Richards J. Heuer Jr.", "heuer"), ("Lang, Serge", "lang"), ("Daniel J. O'Keefe", "okeefe"),
        ("Daniel J. O’Keefe", "okeefe"), ("Syvert P. Nørsett", "norsett"), ("陶哲轩", "陶哲轩"), ("李", "李"), ("", ""), (None, ""), ("...", ""), ("X", "x"),
    ]
    assert _apply(spark, [a for a, _ in pairs], text.surname_key) == [b for _, b in pairs]


def test_small_text_functions(spark):
    assert _apply(spark, ["A & B and C", "", None, "And & "], text.split_authors) == [["A", "B", "C"], [], [], ["And"]]
    assert _apply(spark, [["a"], ["a", "b", "c"], ["a", "b", "c", "d", "e"], []], text.short_authors, "array<string>") == ["a", "a & b & c", "a & b & c & +2", ""]
    assert _apply(spark, ["a &amp; b", "a & b", None, "&#39;"], text.has_entity) == [True, False, False, True]
    assert _apply(spark, ["Statistical Rethinking (501)", "Volume (2) Of Two", "x", None], text.folder_id) == [501, None, None, None]
    assert _apply(spark, ["Added book ids: 7, 12", "nothing 3"], text.reported_ids) == [[7, 12], []]
    assert _apply(spark, ["  a\t", None], text.strip) == ["a", None]


def test_isbn(spark):
    spellings = ["9781119744825", "978-1-119-74482-5", "ISBN: 9781119744825", "ISBN-13: 978 1 119 74482 5", "isbn 9781119744825", " ISBN9781119744825 "]
    assert set(_apply(spark, spellings, isbn.clean)) == {"9781119744825"}
    assert _apply(spark, ["1-85573-348-x", "", None, "not an isbn", "12345", "abcdefghij", "0000000000", "12X4567890"], isbn.clean) == ["185573348X", "", "", "", "", "", "", ""]
    assert _apply(spark, ["9781119744825", "9781119744826", "0471830062", "1-85573-348-X", "", None, "junk"], isbn.valid) == [True, False, True, True, False, False, False]
    assert _apply(spark, ["0471830062", "9781119744825", "junk"], isbn.to_13) == ["9780471830061", "9781119744825", ""]
    assert _apply(spark, ["ISBN-10 0262035618 and ISBN-13 978-0-262-03561-3", "ISBN 1234567890123", None, "ISBN 0262035618 2019"], isbn.extract) == [["9780262035613", "0262035618"], [], [], []]


def test_quality_rules(spark):
    assert _apply(spark, ["0101-01-01T00:00:00+00:00", "", None, "2020-01-01"], quality.missing_pubdate) == [True, True, True, False]
    assert _apply(spark, ["Unknown", "  ADMINISTRATOR ", "", "Ann"], quality.bad_author) == [True, True, True, False]
    assert _apply(spark, ["Microsoft Word - x", "my ebok", "a.PDF", "B00ABCDEFG x", "", "Fine", "ebook"], quality.junk_title) == [True, True, True, True, True, False, False]
    assert _apply(spark, [["a/b.PDF", "a/b.epub", "x.pdf"]], quality.format_codes, "array<string>") == [["EPUB", "PDF"]]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_lcs_and_scores():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 70))) for _ in range(2))
        assert similarity.lcs_length(a, b) == _lcs(a, b)
    assert similarity.score_text("perspective", "basic perspective drawing") == 1.0
    assert similarity.score_text("perspektive", "basic perspective drawing") >= 0.55
    assert similarity.score_text("geometry of art", "the geometry of an art") > 0.9
    assert similarity.score_text("x", "") == 0.0 and similarity.indel("", "") == 1.0


def test_search(spark):
    rows = spark.createDataFrame([(1, "Basic Perspective Drawing", "John Montague"), (2, "Können", "Ann Lee"), (3, "Perspective", "B C"), (4, "", "")], "id long, title string, authors_str string")
    assert [(r.id, r.score) for r in search.search(rows, "perspective").collect()] == [(1, 1.0), (3, 1.0)]
    assert [r.id for r in search.search(rows, "konnen", field="title").collect()] == [2]
    assert search.search(rows, " ?! ").collect() == [] and len(search.search(rows, "perspective", limit=1).collect()) == 1


def test_rounding(spark):
    values = [2 * m / n for n in range(1, 90) for m in range(n // 2 + 1)]
    assert _apply(spark, values, similarity.round3, "double") == [round(v, 3) for v in values]


def _fold_by_letters(s):
    """fold_text() letter by letter."""

    def one(ch):
        return ch if text._is_cjk(ch) else "".join(text.ATOMIC.get(c, c) for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))

    return "".join(map(one, unicodedata.normalize("NFC", s)))


def test_whole_strings_fold_as_their_letters():
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(32, 0x370), *range(0x1E00, 0x1F00), *range(0x2000, 0x206A))]
    for _ in range(3000):
        s = "".join(rng.choices(pool, k=rng.randint(0, 14)))
        assert text.fold_text(s) == _fold_by_letters(s), ascii(s)


def test_author_keys_of_decomposed_names(spark):
    names = [["Jose\u0301 Ga\u0308rtner", "José Gärtner"], ["Łukasz Ｇaŕtner", "Lang, Serge & Co", "O’Keefe, Ann"], [], ["李", "...", "a\x1fb Noe\u0308l"], None]
    got = _apply(spark, names, text.author_keys, "array<string>")
    assert got == [["gartner"], ["gartner", "lang", "okeefe"], [], ["李", "noel"], None]
    flat = [n for ns in names if ns for n in ns if "\x1f" not in n]
    one_by_one = _apply(spark, flat, text.surname_key)
    assert _apply(spark, [[n] for n in flat], text.author_keys, "array<string>") == [[k] if k else [] for k in one_by_one]


def test_hyphenate(spark):
    pairs = [("9783030561260", "978-3-030-56126-0"), ("0471830062", "0-471-83006-2"), ("185573348X", "1-85573-348-X"), ("9780262035613", "978-0-262-03561-3"), ("9789999999991", "9789999999991"), ("9791119744820", "9791119744820"), ("junk", ""), (None, "")]
    got = _apply(spark, [a for a, _ in pairs], isbn.hyphenate)
    assert got == [b for _, b in pairs]
    assert _apply(spark, got, isbn.clean) == _apply(spark, [a for a, _ in pairs], isbn.clean)


def test_bounds_change_no_score():
    import difflib

    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(n))
    for _ in range(400):
        q, c = say(rng.randint(1, 3)), say(rng.randint(0, 12))
        plain = 0.0 if not c else 1.0 if q in c else max(similarity.indel(q, c), sum(max(similarity.indel(x, y) for y in c.split()) for x in q.split()) / len(q.split()))
        assert similarity.score_text(q, c) == plain
        rights = [say(rng.randint(0, 5)) for _ in range(rng.randint(0, 4))]
        assert similarity.best_ratio(q, rights) == max([difflib.SequenceMatcher(None, q, r).ratio() for r in rights], default=0.0)


def test_bound_evaluates_once(spark):
    plan = spark.range(1).select(text.bound(F.rand(3), lambda x: x - x).alias("d"))
    assert plan.first().d == 0.0
