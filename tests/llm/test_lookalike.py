import unicodedata

import duckdb
import pytest

from spanweave.llm import lookalike as L

SAME = [("ｆｕｌｌ　１２", "full 12"), ("cafe\u0301", "café"), ("a\u200bb\u2060c\ufeff", "abc"), ("a\u00a0b\u202fc", "a b c"), ("pаypаl", "paypal"), ("ΑΒΕ", "ABE"), ("ѕіmрlе", "simple"), ("5 µs", "5 μs"), ("\u212a", "K"), ("ё", "е\u0308"), ("ё", "ë"), ("ｶﾞ", "ガ"), ("soft\u00adhyphen", "softhyphen"), ("x\u200dy", "xy"), ("ў", "y\u0306"), ("a\u202eb", "ab"), ("a\u2066b\u2069", "ab"), ("x\ufe0f", "x"), ("a\U000e0041", "a"), ("ᎪᏴ", "AB"), ("ꓮꓐ", "AB"), ("﹖", "?"), ("ὰ", "à")]
DIFFERENT = [("x²", "x2"), ("Abc", "abc"), ("café", "cafe"), ("👩\u200d💻", "👩💻"), ("a b", "a\tb"), ("a\r\n", "a\n"), ("ﬁ", "fi"), ("–", "-"), ("①", "1"), ("ß", "β"), ("т", "t"), ("ь", "b"), ("З", "3"), ("ı", "i"), ("❤\ufe0f", "❤"), ("🏴\U000e0067\U000e007f", "🏴"), ("\u3164", "")]


@pytest.fixture(scope="module")
def form():
    con = duckdb.connect()
    return lambda s: con.execute(f"SELECT {L.form_sql()} FROM (SELECT ? AS text)", [s]).fetchone()[0]


@pytest.mark.parametrize("a,b", SAME)
def test_same(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(form, a, b):
    assert form(a) != form(b)


def test_form_against_the_other_way(spark):
    texts = [None, "", "\u200d", "ἀ α\u0313 é e\u0301", "ｶﾞ１\ufe0f\u20e3", "1\ufe0f\u20e3"] + [x for p in SAME + DIFFERENT[:-2] for x in p]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = con.execute(f"WITH {L.check_sql()} SELECT doc_id, form, {L.form_sql('text')} FROM forms ORDER BY doc_id").fetchall()
    assert [(texts[i], a) for i, a, b in got if "\U000e0067" not in (texts[i] or "")] == [(texts[i], b) for i, a, b in got if "\U000e0067" not in (texts[i] or "")]


def test_idempotent_and_composed(form):
    for a, b in SAME + DIFFERENT:
        for s in (a, b):
            assert form(form(s)) == form(s) and unicodedata.normalize("NFC", form(s)) == form(s)
    assert form("👩\u200d❤\ufe0f\u200d👩") == "👩\u200d❤\ufe0f\u200d👩"


def test_pairs_and_classes_against_brute_force(spark, form):
    texts = [None, "", "\u200b", "abc", "аbc", "abс", "abc", "xyz", "xyz", "x yz", "x\u00a0yz", "long " * 5000, "long\u00a0" * 5000]
    d = spark.createDataFrame([(i, t, "f", "t") for i, t in enumerate(texts)], "doc_id long, text string, f string, t string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and form(a) == form(b)}
    got = [tuple(r) for r in L.look_alike_pairs(d).collect()]
    assert set(got) == want and len(got) == len(want)
    links = {r["doc_id"]: r["n_links"] for r in L.look_alike_classes(d).collect()}
    assert links == {i: sum(i in p for p in want) for i, t in enumerate(texts) if t is not None}
    assert {r["doc_id"] for r in L.consistent_forms(d).where("form is null").collect()} == {0}
    assert L.look_alike_pairs(d.limit(0)).count() == 0


def test_hot_class_of_copies(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "case when id < 2990 then 'same' else 'sаme' end as text")
    assert L.look_alike_pairs(d).count() == 2990 * 10
