import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.functions import similarity, text as X


@pytest.fixture
def one(spark):
    def run(fn, *values):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([values], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)))
        return df.select(fn(*[F.col(n) for n in names]).alias("x")).first()["x"]

    return run


@pytest.mark.parametrize("fn,value,want", [
    (X.clean_path, " repos\\g//a\\b.py ", "repos/g/a/b.py"), (X.clean_path, "/tmp/x/repos/g/a.py", "repos/g/a.py"), (X.clean_path, None, None), (X.sanitize_id, "a b/c.d", "a_b_c.d"), (X.sanitize_id, None, "unnamed"),
    (X.sanitize_name, "a..b.", "a.b"), (X.sanitize_name, "", "unnamed"), (X.sanitize_label, "class", "Type_class"), (X.sanitize_label, "", "UnknownEntity"), (X.sanitize_label, "Été x", "Été_x"), (X.sanitize_relationship, "did-it", "DID_IT"), (X.sanitize_relationship, "", "RELATED_TO"),
    (X.token_count, "abcdefgh9", 2), (X.token_count, None, 0), (X.last_segment, "a.b.c", "c"), (X.change_type, "Please fix error in x", "fix_bug"), (X.change_type, "add method and refactor", "add_method"), (X.change_type, "hello", "other"),
    (X.intent_label, " It is a Change_Request.", "change_request"), (X.intent_label, "?", "general_question"), (X.keyword_intent, "Add a function to validate inputs", "function_request"), (X.keyword_intent, "Modify the parser", "change_request"), (X.keyword_intent, "How does chunking work?", "code_explanation"),
    (X.keywords, "How to load the Index and load_it", ["load", "index", "load_it"]), (X.module_path, "repos/g/pkg/__init__.py", "repos.g.pkg"), (X.word_count, "  ", 0), (X.word_count, " a  b ", 2), (X.markdown_html, "# T\n**b** `c`", "<h1>T</h1><br><strong>b</strong> <code>c</code>"),
])
def test_scalars(one, fn, value, want):
    assert one(fn, value) == want


def test_hops_and_texts(one):
    hops = lambda q, i, h: one(X.dynamic_hops, q, i, h)
    assert hops("a b c d e f", "general_question", 2) == 2 and hops("a b", "general_question", 1) == 1 and hops("a", "general_question", 3) == 2 and hops("w " * 16, "general_question", 3) == 3 and hops("a", "change_request", 1) == 2
    assert one(X.gated_description, "short", "Function", "f") == "Function f" and one(X.gated_description, "x" * 400, "Function", "f") == "x" * 300
    t = one(X.entity_text, "Function", "f", "a.py", 3, "Class", "C", "d")
    assert t.split("\n") == ["Entity Type: Function", "Name: f", "Source File: a.py:3", "Context: Defined within Class 'C'", "Description: d", ""]
    assert one(X.default_description, None, "Call", "g") == "Default description for Call 'g'."


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefgh_ÄX", max_size=14), st.text(alphabet="abcdefgh_ÄX", max_size=14))
def test_jaro_winkler_is_a_similarity(a, b):
    s = similarity.jaro_winkler_text(a, b)
    assert 0.0 <= s <= 1.0 and abs(s - similarity.jaro_winkler_text(b, a)) < 0.35 and (a != b or s == 1.0)


def test_jaro_winkler_against_sql(spark):
    import duckdb

    words = ["load_index", "load_indices", "index_load", "a", "ab", "ba", "martha", "marhta", "dixon", "dicksonx", "", "clair", "eclair", "parse_row", "row_parse"]
    con = duckdb.connect()
    df = spark.createDataFrame([(a, b) for a in words for b in words] + [(None, "a")], "a string, b string")
    for r in df.select("a", "b", similarity.jaro_winkler("a", "b").alias("s")).collect():
        if r["a"] is None:
            assert r["s"] is None
        elif r["a"] and r["b"]:
            assert r["s"] == pytest.approx(con.execute("select jaro_winkler_similarity(?, ?)", [r["a"], r["b"]]).fetchone()[0], abs=1e-9)
