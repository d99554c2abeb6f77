import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.llm import splitting as S

CHUNKS = "graph_id string, id string, text string, overlap string, piece string"
LIMITS = "index_id string, token_limit_per_chunk int, chunk_overlap_tokens int, text string"


def pieces(spark, texts, limit, overlap):
    c = spark.createDataFrame([("g", str(i), t, "x", "y") for i, t in enumerate(texts)], CHUNKS)
    i = spark.createDataFrame([("g", limit, overlap, "z")], LIMITS)
    out = {}
    for r in S.split_items(S.oversized(c, i)).orderBy("id", "piece").collect():
        out.setdefault(int(r["id"]), []).append(r)
    return out, sorted(int(r[0]) for r in S.found(c, i).collect())


def check(texts, limit, overlap, got):
    for i, t in enumerate(texts):
        if t is None or len(t) // 4 <= limit:
            assert i not in got
            continue
        p = got[i]
        assert "".join(r["text"][r["n_overlap"] :] for r in p) == t
        assert all(len(r["text"]) // 4 <= max(1, limit) for r in p)
        over = min(max(overlap or 0, 0), max(1, limit) - 1) * 4
        for a, b in zip(p, p[1:]):
            assert b["n_overlap"] == min(over, b["start"]) and t[b["start"] - b["n_overlap"] : b["start"]] == b["text"][: b["n_overlap"]]


@pytest.mark.parametrize("limit,overlap", [(10, 0), (10, 3), (1, 0), (64, 16), (10, 99), (10, None)])
def test_round_trip(spark, limit, overlap):
    texts = [None, "", "short", "word " * 200, "a" * 1000, "line one\n\nline two is long.\n" * 40, "日本語の文。" * 60, "👩‍💻é" * 200, "\n" * 500, "x" * 40 + "\n\n" + "y" * 400]
    got, found = pieces(spark, texts, limit, overlap)
    check(texts, limit, overlap, got)
    assert found == sorted(got)


def test_natural_boundaries(spark):
    got, _ = pieces(spark, ["alpha beta gamma.\n\n" * 30], 20, 0)
    assert all(r["text"].endswith("\n\n") for r in got[0])
    got, _ = pieces(spark, ["def f():\n    return 1\n" * 30], 20, 0)
    assert all(r["text"].endswith("\n") for r in got[0])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=300), max_size=6), st.integers(1, 12), st.integers(0, 6))
def test_any_text(spark, texts, limit, overlap):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got, _ = pieces(spark, texts, limit, overlap)
    check(texts, limit, overlap, got)


def test_long_text_and_repeated_rows(spark):
    c = spark.createDataFrame([("g", "a", "some words here. " * 40_000, "x", "y")] * 3, CHUNKS)
    i = spark.createDataFrame([("g", 100, 10, "z")] * 2, LIMITS)
    p = S.split_items(S.oversized(c, i))
    assert p.agg(F.sum(F.length("text") - F.col("n_overlap"))).first()[0] == len("some words here. ") * 40_000
    assert S.found(c, i).count() == 1


def test_offsets_and_lookback_of_many_pieces(spark):
    """More pieces than RUN * RUN would need one level less; overlaps longer than a core and across blocks."""
    t = "".join(f"{i} " for i in range(20_000))
    for limit, overlap in ((3, 2), (90, 80)):
        got, found = pieces(spark, [t], limit, overlap)
        check([t], limit, overlap, got)
        assert found == [0] and [r["start"] for r in got[0]][:2] == [0, len(got[0][0]["text"])]
