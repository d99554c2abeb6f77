import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    return bpe.Vocabulary(bpe.vocabulary_path()), lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library(pair, s):
    s = s.encode("utf-8", "ignore").decode()
    assert pair[0].encode(s) == pair[1](s)


def test_words_and_repeats(pair):
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice("aAeEtThHiInNsS _-=1'") for _ in range(rng.randint(1, 50)))
        assert pair[0].encode(s) == pair[1](s)
    for s in ("a" * 5000, "ab" * 3000, " " * 4000, "=" * 777, "<|endoftext|>", "é" * 999, "I'll we've\r\n\t x"):
        assert pair[0].encode(s) == pair[1](s)


def test_round_trip_of_long_text(pair):
    s = "naïve façade 日本 " * 20_000 + "z" * 200_000
    v = pair[0]
    assert "".join(v.text_of[i] for i in v.encode(s)).encode("latin-1").decode() == s


def test_tables(spark, pair):
    d = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in bpe.encode_corpus(d).collect())
    assert got == [(0, pair[1]("a")), (1, pair[1]("hello world")), (2, []), (3, []), (3, [])]
    assert bpe.encode_corpus(d.limit(0)).count() == 0
    assert [r["n_tokens"] for r in bpe.count_tokens(d.where("doc_id < 3")).orderBy("doc_id").collect()] == [2, 0]
