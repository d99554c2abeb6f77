import pytest

from spanweave.llm import badpairs as B


@pytest.fixture(scope="module")
def model(spark):
    return B.train(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


A = "Every plan in api/x.py points at one hub, so the cell can be dropped. The hub is read before any plan is written to the index."


@pytest.mark.parametrize("q,a,defect", [
    ("Why does f fail?", None, "empty"), ("Why does f fail?", " \u200b\n", "empty"), ("Why does f fail?", A, None), ("Why does f fail?", A[:-25], "truncated"), ("Why does f fail?", A + "\n\n```python\ndef f():\n    retu", "truncated"),
    ("Why does f fail after 3 plans?", "why does f fail after 3 plans?", "copied_question"), ("Why does f fail after 3 plans?", "You asked: Why does f fail after 3 plans?", "copied_question"),
    ("Why does f fail?", "I'm sorry, but I can't help with that.", "refusal"), ("Why does f fail?", 'The message "Sorry, I can\'t do that" comes from x.py. ' + A, None), ("Why does f fail?", "I'm sorry for the confusion in my last reply. " + A, None),
    ("Why does the parser fail here?", "Die Prüfung dauert ungefähr 267 Sekunden und schlägt bei der Datei manchmal fehl, weil der Knoten nicht gefunden wird.", "wrong_language"),
    ("Please describe the parser in German.", "Die Prüfung dauert ungefähr 267 Sekunden und schlägt bei der Datei manchmal fehl, weil der Knoten nicht gefunden wird.", None),
    ("Where is f?", "core/index.py", None), ("How many?", "42", None), ("Which functions?", "- load_index\n- drop_index", None), ("Is it used?", "No.", None), (None, A, None),
])
def test_defects(model, q, a, defect):
    assert model.defect(q, a) == defect


def test_held_out_accuracy(spark, model):
    """Made pairs from other rows than the training sample's, all defects."""
    t = B.turns(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")).where("user is not null and assistant is not null").limit(600).collect()
    pairs = B.sound_pairs([(r["user"], r["assistant"]) for r in t])
    made, y, _ = B.made_pairs(pairs, seed=5)
    got = model.defects([q for q, _ in made], [a for _, a in made])
    hits = sum((B.DEFECTS[k] if k >= 0 else None) == g for k, g in zip(y, got))
    assert hits / len(made) > 0.97


def test_tables(spark):
    ddl = "conversation_id string, graph_id string, user_id string, name string, history array<struct<user:string,assistant:string,timestamp:string>>, created_at timestamp, turn string, defect string"
    rows = [("a", None, None, None, [("q", None, "t"), ("Where is f?", "core/x.py", None)], None, "1", "2"), ("a", None, None, None, [("q", None, "t"), ("Where is f?", "core/x.py", None)], None, "1", "2"), ("b", None, None, None, None, None, "1", "2"), ("c", None, None, None, [], None, "1", "2")]
    c = spark.createDataFrame(rows, ddl)
    assert [tuple(r) for r in B.found(c).collect()] == [("a", 0, "empty")]
    assert B.found(spark.createDataFrame([], ddl)).count() == 0


def test_ngrams_cover_the_whole_answer():
    """Far from both ends, beyond 40 words and 4000 characters, a wording still counts."""
    long = "The reader opens the file and returns the rows in order. " * 100
    a, b = (f"{long}{says} {long}" for says in ("Nobody will ever hear that from this side.", "It then writes them to the table."))
    z = [B.Batch(["Why does f fail?"], [x], 64, B.Vocabulary()).matrix(64) for x in (a, b)]
    assert (z[0] != z[1]).any()


def test_refusals_rest_on_ngrams(model):
    """Without the n-grams' weights no refusal is found; with them in words that no list holds."""
    said = ["Sorry, but I am not able to help with that question.", "Leider darf ich dazu keine Auskunft geben.", "Lo siento, no me está permitido hablar de eso.", "Je ne suis pas autorisé à vous répondre."]
    asked = ["Why does f fail?", "Warum schlägt die Funktion fehl?", "¿Por qué falla la función?", "Pourquoi la fonction échoue-t-elle ?"]
    assert model.defects(asked, said) == ["refusal"] * 4
    bare = B.Model(model.weights.copy(), model.thresholds)
    bare.weights[:, len(B.NAMED_FEATURES) :] = 0
    assert "refusal" not in bare.defects(asked, said)


def test_batch_equals_single_pairs(model):
    qs = ["Why does f fail?", None, "", "Was macht f?", "Explain f"] * 3
    xs = [A, "", None, A[:-25], "Explain f\u200b"] * 3
    assert model.defects(qs, xs) == [model.defect(q, x) for q, x in zip(qs, xs)]
    assert model.defects([], []) == []
    x = B.Batch(qs, xs, 32, B.Vocabulary())
    w = __import__("numpy").random.default_rng(1).normal(size=(5, len(B.NAMED_FEATURES) + 64))
    assert abs(x.logits(w) - x.matrix(32) @ w.T).max() < 1e-4
