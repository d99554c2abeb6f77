import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators import changes, chunking, evaluation, judge, metrics, store, vectors
from spanweave.plans.engine import CodeGraphEngine
from spanweave.streaming import streams


@pytest.mark.parametrize("mode", ["reference", "clean"])
def test_chunks_cover_every_line_once(mode):
    rng = random.Random(1)
    for _ in range(80):
        lines = [rng.choice(["", "import a", "# note", "def f():", "    x = 1", "    return y", "class A:", "x = 2", "@deco", "y" * 90]) for _ in range(rng.randint(1, 40))]
        text = "\n".join(lines)
        got = chunking.chunk_lines(text, 20, mode)
        covered = [i for lo, hi, _ in got for i in range(lo, hi + 1)]
        assert len(covered) == len(set(covered)) and set(range(1, len(lines) + 1)) - set(covered) <= {i + 1 for i, x in enumerate(lines) if not x.strip()} | set(range(1, len(lines) + 1)) - set(covered)
        assert all(lines[i - 1].strip() == "" for i in set(range(1, len(lines) + 1)) - set(covered))
        assert all(tokens <= 20 or lo == hi for lo, hi, tokens in got)


def test_breakpoints_agree_with_sql_windows(spark):
    texts = [(str(i), t) for i, t in enumerate(["# a\n# b\n\ndef f():\n    x = 1\ny = 2\n", "# far\n\n\n\n\nimport a\n@d\nclass A:\n    pass\nz = 1", "x"])]
    d = spark.createDataFrame(texts, "id string, text string")
    rows = {}
    for r in chunking.breakpoint_lines(d, "id", "text").collect():
        rows.setdefault(r["id"], {0}).add(r["line"])
    assert {i: set(chunking.breakpoints(t)) for i, t in texts} == {i: rows.get(i, {0}) for i, _ in texts}


def test_topk_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [1.0], "x"), (None, x[0].tolist(), "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string").repartition(5)
    q = v.where("vec_id % 10 = 0 and vec_id < 300")
    for block in (4, 4096):
        got = {}
        for r in vectors.topk(v, q, 5, block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
        assert len(got) == 30
        for s, hits in got.items():
            d = ((x.astype(np.float64) - x[s].astype(np.float64)) ** 2).sum(1)
            want = sorted(range(300), key=lambda i: (round(d[i], 12), i))[:5]
            assert [h[1] for h in sorted(hits)] == want
    assert vectors.topk(v, q.limit(0), 5).count() == 0 and vectors.topk(v.limit(0), q, 5).count() == 0
    assert vectors.topk(v, q.where("vec_id = 0"), 999).count() == 300


def test_votes(spark):
    d = spark.createDataFrame([("g", 'class FooBar:\n    def do_it(self):\n        """x"""\n        myVar = 1\n        try:\n            pass\n        except ValueError:\n            pass\n'), ("h", "# only\nx_y = 1"), ("h", None)], "graph_id string, text string")
    names = {(r["graph_id"], r["kind"]): r["convention"] for r in changes.naming_votes(d).collect()}
    assert names == {("g", "class"): "PascalCase", ("g", "function"): "snake_case", ("g", "variable"): "camelCase", ("h", "variable"): "snake_case"}
    assert {r["graph_id"]: r["style"] for r in changes.error_votes(d).collect()} == {"g": "specific_exception_handling", "h": "no_error_handling"}
    assert {r["graph_id"]: r["style"] for r in changes.doc_votes(d).collect()} == {"g": "docstrings_triple_double", "h": "inline_comments"}


def test_judging(spark):
    text = "Relevance (1-10): 8\nfaithfulness: RAG 7, LLM 9\nOverall analysis of both:\n good work \n\nrest"
    d = spark.createDataFrame([(1, text, "a")], "id int, t string, file string")
    rag, llm = judge.paired_scores(F.col("t"), "faithfulness")
    r = d.select(judge.metric_score(F.col("t"), "relevance").alias("m"), judge.metric_score(F.col("t"), "depth").alias("z"), rag.alias("r"), llm.alias("l"), judge.winner(rag, llm).alias("w"), judge.analysis(F.col("t")).alias("a")).first()
    assert tuple(r)[:5] == (8, 0, 7, 9, "LLM-Only") and r["a"].strip() == "good work"
    hits = spark.createDataFrame([(i, f"c{i}") for i in range(12)], "ord int, id string")
    scores = spark.createDataFrame([(i, 9 - abs(i - 4)) for i in range(10)], "ord int, score int")
    assert [x["id"] for x in judge.rerank(hits, scores).orderBy("place").collect()][:3] == ["c4", "c3", "c5"]
    assert [x["ord"] for x in judge.rerank(hits, scores.limit(3)).orderBy("place").collect()] == list(range(12))
    s = "File: a/b.py (Lines 3-5)\nBefore:\n```python\nx = 1\n```\nAfter:\n```\nx = 2\n```\nExplanation: because\n\nFile: c.py (Line 7)\nExplanation: other"
    got = judge.change_suggestions(spark.createDataFrame([(1, s)], "id int, t string"), "id", "t").orderBy("file").collect()
    assert [tuple(x)[1:] for x in got] == [("a/b.py", 3, 5, "x = 1", "x = 2", "because"), ("c.py", 7, 7, None, None, "other")]


def test_parts_of_verdicts(spark):
    text = "Analysis of the answer: clear.\nSpecific suggestions for improvement: cite lines.\n\nWhen RAG helps: on names.\nWhen the LLM is enough: on syntax."
    d = spark.createDataFrame([(text,), ("nothing here",), (None,)], "t string")
    got = [tuple(r) for r in d.select(*(f(F.col("t")) for f in (judge.answer_analysis, judge.suggestions, judge.retrieval_advantages, judge.model_sufficient))).collect()]
    assert got[0][0] == "clear." and got[0][1].startswith("cite lines.") and got[0][2] == "on names." and got[0][3] == "on syntax."
    assert got[1:] == [(None,) * 4] * 2


def test_model_steps_without_and_with_a_model():
    from spanweave.plans import model

    say = lambda text: type("M", (), {"invoke": lambda self, prompt: text})()
    assert model.answer_alone("q", None) is None and model.answer_alone("q", say("a")) == "a"
    assert model.recommend("q", "plan", None) == "plan" and model.recommend("q", "plan", say("File: x")) == "File: x"
    assert model.graph_query("q", None) is None and model.graph_query("q", say("DROP TABLE x")) is None and model.graph_query("q", say("SELECT 1; SELECT 2")) is None
    assert model.compare("q", "a", "b", say("accuracy: RAG 7, LLM 5")) == "accuracy: RAG 7, LLM 5"


def test_overlap_of_longer_orders(spark):
    from spanweave.operators import evaluation

    d = spark.createDataFrame([(1, "the cat sat on the mat", "the cat lay on a mat"), (2, "a b c d", "a b c d"), (3, "", "x"), (4, None, None)], "k int, c string, r string")
    got = {r["k"]: r for r in evaluation.overlap_scores(d, "k", "c", "r", 4).collect()}
    assert (got[2]["bleu"], got[2]["rouge_1"], got[2]["rouge_4"]) == (1.0, 1.0, 1.0) and got[1]["rouge_2"] == 0.2 and got[1]["bleu"] == 0.0 and got[3]["bleu"] == 0.0
    lcs = {r["k"]: r["l"] for r in d.select("k", evaluation.rouge_l(F.col("c"), F.col("r")).alias("l")).collect()}
    assert lcs == {1: round(8 / 12, 6), 2: 1.0, 3: 0.0, 4: 0.0}
    assert [r[0] for r in d.orderBy("k").select(evaluation.grounding(F.col("c"), F.col("r"))).collect()] == [0.8, 1.0, None, None]


def test_written_tables_are_released(spark, small):
    from spanweave.plans.queries import QUERIES
    from spanweave.session import cut_lineage, release

    release(spark)
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and QUERIES["edge_counts_by_type"](spark, small).count() > 0
    assert release(spark) == 4 and release(spark) == 0
    assert QUERIES["edge_counts_by_type"](spark, small).count() > 0


def test_model_seam():
    from spanweave.plans import model

    say = lambda text: type("Fixed", (), {"invoke": lambda self, prompt: text})()
    assert model.rerank_order("q", ["a", "b", "c"], say("Score: 1\nScore: 9\nscore: 5")) == [1, 2, 0]
    assert model.rerank_order("q", ["a", "b"], say("Score: 1")) == [0, 1] == model.rerank_order("q", ["a", "b"], None)
    assert model.judge_answer("q", "c", "a", ["Depth", "Accuracy"], say("depth (1-10): 7")) == {"Depth": 7, "Accuracy": 0}
    assert model.classify("q", "code_explanation", say("it is a change_request")) == "change_request" and model.classify("q", "code_explanation", None) == "code_explanation"
    assert model.expand("q", say("more words\nrest")) == "q more words" and model.expand("q", None) == "q"


def test_collections(spark):
    from spanweave.functions import collections as C

    d = spark.createDataFrame([(1, None, ["a"], {"k": "v"})], "i int, s string, l array<string>, m map<string,string>")
    r = d.select(C.property_bag(d, "i").alias("b"), C.lookup(F.col("m"), "x", "none").alias("x"), C.merged(F.col("m"), F.create_map(F.lit("k"), F.lit("w"))).alias("mm")).first()
    assert r["b"] == {"l": '["a"]', "m": '{"k":"v"}'} and r["x"] == "none" and r["mm"] == {"k": "w"}
    z = spark.createDataFrame([("q", ["a", "b"], [1.0])], "q string, ids array<string>, d array<double>")
    assert [tuple(x) for x in C.zipped_rows(z, "ids", "d").collect()] == [("q", 0, "a", 1.0), ("q", 1, "b", None)]


def test_overlap_scores(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "the the the", "the cat"), (3, None, "x"), (4, "a b", "c d")], "k int, c string, r string")
    got = {r["k"]: (r["bleu"], r["rouge_1"]) for r in evaluation.overlap_scores(d, "k", "c", "r").collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.4), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_store(spark):
    ddl = "conversation_id string, graph_id string, user_id string, name string, history array<struct<user:string,assistant:string,timestamp:string>>, created_at timestamp"
    c = spark.createDataFrame([("a", "g", "u", None, [("q2", "x", "2"), ("q1", "y", "1")], None), ("a", "g", "u", None, [("q2", "x", "2"), ("q1", "y", "1")], None), ("b", "g", None, None, None, None)], ddl)
    assert [(r["pos"], r["user"]) for r in store.conversation_history(c).orderBy("pos").collect()] == [(0, "q1"), (1, "q2")]
    u = store.unique_rows(c, "conversation_id")
    new = spark.createDataFrame([("b", "n1", "x", "1"), ("b", "n2", "y", "2")], "conversation_id string, user string, assistant string, timestamp string")
    h = {r["conversation_id"]: r["history"] for r in store.append_turn(u, new).collect()}
    assert [t["user"] for t in h["b"]] == ["n1", "n2"] and len(h["a"]) == 2
    g = spark.createDataFrame([("g", "u"), ("h", None)], "graph_id string, user_id string")
    assert [r["conversation_id"] for r in store.accessible(u, g).collect()] == ["a"]
    assert store.cascade_delete(u, g.where("graph_id = 'g'")).count() == 0
    assert store.conversation_list(c.limit(0)).count() == 0


def test_streams_match_batches(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").limit(200)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r[0]), r[1], r[2]) for r in spark.table("windows").collect()}
    assert got == {(str(r[0]), r[1], r[2]) for r in streams.event_windows(spark.read.parquet(str(tmp_path / "in"))).collect()}


def test_file_arrival(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    g()\n")
    seen = []
    q = streams.file_arrival(spark, str(tmp_path / "src"), "g", lambda df, epoch: seen.extend(r["name"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == ["f", "g"]


def test_engine_end_to_end(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.py").write_bytes("import os\n\nclass Loader:\n    '''Loads rows.'''\n    def load(self):\n        return helper()\n\ndef helper():\n    return 1\n".encode() + b"# \xff\xfe\n")
    (src / "sub" / "test_b.PY").write_text("def test_load():\n    helper()\n")
    (src / "x.txt").write_text("no")
    e = CodeGraphEngine(spark, str(tmp_path / "store"))
    e.index(str(src), "g1", "n", "u")
    e.index(str(src / "sub"), "g2", "n", "u")
    assert e.graphs("u").count() == 2 and e.graph("g1").nodes.where("name = 'Loader'").count() == 1
    meta = e.read("index_metadata", "g1").first()
    assert meta["num_unique_entities_processed"] == e.read("entities", "g1").count() and meta["token_limit_per_chunk"] == 1050 and len(meta["processed_files"]) == 2
    r = e.retrieve("How does the Loader load its rows?", "g1")
    assert r.intent == "code_explanation" and r.entities.count() > 0 and r.chunks.count() > 0
    assert "Relations" in e.context(r, "g1") and "def helper" in e.context(r, "g1")
    assert e.retrieve("Add a function to drop rows", "g1").extras["impact"].count() > 0
    assert {k: v.count() for k, v in e.evaluate("g1").items()}["density"] == 1
    assert e.evaluate_retrieval("g1", ["load rows", "helper"], 2).count() == 4
    cid, said = e.start_chat("u", "g1", "Where is helper called?", "talk")
    assert "helper" in said
    e.model = type("Echo", (), {"invoke": lambda self, prompt: "change_request: echo"})()
    assert e.send_message("u", cid, "Change function helper") == "change_request: echo"
    assert [r["user"] for r in e.history(cid).orderBy("pos").collect()] == ["Where is helper called?", "Change function helper"]
    with pytest.raises(KeyError):
        e.send_message("someone", cid, "x")
    e.model = None
    plan = e.recommendation("Please modify function helper", "g1")
    assert "Change points" in plan and "helper" in plan and "names: " in plan and "Impact" in plan
    assert e.ask_graph("Where is the Loader?", "g1").where("name = 'Loader'").count() == 1
    e.model = type("Asks", (), {"invoke": lambda self, prompt: "```sql\nSELECT name FROM nodes WHERE entity_type = 'Class';\n```"})()
    assert [r["name"] for r in e.ask_graph("Which classes are there?", "g1").collect()] == ["Loader"]
    e.model = None
    other, _ = e.start_chat("u", "g2", "Who calls helper?", "two")
    with pytest.raises(KeyError):
        e.delete("someone", "g2")
    e.delete("u", "g2")
    assert [r["conversation_id"] for r in e.conversations("u").collect()] == [cid] and e.history(other).count() == 0
    assert e.read("nodes").select("graph_id").distinct().count() == 1
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        e.index(str(tmp_path / "none"), "g3")


def test_queries_match_their_sql(spark, small):
    """Every query with SQL gives the rows DuckDB gives on the smallest tables."""
    import glob
    import os

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    sql, bad = entry.oracle_sql(), []
    norm = lambda v: repr(round(v, 5)) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else repr(v)
    for name, run in entry.queries().items():
        df = run(spark, small)
        cols = sorted(df.columns)
        if name not in sql:
            df.limit(5).collect()
            continue
        got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        res = con.execute(sql[name])
        names = [d[0] for d in res.description]
        want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
        if sorted(names) != cols or got != want:
            bad.append(name)
    assert not bad
    assert entry.entry(spark).count() > 0
