"""Registered queries of the stages around the graph: sources, sinks, streams, text and model steps.

Where a stage reads files, it reads a fixed corpus that is put into the shared folder first; its expected rows are
written out by hand in the SQL. All others run over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanweave.functions import text as X
from spanweave.functions.collections import epoch_millis
from spanweave.operators import changes, chunking, judge, metrics, report, store, traversal, vectors
from spanweave.operators import evaluation as E
from spanweave.plans import model as M
from spanweave.plans.queries import CHUNKS, GRAPH, ORACLE_SQL, TURNS, Query, graph_of
from spanweave.sources import files
from spanweave.sources.parsing import extract_entities
from spanweave.session import _WRITTEN, cut_lineage, shared_dir, table
from spanweave.streaming import streams

#: The fixed corpus: path and bytes.
CORPUS: dict[str, bytes] = {
    "src/app.py": "import os, sys as s\nfrom pkg.mod import load as ld, Row\n\nclass Store(Base):\n    '''Keeps rows.'''\n\n    @cached\n    def get(self, key):\n        return ld(key).first()\n\ndef main():\n    print(Store().get(\"é\"))\n".encode(),
    "src/sub/broken.PY": b"def ok():\n    return 1\n\ndef bad(:\n",
    "src/sub/blank.py": b" \n\n",
    "src/sub/bytes.py": b"x = '\xff\xfea'\n",
    "src/notes.txt": b"def no(): pass\n",
}
GRAPHS_JSON = b'[{"graph_id": "g1", "name": "one", "user_id": "u"},\n {"graph_id": "g2", "name": null}]'
MARKDOWN = ["# Head\n**bold** and `code`", "- a\n- b"]


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/spanweave-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def _corpus(spark: SparkSession) -> str:
    root = _folder(spark)
    for name, content in CORPUS.items():
        files.put(spark, f"{root}/{name}", content)
    return root


def _short(path: str = "path") -> F.Column:
    return F.regexp_extract(path, r"(src/.*)$", 1)


def _corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.python_files(spark, f"{_corpus(spark)}/src", "g").select(_short().alias("path"), F.lower(F.hex(F.encode("content", "UTF-8"))).alias("content"))


def _shown_entities(e: DataFrame) -> DataFrame:
    return e.select(_short("source_file").alias("path"), "seq", "entity_type", "name", "start_line", "start_byte", "end_byte", "parent_type", "parent_name", F.array_join("imported_items", "|").alias("items"))


def _corpus_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_entities(extract_entities(files.python_files(spark, f"{_corpus(spark)}/src", "g")))


def _corpus_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a stream of files, each batch appended to a table."""
    root, out = _corpus(spark), _folder(spark)
    streams.file_arrival(spark, f"{root}/src", "g", lambda batch, epoch: batch.write.mode("append").parquet(out), f"{root}/checkpoint").awaitTermination()
    return _shown_entities(spark.read.parquet(out))


def _corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files.python_files(spark, f"{_corpus(spark)}/src", "g").where(F.endswith("path", F.lit("app.py")))
    return chunking.chunk_files(f, 24).select("chunk_index", "start_line", "end_line", "token_count", F.col("language"))


def _json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark)
    files.put(spark, f"{root}/graphs.json", GRAPHS_JSON)
    return files.json_list(spark, f"{root}/graphs.json", "graph_id string, name string, user_id string")


def _registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark)
    g = table(spark, sf_dir, "graphs").select("graph_id", "name", "folder_path", "user_id")
    files.write_json(g, f"{root}/graphs")
    return spark.read.schema(g.schema).json(f"{root}/graphs")


def _index_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = metrics.chunk_rows(table(spark, sf_dir, "chunks")).select(F.col("source_file").alias("path")).where("path is not null")
    r = files.index_metadata_row(spark, "all", f, table(spark, sf_dir, "entities").count(), table(spark, sf_dir, "chunks").count(), 1050, "hashed words")
    return r.drop("indexed_at").withColumn("processed_files", F.array_join("processed_files", "|"))


def _line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.line_tokens(table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")))


def _vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all nodes with a description, written by graph and read back: how many, and of what size."""
    n = graph_of(spark, sf_dir).nodes.where("description is not null")
    v = vectors.hash_embedding(n.select("id", F.concat_ws(" ", "name", "description").alias("text")), "id", "text", 64)
    root = _folder(spark)
    files.write_vectors(v.join(n.select("id", "graph_id"), "id"), root)
    return spark.read.parquet(root).groupBy(F.col("graph_id").cast("string").alias("graph_id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))


def _turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as JSON lines that a stream appends to a table."""
    root = _folder(spark)
    t = store.conversation_history(table(spark, sf_dir, "conversations")).select("conversation_id", "user", "assistant", F.col("ts").alias("timestamp"))
    t.write.json(f"{root}/in")
    streams.conversation_turns(spark, f"{root}/in", f"{root}/checkpoint", f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("conversation_id", F.md5(F.coalesce("user", F.lit("-"))).alias("asked"), F.md5(F.coalesce("assistant", F.lit("-"))).alias("answered"), "timestamp")


def _window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly windows of the events as a stream; windows that the watermark has passed are out."""
    root = _folder(spark)
    e = table(spark, sf_dir, "events")
    e.write.parquet(f"{root}/in")
    w = streams.event_windows(spark.readStream.schema(e.schema).parquet(f"{root}/in"))
    w.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(w.schema).parquet(f"{root}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total_value")


def _change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_of(spark, sf_dir)
    hits = g.nodes.where("entity_type in ('Function', 'Class')").select("graph_id", "id", (F.row_number().over(W.partitionBy("graph_id").orderBy("id")) - 1).alias("ord"))
    return changes.change_points(g, hits, "add_method").select("graph_id", "id", "change", "line", "score", "ord")


def _rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hits, the first ten by their scores."""
    d = table(spark, sf_dir, "documents").where("n_chars is not null").orderBy("doc_id").limit(12)
    hits = d.select("doc_id", (F.row_number().over(W.orderBy("doc_id")) - 1).alias("ord"), "n_chars")
    return judge.rerank(hits.select("doc_id", "ord"), hits.select("ord", (F.col("n_chars") % 7).cast("int").alias("score"))).select("doc_id", "ord", "score", "place")


def _rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store.conversation_history(table(spark, sf_dir, "conversations")).withColumn("n", F.coalesce(F.length("assistant"), F.lit(0)) % 11)
    said = F.concat(F.lit("Text 0\nScore: "), F.col("n").cast("string"), F.lit("\nText 1\nSCORE : 3"))
    return t.select("conversation_id", "pos", F.array_join(judge.rerank_scores(said).cast("array<string>"), ",").alias("scores"))


def _query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different texts that are searched for, without empty ones."""
    t = store.conversation_history(table(spark, sf_dir, "conversations")).select(F.col("user").alias("q"))
    n = graph_of(spark, sf_dir).nodes.select(X.special_term(F.col("entity_type"), F.col("name")).alias("q"))
    return t.unionByName(n).where("trim(q) <> ''").distinct()


def _verdict_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store.conversation_history(table(spark, sf_dir, "conversations")).where("assistant is not null")
    said = F.concat(F.lit("Overall analysis of it: turn "), F.col("pos").cast("string"), F.lit("\nRAG advantages: "), F.length("assistant").cast("string"), F.lit("\nLLM-only approach: never\nSuggestions: more"))
    return t.select("conversation_id", "pos", judge.retrieval_advantages(said).alias("rag"), judge.model_sufficient(said).alias("llm"), judge.suggestions(said).alias("more"))


def _suggested_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").where("start_line is not null and entity_type = 'Function'")
    said = F.concat(F.lit("Do this.\nFile: a/b.py (Lines "), F.col("start_line").cast("string"), F.lit("-"), F.coalesce("end_line", "start_line").cast("string"), F.lit(")\nBefore:\n```python\nx = 1\n```\nAfter:\n```\nx = 2\n```\nExplanation: it is "), F.col("rec_id").cast("string"), F.lit("\n\nend"))
    return judge.change_suggestions(e.select("rec_id", said.alias("t")), "rec_id", "t")


class _Stub:
    """Answers by the first word of the prompt, to show what each step asks for and makes of it."""

    def invoke(self, prompt: str) -> str:
        said = {"Name": "I say change_request.", "Add": "more words\nrest", "Describe": "Does it.", "Answer": "An answer.", "Give": "Score: 1\nScore: 9", "Score": "Relevance (1-10): 7", "Recommend": "File: a.py (Line 3)", "Write": "SELECT id FROM nodes;", "Compare": "accuracy: RAG 8, LLM 6"}
        return said[prompt.split()[0]]


def _model_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = _Stub(), spark.createDataFrame([("a", "Function", "f", None, "x"), ("b", "Class", "C", "Says it all.", "x")], "id string, entity_type string, name string, description string, snippet string")
    rag, llm = judge.paired_scores(F.lit(M.compare("q", "a", "b", m)), "accuracy")
    pair = spark.range(1).select(rag.alias("r"), llm.alias("l")).first()
    rows = [("classify", M.classify("q", "x", m)), ("classify, no model", M.classify("q", "code_explanation", None)), ("expand", M.expand("q", m)), ("expand, no model", M.expand("q", None)), ("answer", M.answer("q", "c", m)), ("answer, no model", M.answer("q", "c", None)),
            ("alone", M.answer_alone("q", m)), ("rerank", str(M.rerank_order("q", ["a", "b"], m))), ("judge", str(M.judge_answer("q", "c", "a", ["Relevance", "Depth"], m))), ("recommend", M.recommend("q", "p", m)), ("recommend, no model", M.recommend("q", "p", None)), ("query", M.graph_query("q", m)),
            ("compare", f"{pair['r']} {pair['l']}")]
    said = M.describe(e, m).select(F.concat(F.lit("describe "), "id").alias("step"), F.col("description").alias("result"))
    plain = M.describe(e, None).select(F.concat(F.lit("describe "), "id", F.lit(", no model")).alias("step"), F.col("description").alias("result"))
    return spark.createDataFrame(rows, "step string, result string").unionByName(said).unionByName(plain)


def _c(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: run(metrics.chunk_rows(table(s, d, "chunks")))


QUERIES: dict[str, Query] = {
    "corpus_files": _corpus_files,
    "corpus_entities": _corpus_entities,
    "corpus_arrivals": _corpus_arrivals,
    "corpus_chunks": _corpus_chunks,
    "json_array_rows": _json_array,
    "registry_round_trip": _registry_round_trip,
    "index_collections": lambda s, d: files.collections(table(s, d, "index_metadata")),
    "latest_index": lambda s, d: files.latest_index(table(s, d, "index_metadata")).select("index_id"),
    "index_row": _index_row,
    "line_tokens": _line_tokens,
    "vector_store": _vector_store,
    "turn_stream": _turn_stream,
    "window_stream": _window_stream,
    "change_points": _change_points,
    "node_sample": lambda s, d: report.sample(graph_of(s, d).nodes, 5).select("graph_id", "id", "name"),
    "rerank_hits": _rerank,
    "rerank_scores": _rerank_scores,
    "context_blocks": _c(lambda c: report.context_blocks(c, 15, 500)),
    "query_texts": _query_texts,
    "verdict_parts": _verdict_parts,
    "suggested_changes": _suggested_changes,
    "model_steps": _model_steps,
    "grounding": lambda s, d: store.conversation_history(table(s, d, "conversations")).select("conversation_id", "pos", E.grounding(F.col("assistant"), F.col("user")).alias("share")),
    "answer_rouge_l": lambda s, d: store.conversation_history(table(s, d, "conversations")).select("conversation_id", "pos", E.rouge_l(F.col("assistant"), F.col("user")).alias("rouge_l")),
    "event_times": lambda s, d: table(s, d, "events").select("event_id", epoch_millis(F.col("ts")).alias("ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), X.day_month_year(F.col("ts")).alias("day")),
    "markdown_html": lambda s, d: s.createDataFrame([(t,) for t in MARKDOWN], "t string").select("t", X.markdown_html(F.col("t")).alias("html")),
    "html_report": lambda s, d: report.html_rows(metrics.quality_score(graph_of(s, d), table(s, d, "chunks")).select("graph_id", "overall")),
    "score_report": lambda s, d: files.report(metrics.quality_score(graph_of(s, d), table(s, d, "chunks"))).select("graph_id", F.get_json_object("report", "$.grade").alias("grade"), F.round(F.get_json_object("report", "$.overall").cast("double"), 4).alias("overall")),
}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
_ENTITIES = """SELECT * FROM (VALUES
    ('src/app.py', 0::BIGINT, 'Import', 'os', 1, 0, 19, NULL, NULL, 'os|sys as s'), ('src/app.py', 1, 'ImportFrom', 'pkg.mod', 2, 20, 55, NULL, NULL, 'load as ld|Row'), ('src/app.py', 2, 'Class', 'Store', 4, 57, 165, NULL, NULL, NULL),
    ('src/app.py', 3, 'DecoratedDefinition', 'get', 7, 103, 165, 'Class', 'Store', NULL), ('src/app.py', 4, 'Function', 'get', 8, 115, 165, 'Class', 'Store', NULL), ('src/app.py', 5, 'Call', 'ld.first', 9, 150, 165, 'Function', 'get', NULL),
    ('src/app.py', 6, 'Call', 'ld', 9, 150, 157, 'Function', 'get', NULL), ('src/app.py', 7, 'Function', 'main', 11, 167, 207, NULL, NULL, NULL), ('src/app.py', 8, 'Call', 'print', 12, 183, 207, 'Function', 'main', NULL),
    ('src/app.py', 9, 'Call', 'Store.get', 12, 189, 206, 'Function', 'main', NULL), ('src/app.py', 10, 'Call', 'Store', 12, 189, 196, 'Function', 'main', NULL), ('src/sub/broken.PY', 0, 'Function', 'ok', 1, 0, 22, NULL, NULL, NULL))
    AS t(path, seq, entity_type, name, start_line, start_byte, end_byte, parent_type, parent_name, items)"""

ORACLE: dict[str, str] = {
    "corpus_files": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c.decode('utf-8', 'ignore').encode().hex()}')" for p, c in CORPUS.items() if p.lower().endswith(".py")) + ") AS t(path, content)",
    "corpus_entities": _ENTITIES,
    "corpus_arrivals": _ENTITIES,
    "corpus_chunks": "SELECT * FROM (VALUES (1, 1, 4, 20, 'python'), (2, 5, 8, 16, 'python'), (3, 9, 13, 19, 'python')) AS t(chunk_index, start_line, end_line, token_count, language)",
    "summary_lines": f"""WITH q AS ({ORACLE_SQL["quality_score"]}), h AS ({ORACLE_SQL["hub_nodes"]}), k AS (WITH {GRAPH.strip()} SELECT graph_id, entity_type, count(*) AS n FROM nodes GROUP BY graph_id, entity_type)
        SELECT graph_id, 'score' AS section, 1 AS ord, 'Overall score ' || printf('%.1f', overall) || ' (' || grade || ')' AS line FROM q
        UNION ALL SELECT graph_id, 'types', CAST(r AS INTEGER), entity_type || ': ' || n FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, entity_type) AS r FROM k) WHERE r <= 10
        UNION ALL SELECT graph_id, 'hubs', CAST(r AS INTEGER), coalesce(name, id) || ' with ' || n_neighbours || ' neighbours' FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n_neighbours DESC, id) AS r FROM h) WHERE r <= 5""",
    "json_array_rows": "SELECT * FROM (VALUES ('g1', 'one', 'u'), ('g2', NULL, NULL)) AS t(graph_id, name, user_id)",
    "registry_round_trip": "SELECT graph_id, name, folder_path, user_id FROM graphs",
    "index_collections": "SELECT DISTINCT index_id, collection FROM (SELECT index_id, entity_vector_collection AS collection FROM index_metadata UNION ALL SELECT index_id, chunk_vector_collection FROM index_metadata) WHERE collection IS NOT NULL",
    "latest_index": "SELECT index_id FROM index_metadata ORDER BY indexed_at DESC NULLS LAST, index_id LIMIT 1",
    "index_row": f"""WITH {CHUNKS.strip()}, f AS (SELECT DISTINCT source_file AS path FROM c WHERE source_file IS NOT NULL ORDER BY path LIMIT 25)
        SELECT 'all' AS index_id, (SELECT string_agg(path, '|' ORDER BY path) FROM f) AS processed_files, 'all_entities' AS entity_vector_collection, 'all_chunks' AS chunk_vector_collection, 'structure_aware' AS chunking_strategy, 1050 AS token_limit_per_chunk,
          'hashed words' AS embedding_model, (SELECT CAST(count(*) AS INTEGER) FROM entities) AS num_unique_entities_processed, (SELECT CAST(count(*) AS INTEGER) FROM chunks) AS num_text_chunks_processed, 'python' AS language_processed""",
    "line_tokens": r"""SELECT CAST(sum(len(regexp_split_to_array(t, '\s+'))) AS BIGINT) AS n_tokens FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE t <> ''""",
    "vector_store": f"WITH {GRAPH.strip()} SELECT graph_id, count(*) AS n, 64 AS least, 64 AS most FROM nodes WHERE description IS NOT NULL GROUP BY graph_id",
    "turn_stream": f"""WITH {TURNS.strip()} SELECT conversation_id, md5(coalesce("user", '-')) AS asked, md5(coalesce(assistant, '-')) AS answered, ts AS timestamp FROM t""",
    "window_stream": """SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total_value FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    "change_points": f"""WITH {GRAPH.strip()}, ip AS ({ORACLE_SQL["insertion_points"]}), h AS (SELECT graph_id, id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS INTEGER) AS ord, entity_type, name FROM nodes WHERE entity_type IN ('Function', 'Class'))
        SELECT h.graph_id, h.id, CASE WHEN h.entity_type = 'Class' THEN 'add_method' ELSE 'related_change' END AS change, CASE WHEN h.entity_type = 'Class' THEN ip.line END AS line,
          CAST(CASE WHEN h.entity_type = 'Class' THEN 10 ELSE 5 END + CASE WHEN h.entity_type = 'Class' AND ip.line IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN h.name IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS score, h.ord
        FROM h LEFT JOIN ip ON ip.graph_id = h.graph_id AND ip.class_id = h.id""",
    "node_sample": f"WITH {GRAPH.strip()} SELECT graph_id, id, name FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS r FROM nodes) WHERE r <= 5",
    "rerank_hits": """WITH h AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS ord, CAST(n_chars % 7 AS INTEGER) AS s FROM documents WHERE n_chars IS NOT NULL QUALIFY ord < 12)
        SELECT doc_id, ord, CASE WHEN ord < 10 THEN s END AS score, CASE WHEN ord < 10 THEN CAST(row_number() OVER (ORDER BY ord >= 10, s DESC, ord) - 1 AS INTEGER) ELSE ord END AS place FROM h""",
    "rerank_scores": f"WITH {TURNS.strip()} SELECT conversation_id, pos, coalesce(length(assistant), 0) % 11 || ',3' AS scores FROM t",
    "context_blocks": f"""WITH {CHUNKS.strip()} SELECT graph_id, CAST(r AS INTEGER) AS ord, '# ' || coalesce(source_file, 'None') || ':' || coalesce(CAST(start_line AS VARCHAR), '?') || '-' || coalesce(CAST(end_line AS VARCHAR), '?') || chr(10) || substring(coalesce(text, ''), 1, 500) AS block
        FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS r FROM c) WHERE r <= 15""",
    "query_texts": f"""WITH {GRAPH.strip()}, {TURNS.strip()} SELECT DISTINCT q FROM (SELECT "user" AS q FROM t UNION ALL SELECT entity_type || ' ' || name FROM nodes WHERE trim(entity_type) <> '' AND trim(name) <> '') WHERE trim(q) <> ''""",
    "verdict_parts": f"WITH {TURNS.strip()} SELECT conversation_id, pos, CAST(length(assistant) AS VARCHAR) AS rag, 'never' || chr(10) || 'Suggestions: more' AS llm, 'more' AS more FROM t WHERE assistant IS NOT NULL",
    "suggested_changes": "SELECT rec_id, 'a/b.py' AS file, start_line, coalesce(end_line, start_line) AS end_line, 'x = 1' AS before_code, 'x = 2' AS after_code, 'it is ' || rec_id AS explanation FROM entities WHERE start_line IS NOT NULL AND entity_type = 'Function'",
    "model_steps": """SELECT * FROM (VALUES ('classify', 'change_request'), ('classify, no model', 'code_explanation'), ('expand', 'q more words'), ('expand, no model', 'q'), ('answer', 'An answer.'), ('answer, no model', 'c'), ('alone', 'An answer.'), ('rerank', '[1, 0]'), ('judge', '{''Relevance'': 7, ''Depth'': 0}'),
        ('recommend', 'File: a.py (Line 3)'), ('recommend, no model', 'p'), ('query', 'SELECT id FROM nodes'), ('compare', '8 6'), ('describe a', 'Does it.'), ('describe b', 'Says it all.'), ('describe a, no model', 'Default description for Function ''f''.'), ('describe b, no model', 'Says it all.')) AS t(step, result)""",
    "grounding": f"""WITH {TURNS.strip()}, w AS (SELECT conversation_id, pos, list_distinct({_WORDS.format("assistant")}) AS a, {_WORDS.format('"user"')} AS u FROM t)
        SELECT conversation_id, pos, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, u)) / CAST(len(a) AS DOUBLE), 6) END AS share FROM w""",
    "event_times": "SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%d/%m/%Y') AS day FROM events",
    "markdown_html": "SELECT * FROM (VALUES ('# Head' || chr(10) || '**bold** and `code`', '<h1>Head</h1><br><strong>bold</strong> and <code>code</code>'), ('- a' || chr(10) || '- b', '<li>a</li><br><li>b</li>')) AS t(t, html)",
    "html_report": f"""WITH q AS ({ORACLE_SQL["quality_score"]}) SELECT graph_id, '<tr><td>' || graph_id || '</td><td style="color:' || CASE WHEN overall >= 70 THEN 'green' WHEN overall >= 40 THEN 'orange' ELSE 'red' END || '">' || CAST(round(overall) AS INTEGER) || '</td></tr>' AS html FROM q""",
    "score_report": f"""WITH q AS ({ORACLE_SQL["quality_score"]}) SELECT graph_id, grade, round(overall, 4) AS overall FROM q""",
}
