"""The registered queries over the whole tables, and DuckDB SQL for each that SQL can express.

The property graph is built from `entities`; its node and edge tables are written once per session and folder, as
an index is, and shared by the queries on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions import collections as C
from spanweave.functions import text as X
from spanweave.functions.similarity import jaro_winkler
from spanweave.operators import changes, chunking, dedup, evaluation, judge, metrics, report, store, traversal, vectors
from spanweave.operators.graph import Graph, build_graph, duplicate_keys, graph_of_unique, upsert_edges, upsert_nodes, upsert_placeholders
from spanweave.plans import stargraph
from spanweave.plans.stargraph import Coded, coded_star
from spanweave.session import _ON_RELEASE, cut_lineage, table
from spanweave.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_GRAPHS: dict[tuple, Graph] = {}
_ON_RELEASE.append(_GRAPHS.clear)
QUESTION = "How does the parser handle a broken registry and the index of tokens?"


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and last change of a table, to tell when what was built from it is old."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def _stored(spark: SparkSession, sf_dir: str, kind: str, tables: Sequence[str], build: Callable[[], Graph | Coded]) -> Graph | Coded:
    key = (spark.sparkContext.applicationId, sf_dir, kind, *(_state(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    if key not in _GRAPHS:
        g = build()
        with ThreadPoolExecutor(2) as both:  # two jobs at once, as neither fills the cluster to its end
            _GRAPHS[key] = type(g)(*both.map(cut_lineage, (g.nodes, g.edges)))
    return _GRAPHS[key]


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    return _stored(spark, sf_dir, "code", ["entities"], lambda: graph_of_unique(cut_lineage(dedup.unique_entities(dedup.valid_entities(table(spark, sf_dir, "entities"))))))


def star_of(spark: SparkSession, sf_dir: str) -> Coded:
    return _stored(spark, sf_dir, "star", ["region", "nation", "customer", "supplier", "orders", "part", "lineitem"], lambda: coded_star(spark, sf_dir))


def _g(run: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(graph_of(spark, sf_dir))


def _t(name: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


#: What is asked of start nodes: functions by the digest of their id, each on its own.
EACH: dict[str, Callable[[Graph], DataFrame]] = {
    "dependents": lambda g: traversal.dependents(g, traversal.start_nodes(g)),
    "expand_hops": lambda g: traversal.expand(g, traversal.start_nodes(g), 2),
    "induced_edges": lambda g: traversal.induced_edges(g, cut_lineage(traversal.expand(g, traversal.start_nodes(g), 2))),
    "related_nodes": lambda g: traversal.related_functions(g, traversal.start_nodes(g)),
}


def _flat_edges(g: Graph) -> DataFrame:
    return g.edges.select("graph_id", "src", "dst", "rel_type", F.col("props.line").alias("line"), F.col("props.is_builtin").alias("is_builtin"))


def _flat_nodes(n: DataFrame) -> DataFrame:
    return n.select("graph_id", "id", F.array_join("labels", ",").alias("labels"), "entity_type", "name", "source_file", "start_line", "end_line", "description")


def _turns(c: DataFrame) -> DataFrame:
    return store.conversation_history(c)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v, v.where(F.col("vec_id") % 100 == 0)


def _topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return vectors.topk(v, q, k)


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the query's label are relevant; read from the label's rows, not from all pairs of a label."""
    e = table(spark, sf_dir, "embeddings")
    hits = _topk(spark, sf_dir, 10)
    q = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")).where("query_id % 100 = 0")
    n = e.groupBy(F.col("label").alias("q_label")).agg(F.count(F.lit(1)).alias("n_relevant"))
    h = hits.join(q, "query_id").join(e.select("vec_id", "label"), "vec_id").join(n, "q_label")
    rel = h.select("query_id", "vec_id", "n_relevant", (F.col("label") == F.col("q_label")).alias("hit"))
    m = rel.join(hits.select("query_id", "vec_id", "rank"), ["query_id", "vec_id"]).groupBy("query_id").agg(F.count_if("hit").alias("n_hits"), F.max("n_relevant").alias("n"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return m.select("query_id", F.round(F.col("n_hits") / 10, 6).alias("precision"), F.round(F.col("n_hits") / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)).cast("double"), 6).alias("reciprocal_rank"))


def _edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edge writes: the last write of each (user, type) wins."""
    e = table(spark, sf_dir, "events")
    none = lambda t: F.lit(None).cast(t)
    new = e.select(F.lit("events").alias("graph_id"), F.concat(F.lit("User:"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("Type:"), "event_type").alias("dst"), F.lit("did-it").alias("rel_type"),
                   F.struct(F.col("event_id").cast("int").alias("line"), none("int").alias("start"), none("int").alias("end"), none("string").alias("module"), none("string").alias("items"), none("boolean").alias("is_builtin")).alias("props"),
                   F.col("event_id").alias("seq"))
    return upsert_edges(new).select("src", "dst", "rel_type", F.col("props.line").alias("line"))


def _node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    none = lambda t: F.lit(None).cast(t)
    new = e.select(F.lit("events").alias("graph_id"), F.concat(F.lit("User:"), F.col("user_id").cast("string")).alias("id"), F.array(F.lit("KGNode"), X.sanitize_label(F.col("event_type"))).alias("labels"), F.col("event_type").alias("entity_type"),
                   F.col("event_type").alias("name"), none("string").alias("source_file"), F.col("event_id").cast("int").alias("start_line"), none("int").alias("end_line"), F.col("props").alias("description"), F.col("event_id").alias("seq"))
    return _flat_nodes(upsert_nodes(new)).select("id", "labels", "entity_type", "start_line", "description")


def _placeholder_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("graph_id"), F.concat(F.lit("PotentialFunction:"), "event_type").alias("id"), F.lit("PotentialFunction").alias("kind"), F.col("event_type").alias("name"), F.col("ts").alias("seen"))
    return upsert_placeholders(e).select("id", "name", "created_at", "last_seen")


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities left after deleting the graphs of users without a name."""
    doomed = table(spark, sf_dir, "graphs").where("user_id is null")
    return store.cascade_delete(table(spark, sf_dir, "entities"), doomed).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.chunk_rows(table(spark, sf_dir, "chunks"))
    return chunking.breakpoint_lines(c.where(F.lower("source_file").endswith(".py")), "id", "text").select("id", F.col("line").cast("int").alias("line"), "reason")


def _chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.coalesce("graph_id", F.lit("none")).alias("graph_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return chunking.chunk_files(d, 60).select("source_file", "chunk_index", "start_line", "end_line", "token_count")


def _prefix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the Python files as they are put together from their chunks."""
    from spanweave.sources.parsing import extract_entities

    c = metrics.chunk_rows(table(spark, sf_dir, "chunks")).where(F.lower("source_file").endswith(".py"))
    f = c.groupBy("graph_id", F.col("source_file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return extract_entities(f).groupBy("graph_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def _judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as verdicts by rule, then read back."""
    t = _turns(table(spark, sf_dir, "conversations")).where("assistant is not null")
    n = F.length("assistant") % 10
    text = F.concat(F.lit("Relevance (1-10): "), n.cast("string"), F.lit("\nFaithfulness: RAG "), n.cast("string"), F.lit(" and LLM "), F.col("pos").cast("string"), F.lit("\nOverall analysis of it: fine\n\nend"))
    t = t.select("conversation_id", "pos", text.alias("v"))
    rag, llm = judge.paired_scores(F.col("v"), "faithfulness")
    return t.select("conversation_id", "pos", judge.metric_score(F.col("v"), "relevance").alias("relevance"), judge.metric_score(F.col("v"), "accuracy").alias("accuracy"), rag.alias("rag"), llm.alias("llm"), judge.winner(rag, llm).alias("winner"), judge.analysis(F.col("v")).alias("analysis"))


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions read from file texts against recorded ones, by graph, file and name."""
    from spanweave.sources.parsing import extract_entities

    c = metrics.chunk_rows(table(spark, sf_dir, "chunks")).where(F.lower("source_file").endswith(".py"))
    f = c.groupBy("graph_id", F.col("source_file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text"))), lambda x: x["text"]), "\n").alias("content"))
    got = extract_entities(f).where("entity_type in ('Function', 'Class')").withColumn("name", F.lower("name"))
    truth = dedup.valid_entities(table(spark, sf_dir, "entities")).where("entity_type in ('Function', 'Class')").withColumn("name", F.lower(F.regexp_extract(F.regexp_replace("name", r"\(.*$", ""), r"([^.]*)$", 1)))
    return evaluation.accuracy(got, truth, ["graph_id", "source_file", "entity_type", "name"])


def _retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval over descriptions: nearest nodes of the question, their neighbourhood and its relations by priority."""
    g = graph_of(spark, sf_dir)
    named = g.nodes.where("description is not null")
    v = cut_lineage(vectors.hash_embedding(named.select("id", F.concat_ws(" ", "name", "description").alias("text")), "id", "text"))
    q = vectors.hash_embedding(spark.createDataFrame([("q", QUESTION)], "id string, text string"), "id", "text").first()["embedding"]
    hits = vectors.topk_one(v, q, 15).withColumnRenamed("vec_id", "id")
    seeds = g.nodes.join(hits, "id").select("graph_id", "id")
    ids = cut_lineage(traversal.expand(g, seeds, 2))
    return traversal.induced_edges(g, ids).orderBy(F.desc("priority"), "source_id", "target_id", "rel_type")


QUERIES: dict[str, Query] = {
    # graph metrics
    "hub_nodes": _g(metrics.hub_nodes),
    "centrality_nodes": _g(metrics.centrality_nodes),
    "node_counts_by_label": _g(metrics.node_counts_by_label),
    "edge_counts_by_type": _g(metrics.edge_counts_by_type),
    "graph_density": _g(lambda g: metrics.graph_density(g).select("graph_id", "n_nodes", "n_edges", F.round("density", 9).alias("density"), F.round("per_node", 6).alias("per_node"))),
    "connected_components": _g(metrics.component_counts),
    "duplicate_keys": _g(lambda g: duplicate_keys(g.nodes)),
    "quality_score": lambda s, d: metrics.quality_score(graph_of(s, d), table(s, d, "chunks")),
    "call_coverage": _g(lambda g: evaluation.call_coverage(g.edges)),
    "schema_adherence": _g(lambda g: evaluation.schema_adherence(g.edges, traversal.WALKED)),
    # traversals
    "class_methods": _g(traversal.class_methods),
    "dependents": _g(EACH["dependents"]),
    "direct_impacts": _g(traversal.direct_impacts),
    "indirect_impacts": _g(traversal.indirect_impacts),
    "test_reach": _g(traversal.test_reach),
    "risk_level": _g(traversal.risk_level),
    "expand_hops": _g(EACH["expand_hops"]),
    "node_details": _g(lambda g: traversal.node_details(g, traversal.expand(g, traversal.start_nodes(g), 1))),
    "induced_edges": _g(EACH["induced_edges"]),
    "related_nodes": _g(EACH["related_nodes"]),
    "similar_names": _g(lambda g: traversal.similar_names(g, traversal.start_nodes(g, "00"))),
    "top_files": _g(traversal.top_files),
    "viz_nodes": _g(traversal.viz_nodes),
    "viz_edges": _g(traversal.viz_edges),
    "keyword_search": _g(lambda g: traversal.keyword_search(g.nodes, QUESTION, ["name", "description"], "id").select("graph_id", "id", "name")),
    "random_edges": _g(traversal.random_edges),
    "insertion_points": _g(changes.insertion_points),
    "relation_lines": _g(lambda g: report.relation_lines(g, g.edges)),
    "schema_probe": _g(report.schema_probe),
    "largest_types": _g(lambda g: report.largest(metrics.entity_distribution(g.nodes), "entity_type", "n", 3)),
    "summary_lines": lambda s, d: report.summary_lines(graph_of(s, d), table(s, d, "chunks")),
    # building the graph
    "entity_dedup": _t("entities", lambda e: dedup.unique_entities(dedup.valid_entities(e)).select("graph_id", "entity_type", "name", "source_file", "id", "seq", "n_records")),
    "entity_dedup_reference": _t("entities", lambda e: dedup.dedup_counts(dedup.valid_entities(e), "reference")),
    "build_nodes": _t("entities", lambda e: _flat_nodes(build_graph(e).nodes)),
    "build_edges": _t("entities", lambda e: _flat_edges(build_graph(e))),
    "entity_extract": _prefix_files,
    "extraction_accuracy": _accuracy,
    "edge_upsert": _edge_upsert,
    "node_upsert": _node_upsert,
    "placeholder_upsert": _placeholder_upsert,
    "cascade_delete": _delete,
    # vectors
    "vector_topk": _topk,
    "vector_min_merge": lambda s, d: vectors.min_merge(_topk(s, d)),
    "precision_recall_mrr": _relevant,
    # text
    "tokenize_query": lambda s, d: _turns(table(s, d, "conversations")).select("conversation_id", "pos", F.array_join(X.keywords(F.col("user")), " ").alias("words")),
    "change_type": lambda s, d: _turns(table(s, d, "conversations")).select("conversation_id", "pos", X.change_type(F.col("user")).alias("change")),
    "intent": lambda s, d: _turns(table(s, d, "conversations")).select("conversation_id", "pos", X.keyword_intent(F.col("user")).alias("intent"), X.intent_label(F.col("user")).alias("label")),
    "dynamic_hops": lambda s, d: _turns(table(s, d, "conversations")).select("conversation_id", "pos", X.dynamic_hops(F.col("user"), X.keyword_intent(F.col("user")), F.lit(2)).alias("hops")),
    "expanded_query": lambda s, d: _turns(table(s, d, "conversations")).select("conversation_id", "pos", X.expanded_query(F.col("user"), F.col("assistant")).alias("q")),
    "sanitize_ids": _t("entities", lambda e: e.select("rec_id", X.sanitize_id(F.col("name")).alias("id_part"), X.sanitize_name(F.col("name")).alias("name_part"), X.sanitize_path(F.col("source_file")).alias("path_part"), X.sanitize_label(F.col("entity_type")).alias("label"), X.sanitize_relationship(F.col("entity_type")).alias("rel"), X.last_segment(F.col("name")).alias("simple"))),
    "clean_paths": _t("entities", lambda e: e.select("rec_id", X.clean_path(F.col("source_file")).alias("path"), X.module_path(F.col("source_file")).alias("module"))),
    "entity_text": _t("entities", lambda e: e.select("rec_id", X.entity_text(F.col("entity_type"), F.col("name"), F.col("source_file"), F.col("start_line"), F.col("parent_type"), F.col("parent_name"), X.default_description(F.col("description"), F.col("entity_type"), F.col("name"))).alias("text"), X.gated_description(F.col("description"), F.col("entity_type"), F.col("name")).alias("short"))),
    "naming_vote": _t("chunks", lambda c: changes.naming_votes(c, key="id")),
    "error_vote": _t("chunks", lambda c: changes.error_votes(c, key="id")),
    "doc_vote": _t("chunks", lambda c: changes.doc_votes(c, key="id")),
    "judge_scores": _judge,
    "compare_answers": lambda s, d: judge.compare_answers(_judge(s, d).select(F.concat_ws("/", "conversation_id", F.col("pos").cast("string")).alias("k"), F.concat(F.lit("faithfulness RAG "), F.col("rag").cast("string"), F.lit(" LLM "), F.col("llm").cast("string")).alias("v")), "k", "v", ["faithfulness"]),
    "answer_overlap": _t("conversations", lambda c: evaluation.overlap_scores(_turns(c).select(F.concat_ws("/", "conversation_id", F.col("pos").cast("string")).alias("k"), "user", "assistant"), "k", "assistant", "user", 4)),
    "exact_match": _t("conversations", lambda c: _turns(c).select("conversation_id", "pos", evaluation.exact_match(F.col("user"), F.col("assistant")).alias("same"))),
    "property_bag": _t("entities", lambda e: e.select("rec_id", F.size(C.property_bag(e, "id", "snippet")).alias("n_properties"), C.lookup(C.property_bag(e, "id", "snippet"), "name", "none").alias("name"), C.lookup(C.property_bag(e, "id", "snippet"), "imported_items", "[]").alias("items"))),
    "zipped_turns": _t("conversations", lambda c: C.zipped_rows(store.unique_rows(c, "conversation_id").select("conversation_id", F.col("history.user").alias("u"), F.col("history.assistant").alias("a")), "u", "a").withColumn("ord", F.col("ord").cast("long"))),
    # chunks and entities
    "token_stats": _t("chunks", metrics.token_stats),
    "token_histogram": _t("chunks", metrics.token_histogram),
    "chunks_per_file": _t("chunks", metrics.chunks_per_file),
    "overlap_lines": _t("chunks", metrics.overlap_lines),
    "whitespace_tokens": _t("chunks", metrics.whitespace_tokens),
    "breakpoints": _breaks,
    "chunk_lines": _chunk_lines,
    "entity_distribution": _t("entities", metrics.entity_distribution),
    "description_stats": _g(metrics.description_stats),
    "dedup_longest": _t("documents", lambda d: dedup.keep_best(d.where("text is not null").select("source", "lang", "doc_id", F.length("text").alias("n")), ["source", "lang"], -F.col("n"), F.col("doc_id"))),
    "dedup_first": _t("events", lambda e: dedup.keep_best(e.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))),
    # conversations and registry
    "conversation_list": _t("conversations", store.conversation_list),
    "conversation_history": _t("conversations", _turns),
    "conversation_append": lambda s, d: (lambda c: store.append_turn(c, c.select("conversation_id", F.lit("next?").alias("user"), F.lit("done").alias("assistant"), F.lit("9999").alias("timestamp"))).select("conversation_id", F.size("history").cast("long").alias("n_turns"), F.element_at("history", -1)["user"].alias("last_user")))(store.unique_rows(table(s, d, "conversations"), "conversation_id")),
    "accessible_conversations": lambda s, d: store.accessible(store.unique_rows(table(s, d, "conversations"), "conversation_id"), table(s, d, "graphs")).select("conversation_id", "graph_id"),
    "graphs_by_user": _t("graphs", lambda g: g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_graphs"), F.max(X.day_month_year(F.col("created_at"))).alias("a_day"))),
    "event_windows": _t("events", streams.event_windows),
    "event_sessions": _t("events", streams.session_counts),
    "retrieve_context": _retrieve,
    "part_similarity": _t("part", lambda p: p.select("p_partkey", F.round(jaro_winkler("p_name", "p_type"), 9).alias("similarity"))),
}

#: Queries that also run on the graph over the star schema, whose chains of calls are three long.
ON_STAR = ["hub_nodes", "centrality_nodes", "node_counts_by_label", "edge_counts_by_type", "graph_density", "class_methods", "dependents", "direct_impacts", "indirect_impacts", "test_reach", "risk_level", "expand_hops", "induced_edges", "related_nodes", "top_files", "viz_edges", "call_coverage"]
_ON_GRAPH: dict[str, Callable[[Graph], DataFrame]] = {
    "hub_nodes": metrics.hub_nodes, "centrality_nodes": metrics.centrality_nodes, "node_counts_by_label": metrics.node_counts_by_label, "edge_counts_by_type": metrics.edge_counts_by_type,
    "graph_density": lambda g: metrics.graph_density(g).select("graph_id", "n_nodes", "n_edges", F.round("density", 9).alias("density"), F.round("per_node", 6).alias("per_node")),
    "connected_components": metrics.component_counts, "class_methods": traversal.class_methods, "direct_impacts": traversal.direct_impacts,
    "indirect_impacts": traversal.indirect_impacts, "test_reach": traversal.test_reach, "risk_level": traversal.risk_level, 
    "top_files": traversal.top_files,
    "viz_edges": traversal.viz_edges, "call_coverage": lambda g: evaluation.call_coverage(g.edges), **EACH,
}


def _star(run: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(star_of(spark, sf_dir).graph())


QUERIES |= {f"star_{k}": _star(_ON_GRAPH[k]) for k in ON_STAR}
#: Those that make pairs over two steps do so on codes.
QUERIES |= {f"star_{f.__name__}": lambda spark, sf_dir, f=f: f(star_of(spark, sf_dir)) for f in (stargraph.centrality_nodes, stargraph.indirect_impacts, stargraph.risk_level)}

# ------------------------------------------------------------------------------------------------------- SQL
_BUILTIN_LIST = ", ".join(f"'{b}'" for b in X.BUILTINS)


def _path_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(translate(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '^.*?(repos/)', '\1')"


def _file_id_sql(g: str, p: str) -> str:
    return rf"'File:' || {g} || ':' || regexp_replace({p}, '[^\p{{L}}\p{{N}}_.\-/]', '_', 'g')"


def _id_sql(c: str) -> str:
    return rf"coalesce(regexp_replace({c}, '[^\p{{L}}\p{{N}}_.\-]', '_', 'g'), 'unnamed')"


UNIQUE = rf"""
e AS (SELECT * EXCLUDE (id) REPLACE ({_path_sql("source_file")} AS source_file, trim(name) AS name), rec_id AS seq FROM entities
      WHERE entity_type IS NOT NULL AND name IS NOT NULL AND graph_id IS NOT NULL),
k AS (SELECT *, md5(concat_ws(chr(1), graph_id, entity_type, name, coalesce(source_file, ''),
        CASE WHEN entity_type IN ('Function', 'Class') THEN coalesce(parent_name, '')
             WHEN entity_type = 'Call' THEN coalesce(parent_type, '') || '|' || coalesce(parent_name, '') || '|' || coalesce(CAST(start_byte AS VARCHAR), '')
             WHEN entity_type = 'Import' THEN ''
             WHEN entity_type = 'ImportFrom' THEN coalesce(array_to_string(list_sort(imported_items), ','), '')
             ELSE coalesce(CAST(start_byte AS VARCHAR), '') END)) AS key FROM e),
r AS (SELECT *, count(*) OVER (PARTITION BY key) AS n_records, row_number() OVER (PARTITION BY key ORDER BY
        CASE WHEN entity_type IN ('Function', 'Class') THEN -coalesce(length(snippet), 0) ELSE 0 END, seq) AS rn FROM k),
u AS MATERIALIZED (SELECT *, regexp_replace(concat_ws('_', entity_type, name), '[^\p{{L}}\p{{N}}_\-]', '_', 'g') || ':' || md5(key) AS id FROM r WHERE rn = 1)"""

#: What traversals read, over CTEs `nodes` and `edges`.
WALKS = """nb AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges),
fn AS (SELECT * FROM nodes WHERE entity_type IN ('Function', 'Class')),
cl AS MATERIALIZED (SELECT graph_id, src, dst FROM edges WHERE rel_type = 'CALLS'),
seeds AS (SELECT graph_id, id, id AS seed_id FROM nodes WHERE entity_type = 'Function' AND starts_with(md5(id), '0')),
wk AS (SELECT DISTINCT graph_id, src, dst FROM edges WHERE rel_type IN ('CONTAINS', 'CONTAINS_METHOD', 'CALLS', 'IMPORTS')),
x1 AS (SELECT DISTINCT wk.graph_id, s.seed_id, wk.dst AS id FROM seeds s JOIN wk ON wk.graph_id = s.graph_id AND wk.src = s.id),
x2 AS (SELECT DISTINCT wk.graph_id, s.seed_id, wk.dst AS id FROM x1 s JOIN wk ON wk.graph_id = s.graph_id AND wk.src = s.id),
ex AS MATERIALIZED (SELECT graph_id, seed_id, id, min(depth) AS depth FROM (SELECT graph_id, seed_id, id, 0 AS depth FROM seeds UNION ALL SELECT graph_id, seed_id, id, 1 FROM x1 UNION ALL SELECT graph_id, seed_id, id, 2 FROM x2) GROUP BY ALL),
direct AS (SELECT cl.graph_id, cl.dst AS target_id, cl.src AS caller_id FROM cl JOIN fn ON fn.graph_id = cl.graph_id AND fn.id = cl.dst),
indirect AS (SELECT DISTINCT d.graph_id, d.target_id, c.src AS caller_id FROM direct d JOIN cl c ON c.graph_id = d.graph_id AND c.dst = d.caller_id
    WHERE NOT EXISTS (SELECT 1 FROM cl x WHERE x.graph_id = d.graph_id AND x.src = c.src AND x.dst = d.target_id))"""

GRAPH = rf"""
{UNIQUE},
lk AS (SELECT graph_id, source_file, name, entity_type, count(*) AS n, min(id) AS def_id FROM u WHERE entity_type IN ('Function', 'Class') GROUP BY ALL),
lc AS (SELECT graph_id, source_file, name, count(*) AS n, min(id) AS def_id FROM u WHERE entity_type IN ('Function', 'Class') GROUP BY ALL),
lm AS (SELECT graph_id, source_file, name, min(id) AS def_id FROM u WHERE entity_type = 'Class' GROUP BY ALL HAVING count(*) = 1),
calls AS MATERIALIZED (SELECT c.graph_id,
    CASE WHEN c.parent_type IS NULL OR c.parent_name IS NULL THEN {_file_id_sql("c.graph_id", "c.source_file")} WHEN lk.n = 1 THEN lk.def_id ELSE c.id END AS src,
    CASE WHEN lc.n = 1 THEN lc.def_id ELSE CASE WHEN c.name IN ({_BUILTIN_LIST}) THEN 'BuiltinFunction' ELSE 'PotentialFunction' END || ':' || c.graph_id || ':' || {_id_sql("c.name")} END AS dst,
    'CALLS' AS rel_type, c.start_line AS line, CASE WHEN coalesce(lc.n = 1, false) THEN NULL ELSE c.name IN ({_BUILTIN_LIST}) END AS is_builtin,
    CASE WHEN coalesce(lc.n = 1, false) THEN NULL ELSE c.name END AS placeholder, CASE WHEN c.name IN ({_BUILTIN_LIST}) THEN 'BuiltinFunction' ELSE 'PotentialFunction' END AS kind, c.seq
  FROM u c LEFT JOIN lk ON lk.graph_id = c.graph_id AND lk.source_file = c.source_file AND lk.name = c.parent_name AND lk.entity_type = c.parent_type
           LEFT JOIN lc ON lc.graph_id = c.graph_id AND lc.source_file = c.source_file AND lc.name = split_part(c.name, '.', -1)
  WHERE c.entity_type = 'Call'),
w AS (SELECT graph_id, {_file_id_sql("graph_id", "source_file")} AS src, id AS dst, 'CONTAINS' AS rel_type, NULL AS line, NULL AS is_builtin, seq FROM u
  UNION ALL SELECT u.graph_id, lm.def_id, u.id, 'CONTAINS_METHOD', u.start_line, NULL, u.seq FROM u JOIN lm ON lm.graph_id = u.graph_id AND lm.source_file = u.source_file AND lm.name = u.parent_name WHERE u.entity_type = 'Function' AND u.parent_type = 'Class'
  UNION ALL SELECT graph_id, {_file_id_sql("graph_id", "source_file")}, id, 'IMPORTS', start_line, NULL, seq FROM u WHERE entity_type IN ('Import', 'ImportFrom')
  UNION ALL SELECT graph_id, src, dst, rel_type, line, is_builtin, seq FROM calls),
edges AS MATERIALIZED (SELECT graph_id, src, dst, rel_type, arg_max(struct_pack(line := line, b := is_builtin), seq) AS p FROM w WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL),
nodes AS MATERIALIZED (
  SELECT graph_id, id, ['KGNode', entity_type] AS labels, entity_type, name, source_file, start_line, end_line, coalesce(description, 'Default description for ' || entity_type || ' ''' || name || '''.') AS description FROM u
  UNION ALL SELECT DISTINCT graph_id, {_file_id_sql("graph_id", "source_file")}, ['KGNode', 'File'], 'File', split_part(source_file, '/', -1), source_file, NULL, NULL, NULL FROM u WHERE source_file IS NOT NULL
  UNION ALL SELECT graph_id, dst, ['KGNode', kind], kind, min(placeholder), NULL, NULL, NULL, NULL FROM calls WHERE placeholder IS NOT NULL GROUP BY graph_id, dst, kind),
{WALKS}"""

#: The graph over the star-schema tables (plans/stargraph.py).
STAR = rf"""
n AS (SELECT 'File:' || r_regionkey AS id, 'File' AS t, r_name AS name, CAST(NULL AS VARCHAR) AS source_file FROM region
  UNION ALL SELECT 'Class:' || n_nationkey, 'Class', n_name, 'region_' || n_regionkey FROM nation
  UNION ALL SELECT 'Function:c' || c_custkey, 'Function', c_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'test_' ELSE '' END || lower(c_mktsegment) FROM customer
  UNION ALL SELECT 'Function:s' || s_suppkey, 'Function', s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'Call:' || o_orderkey, 'Call', o_orderpriority, 'orders' FROM orders
  UNION ALL SELECT 'PotentialFunction:' || p_partkey, 'PotentialFunction', p_name, NULL FROM part),
nodes AS MATERIALIZED (SELECT 'star' AS graph_id, id, ['KGNode', t] AS labels, t AS entity_type, name, source_file, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line, CAST(NULL AS VARCHAR) AS description FROM n),
w AS (SELECT 'File:' || n_regionkey AS src, 'Class:' || n_nationkey AS dst, 'CONTAINS' AS rel_type FROM nation
  UNION ALL SELECT 'Class:' || c_nationkey, 'Function:c' || c_custkey, 'CONTAINS_METHOD' FROM customer UNION ALL SELECT 'Class:' || s_nationkey, 'Function:s' || s_suppkey, 'CONTAINS_METHOD' FROM supplier
  UNION ALL SELECT 'Function:c' || o_custkey, 'Call:' || o_orderkey, 'CALLS' FROM orders
  UNION ALL SELECT 'Call:' || l_orderkey, 'PotentialFunction:' || l_partkey, 'CALLS' FROM lineitem
  UNION ALL SELECT 'PotentialFunction:' || l_partkey, 'Function:s' || l_suppkey, 'CALLS' FROM lineitem
  UNION ALL SELECT 'File:' || (CAST(substring(p_brand, 7, 1) AS INTEGER) - 1), 'PotentialFunction:' || p_partkey, 'IMPORTS' FROM part),
edges AS MATERIALIZED (SELECT DISTINCT 'star' AS graph_id, w.src, w.dst, w.rel_type FROM w SEMI JOIN nodes a ON a.id = w.src SEMI JOIN nodes b ON b.id = w.dst),
{WALKS}"""

CHUNKS = rf"""
c0 AS (SELECT graph_id, id, text, {_path_sql("metadata.source_file")} AS source_file, metadata.chunk_index AS chunk_index, metadata.start_line AS start_line, metadata.end_line AS end_line, indexed_at FROM chunks),
c AS (SELECT *, CAST(floor(coalesce(length(text), 0) / 4) AS INTEGER) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, id ORDER BY indexed_at DESC NULLS LAST, source_file DESC NULLS LAST) AS rn FROM c0) WHERE rn = 1)"""

TURNS = """
h AS (SELECT conversation_id, min(history) AS history FROM conversations WHERE history IS NOT NULL GROUP BY conversation_id),
hi AS (SELECT conversation_id, history, unnest(generate_series(1, len(history))) AS i FROM h),
t AS (SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY history[i].timestamp NULLS FIRST, i) - 1 AS BIGINT) AS pos, history[i].timestamp AS ts, history[i]."user" AS "user", history[i].assistant AS assistant FROM hi)"""

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_INTENT = r"""CASE WHEN regexp_matches(lower("user"), '\b(add|create|implement|introduce|write)\b.*\b(function|method|class|feature|endpoint|test)') THEN 'function_request'
  WHEN regexp_matches(lower("user"), '\b(modify|change|refactor|fix|rename|remove|delete|replace|update)\b') THEN 'change_request'
  WHEN regexp_matches(lower("user"), '\b(how does|how do|explain|what does .* do|why does|where is|which functions)\b') THEN 'code_explanation' ELSE 'general_question' END"""
_CHANGE = """CASE WHEN contains(lower("user"), 'add method') OR contains(lower("user"), 'new method') THEN 'add_method' WHEN contains(lower("user"), 'modify function') OR contains(lower("user"), 'change function') THEN 'modify_function'
  WHEN contains(lower("user"), 'add feature') OR contains(lower("user"), 'new feature') THEN 'add_feature' WHEN contains(lower("user"), 'fix bug') OR contains(lower("user"), 'fix issue') OR contains(lower("user"), 'fix error') THEN 'fix_bug'
  WHEN contains(lower("user"), 'refactor') OR contains(lower("user"), 'clean up') THEN 'refactor' ELSE 'other' END"""
_L2 = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
_TOPK = """tk AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM (SELECT q.vec_id AS query_id, v.vec_id, {l2} AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round({l2}, 12), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= {k})"""


def _on(prefix: str, body: str) -> str:
    return f"WITH {prefix.strip()}\n{body}"


_SCORES = """
d AS (SELECT n.graph_id, n.n_nodes, coalesce(m.n_edges, 0) AS n_edges FROM (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY 1) n LEFT JOIN (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY 1) m USING (graph_id)),
dd AS (SELECT *, CASE WHEN n_nodes > 1 THEN n_edges / (CAST(n_nodes AS DOUBLE) * (n_nodes - 1)) ELSE 0.0 END AS density, CAST(n_edges AS DOUBLE) / n_nodes AS per_node FROM d),
ds AS (SELECT graph_id, count(*) AS n_entities, min(length(description)) AS min_length, max(length(description)) AS max_length, round(avg(length(description)), 6) AS avg_length,
    count(*) FILTER (starts_with(description, 'Default description for')) AS n_default, round(count(*) FILTER (starts_with(description, 'Default description for')) * CAST(100 AS DOUBLE) / count(*), 6) AS pct_default FROM nodes WHERE description IS NOT NULL GROUP BY 1)"""
_PERWORDS = r"CASE WHEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END"
_LINES = r"""
src AS (SELECT id, text FROM c WHERE ends_with(lower(source_file), '.py') AND text IS NOT NULL),
l0 AS (SELECT id, string_split(text, chr(10)) AS ls FROM src), l1 AS (SELECT id, ls, unnest(generate_series(1, len(ls))) AS i FROM l0),
l2 AS (SELECT id, CAST(i - 1 AS INTEGER) AS line, ls[i] AS s, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS bare FROM l1),
l3 AS (SELECT *, regexp_matches(s, '^\s*(import\s|from\s+\S+\s+import\b|class\s|def\s|async\s+def\s|@)') AS structure, starts_with(bare, '#') AS comment,
   CASE WHEN bare <> '' AND NOT starts_with(bare, '#') THEN length(s) - length(regexp_replace(s, '^\s+', '')) END AS code FROM l2),
l4 AS (SELECT *, min(CASE WHEN structure THEN line END) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead, lag(code) OVER (PARTITION BY id ORDER BY line) AS before FROM l3)"""

ORACLE_SQL: dict[str, str] = {
    "hub_nodes": _on(GRAPH, """SELECT h.graph_id, h.id, h.n_neighbours, n.name, n.entity_type FROM (SELECT graph_id, src AS id, count(*) AS n_neighbours, row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, src) AS r FROM nb GROUP BY graph_id, src) h
        JOIN nodes n ON n.graph_id = h.graph_id AND n.id = h.id WHERE r <= 10"""),
    "centrality_nodes": _on(GRAPH, """, n1 AS (SELECT graph_id, src, count(*) AS n FROM nb GROUP BY ALL), n2 AS (SELECT a.graph_id, a.src, count(DISTINCT b.dst) AS n FROM nb a JOIN fn ON fn.graph_id = a.graph_id AND fn.id = a.src JOIN nb b ON b.graph_id = a.graph_id AND b.src = a.dst AND b.dst <> a.src GROUP BY ALL),
        s AS (SELECT fn.graph_id, fn.id, coalesce(n1.n, 0) AS n_one, coalesce(n2.n, 0) AS n_two, coalesce(n1.n, 0) + coalesce(n2.n, 0) AS centrality FROM fn LEFT JOIN n1 ON n1.graph_id = fn.graph_id AND n1.src = fn.id LEFT JOIN n2 ON n2.graph_id = fn.graph_id AND n2.src = fn.id)
        SELECT graph_id, id, n_one, n_two, centrality FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY centrality DESC, id) AS r FROM s) WHERE r <= 10"""),
    "node_counts_by_label": _on(GRAPH, "SELECT graph_id, label, count(*) AS n FROM (SELECT graph_id, unnest(labels) AS label FROM nodes) GROUP BY ALL"),
    "edge_counts_by_type": _on(GRAPH, "SELECT graph_id, rel_type, count(*) AS n FROM edges GROUP BY ALL"),
    "graph_density": _on(GRAPH + "," + _SCORES, "SELECT graph_id, n_nodes, n_edges, round(density, 9) AS density, round(per_node, 6) AS per_node FROM dd"),
    "connected_components": "WITH RECURSIVE " + GRAPH.strip() + """, rc AS (SELECT graph_id, id, id AS root FROM nodes UNION SELECT nb.graph_id, nb.dst, rc.root FROM rc JOIN nb ON nb.graph_id = rc.graph_id AND nb.src = rc.id WHERE rc.root < nb.dst),
        cc AS (SELECT graph_id, id, min(root) AS component FROM rc GROUP BY ALL), cn AS (SELECT graph_id, component, count(*) AS n FROM cc GROUP BY ALL)
        SELECT graph_id, count(*) AS n_components, max(n) AS largest FROM cn GROUP BY graph_id""",
    "duplicate_keys": _on(GRAPH, "SELECT graph_id, id, count(*) AS n FROM nodes GROUP BY ALL HAVING count(*) > 1"),
    "quality_score": _on(GRAPH + "," + _SCORES + "," + CHUNKS, """, s AS (SELECT dd.graph_id, least(25.0, greatest(0.0, per_node * 8)) AS a, use, least(25.0, greatest(0.0, use * 36 - 1)) AS b, least(25.0, greatest(0.0, 25 * (1 - pct_default / 100))) AS e, least(25.0, greatest(0.0, density * 25000)) AS f, per_node, pct_default
          FROM (SELECT dd.*, coalesce(t.use, 0) AS use, coalesce(ds.pct_default, 100) AS pct_default FROM dd LEFT JOIN (SELECT graph_id, round(avg(tokens), 6) / 1050 AS use FROM c GROUP BY 1) t USING (graph_id) LEFT JOIN ds USING (graph_id)) dd)
        SELECT graph_id, round(a, 6) AS graph_score, round(b, 6) AS chunk_score, round(e, 6) AS entity_score, round(f, 6) AS connectivity_score, round(a + b + e + f, 6) AS overall,
          CASE WHEN a + b + e + f < 40 THEN 'poor' WHEN a + b + e + f < 70 THEN 'fair' ELSE 'good' END AS grade, CASE WHEN per_node < 1 THEN 'poor' WHEN per_node < 3 THEN 'fair' ELSE 'good' END AS graph_grade,
          CASE WHEN use < 0.5 THEN 'poor' WHEN use < 0.7 THEN 'fair' ELSE 'good' END AS chunk_grade, CASE WHEN pct_default > 80 THEN 'poor' WHEN pct_default > 20 THEN 'fair' ELSE 'good' END AS entity_grade FROM s"""),
    "call_coverage": _on(GRAPH, "SELECT graph_id, count(*) AS n_calls, count(*) FILTER (NOT (starts_with(dst, 'PotentialFunction:') OR starts_with(dst, 'BuiltinFunction:'))) AS n_resolved, round(count(*) FILTER (NOT (starts_with(dst, 'PotentialFunction:') OR starts_with(dst, 'BuiltinFunction:'))) / count(*), 6) AS coverage FROM edges WHERE rel_type = 'CALLS' GROUP BY 1"),
    "schema_adherence": _on(GRAPH, "SELECT graph_id, round(count(*) FILTER (rel_type IN ('CONTAINS', 'CONTAINS_METHOD', 'CALLS', 'IMPORTS')) / count(*), 6) AS adherence FROM edges GROUP BY 1"),
    "class_methods": _on(GRAPH, "SELECT e.graph_id, e.src AS class_id, e.dst AS method_id, n.name AS method, n.start_line, n.end_line FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.id = e.dst WHERE e.rel_type = 'CONTAINS_METHOD'"),
    "dependents": _on(GRAPH, """, p AS (SELECT DISTINCT c.graph_id, s.seed_id, c.src AS id FROM cl c JOIN seeds s ON s.graph_id = c.graph_id AND s.id = c.dst)
        SELECT p.graph_id, seed_id, p.id, n.name, n.entity_type FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, seed_id ORDER BY id) AS r FROM p) p JOIN nodes n ON n.graph_id = p.graph_id AND n.id = p.id WHERE r <= 10"""),
    "direct_impacts": _on(GRAPH, "SELECT d.graph_id, target_id, caller_id, n.name, n.entity_type AS type, n.source_file, n.start_line FROM direct d JOIN nodes n ON n.graph_id = d.graph_id AND n.id = d.caller_id"),
    "indirect_impacts": _on(GRAPH, "SELECT * FROM indirect"),
    "test_reach": _on(GRAPH, """, s2 AS (SELECT DISTINCT d.graph_id, d.target_id, c.src AS caller_id FROM direct d JOIN cl c ON c.graph_id = d.graph_id AND c.dst = d.caller_id), s3 AS (SELECT DISTINCT d.graph_id, d.target_id, c.src AS caller_id FROM s2 d JOIN cl c ON c.graph_id = d.graph_id AND c.dst = d.caller_id),
        a AS (SELECT * FROM direct UNION SELECT * FROM s2 UNION SELECT * FROM s3)
        SELECT graph_id, target_id, string_agg(source_file, ',' ORDER BY source_file) AS test_files FROM (SELECT DISTINCT a.graph_id, a.target_id, n.source_file FROM a JOIN nodes n ON n.graph_id = a.graph_id AND n.id = a.caller_id WHERE contains(n.source_file, 'test')) GROUP BY ALL"""),
    "risk_level": _on(GRAPH, """, a AS (SELECT graph_id, target_id, count(*) AS n FROM direct GROUP BY ALL), b AS (SELECT graph_id, target_id, count(*) AS n FROM indirect GROUP BY ALL),
        s AS (SELECT fn.graph_id, fn.id AS target_id, coalesce(a.n, 0) AS n_direct, coalesce(b.n, 0) AS n_indirect FROM fn LEFT JOIN a ON a.graph_id = fn.graph_id AND a.target_id = fn.id LEFT JOIN b ON b.graph_id = fn.graph_id AND b.target_id = fn.id)
        SELECT *, CAST(n_direct + 0.5 * n_indirect AS DOUBLE) AS score, CASE WHEN n_direct + 0.5 * n_indirect > 20 THEN 'high' WHEN n_direct + 0.5 * n_indirect > 5 THEN 'medium' ELSE 'low' END AS risk FROM s"""),
    "expand_hops": _on(GRAPH, """SELECT graph_id, seed_id, id, depth FROM ex"""),
    "node_details": _on(GRAPH, """SELECT e.graph_id, e.seed_id, n.id, array_to_string(labels, ',') AS labels, name, description, CAST(NULL AS VARCHAR) AS docstring, CAST(NULL AS VARCHAR) AS type, source_file, start_line, end_line FROM nodes n JOIN ex e ON e.graph_id = n.graph_id AND e.id = n.id WHERE e.depth <= 1"""),
    "induced_edges": _on(GRAPH, """, dg AS (SELECT graph_id, id, count(*) AS degree FROM (SELECT graph_id, src AS id FROM edges UNION ALL SELECT graph_id, dst FROM edges) GROUP BY ALL)
        SELECT e.graph_id, a.seed_id, e.src AS source_id, e.rel_type, dg.degree, e.dst AS target_id, CASE e.rel_type WHEN 'CONTAINS_METHOD' THEN 5 WHEN 'CALLS' THEN 4 WHEN 'CONTAINS' THEN 3 WHEN 'IMPORTS' THEN 2 ELSE 1 END AS priority
        FROM edges e JOIN ex a ON a.graph_id = e.graph_id AND a.id = e.src JOIN ex b ON b.graph_id = e.graph_id AND b.id = e.dst AND b.seed_id = a.seed_id JOIN dg ON dg.graph_id = e.graph_id AND dg.id = e.src"""),
    "related_nodes": _on(GRAPH, """, rb AS MATERIALIZED (SELECT graph_id, src, dst FROM edges WHERE rel_type IN ('CALLS', 'CONTAINS', 'IMPORTS') UNION SELECT graph_id, dst, src FROM edges WHERE rel_type IN ('CALLS', 'CONTAINS', 'IMPORTS')),
        a AS (SELECT DISTINCT rb.graph_id, s.seed_id, rb.dst AS id FROM seeds s JOIN rb ON rb.graph_id = s.graph_id AND rb.src = s.id), b AS (SELECT DISTINCT rb.graph_id, s.seed_id, rb.dst AS id FROM a s JOIN rb ON rb.graph_id = s.graph_id AND rb.src = s.id),
        i AS (SELECT * FROM (SELECT * FROM a UNION SELECT * FROM b) WHERE id <> seed_id)
        SELECT graph_id, seed_id, id, name, source_file FROM (SELECT i.graph_id, i.seed_id, n.id, n.name, n.source_file, row_number() OVER (PARTITION BY i.graph_id, i.seed_id ORDER BY n.id) AS r FROM i JOIN nodes n ON n.graph_id = i.graph_id AND n.id = i.id WHERE n.entity_type = 'Function') WHERE r <= 15"""),
    "similar_names": _on(GRAPH, """, s AS (SELECT n.graph_id AS sg, n.id AS seed_id, n.name AS seed_name, n.entity_type FROM nodes n WHERE n.entity_type = 'Function' AND starts_with(md5(n.id), '00') AND n.name IS NOT NULL)
        SELECT seed_id, seed_name, id, name, entity_type, graph_id FROM (SELECT s.seed_id, s.seed_name, n.id, n.name, n.entity_type, n.graph_id, row_number() OVER (PARTITION BY s.sg, s.seed_id ORDER BY n.id, n.graph_id) AS r
          FROM nodes n JOIN s ON s.entity_type = n.entity_type AND s.seed_id <> n.id WHERE n.name IS NOT NULL AND (contains(n.name, s.seed_name) OR contains(s.seed_name, n.name) OR jaro_winkler_similarity(s.seed_name, n.name) > 0.7)) WHERE r <= 10"""),
    "top_files": _on(GRAPH, """, a AS (SELECT graph_id, src, count(DISTINCT dst) AS n FROM edges WHERE rel_type = 'CONTAINS' GROUP BY ALL)
        SELECT graph_id, id, name, n_children FROM (SELECT n.graph_id, n.id, n.name, coalesce(a.n, 0) AS n_children, row_number() OVER (PARTITION BY n.graph_id ORDER BY coalesce(a.n, 0) DESC, n.id) AS r FROM nodes n LEFT JOIN a ON a.graph_id = n.graph_id AND a.src = n.id WHERE n.entity_type = 'File') WHERE r <= 5"""),
    "viz_nodes": _on(GRAPH, """SELECT graph_id, id, coalesce(name, 'None') || chr(10) || '(' || coalesce(entity_type, 'Unknown') || ')' AS label, 'File: ' || coalesce(source_file, 'N/A') || chr(10) || 'Line: ' || coalesce(CAST(start_line AS VARCHAR), 'N/A') || chr(10) || coalesce(description, 'N/A') AS title
        FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS r FROM nodes) WHERE r <= 500"""),
    "viz_edges": _on(GRAPH, "SELECT graph_id, 'edge_' || CAST(r - 1 AS VARCHAR) AS edge_id, src AS from_id, dst AS to_id, rel_type AS label, 'Relationship: ' || rel_type AS title FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst, rel_type) AS r FROM edges) WHERE r <= 500"),
    "keyword_search": _on(GRAPH, f"""SELECT graph_id, id, name FROM nodes WHERE len(list_filter(list_distinct(list_filter(regexp_extract_all(lower('{QUESTION}'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP}))), lambda w: coalesce(contains(lower(name), w), false) OR coalesce(contains(lower(description), w), false))) > 0 ORDER BY id LIMIT 50"""),
    "random_edges": _on(GRAPH, """, s AS (SELECT graph_id, id FROM (SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY md5(concat_ws('#', '7', id)), id) AS r FROM nodes) WHERE r <= 100),
        d AS (SELECT DISTINCT e.graph_id, s.id, e.src, e.dst FROM edges e JOIN s ON s.graph_id = e.graph_id AND (s.id = e.src OR s.id = e.dst))
        SELECT DISTINCT graph_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, id ORDER BY src, dst) AS r FROM d) WHERE r <= 5"""),
    "relation_lines": _on(GRAPH, """, ee AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY CASE rel_type WHEN 'CONTAINS_METHOD' THEN 5 WHEN 'CALLS' THEN 4 WHEN 'CONTAINS' THEN 3 WHEN 'IMPORTS' THEN 2 ELSE 1 END DESC, src, dst, rel_type) AS ord FROM edges),
        s AS (SELECT graph_id, id, coalesce(name, id) || ' (' || CASE WHEN entity_type IN ('Function', 'Class', 'Call', 'Import') THEN entity_type ELSE 'KGNode' END || ')' AS shown FROM nodes)
        SELECT e.graph_id, CAST(ord AS INTEGER) AS ord, '- ' || a.shown || ' -[' || rel_type || CASE WHEN rel_type = 'CONTAINS_METHOD' THEN CASE WHEN e.p.line IS NULL THEN '' ELSE ' {line: ' || e.p.line || '}' END
          WHEN rel_type = 'CALLS' THEN CASE WHEN e.p.line IS NULL AND e.p.b IS NULL THEN '' ELSE ' {' || concat_ws(', ', 'line: ' || e.p.line, 'is_builtin: ' || e.p.b) || '}' END
          WHEN rel_type = 'CONTAINS' THEN CASE WHEN x.start_line IS NULL AND x.end_line IS NULL THEN '' ELSE ' {' || concat_ws(', ', 'start: ' || x.start_line, 'end: ' || x.end_line) || '}' END
          ELSE ' {' || concat_ws(', ', 'line: ' || x.start_line, 'module: ' || CASE WHEN length(coalesce(x.module_name, x.name)) > 50 THEN substring(coalesce(x.module_name, x.name), 1, 50) || '...' ELSE coalesce(x.module_name, x.name) END, 'items: ' || CASE WHEN length(substring(CAST(to_json(x.imported_items) AS VARCHAR), 1, 1000)) > 50 THEN substring(substring(CAST(to_json(x.imported_items) AS VARCHAR), 1, 1000), 1, 50) || '...' ELSE substring(CAST(to_json(x.imported_items) AS VARCHAR), 1, 1000) END) || '}' END || ']-> ' || b.shown AS line
        FROM ee e LEFT JOIN u x ON x.id = e.dst JOIN s a ON a.graph_id = e.graph_id AND a.id = e.src JOIN s b ON b.graph_id = e.graph_id AND b.id = e.dst WHERE ord <= 15"""),
    "schema_probe": _on(GRAPH, "SELECT graph_id, array_to_string(labels, ',') AS labels, CAST(max((name IS NOT NULL)::INT + (source_file IS NOT NULL)::INT + (start_line IS NOT NULL)::INT + (end_line IS NOT NULL)::INT + (description IS NOT NULL)::INT) AS INTEGER) AS n_properties FROM nodes GROUP BY ALL"),
    "largest_types": _on(GRAPH, "SELECT graph_id, entity_type, n FROM (SELECT graph_id, entity_type, count(*) AS n, row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, entity_type) AS r FROM nodes GROUP BY graph_id, entity_type) WHERE r <= 3"),
    "insertion_points": _on(GRAPH, """, m AS (SELECT e.graph_id, e.src AS class_id, count(*) AS n, arg_max(struct_pack(method := n.name, el := n.end_line), struct_pack(a := coalesce(n.start_line, -1), b := e.dst)) AS m FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.id = e.dst WHERE e.rel_type = 'CONTAINS_METHOD' GROUP BY ALL)
        SELECT c.graph_id, c.id AS class_id, c.name, CASE WHEN m.m IS NOT NULL THEN 'after_method' ELSE 'end_of_class' END AS place, m.m.method AS after, coalesce(m.m.el, c.end_line) AS line, coalesce(m.n, 0) AS n_methods FROM nodes c LEFT JOIN m ON m.graph_id = c.graph_id AND m.class_id = c.id WHERE c.entity_type = 'Class'"""),
    "entity_dedup": _on(UNIQUE, "SELECT graph_id, entity_type, name, source_file, id, seq, n_records FROM u"),
    "entity_dedup_reference": _on(UNIQUE.replace("THEN coalesce(parent_name, '')\n", "THEN ''\n"), "SELECT graph_id, entity_type, CAST(sum(n_records) AS BIGINT) AS n_records, count(*) AS n_entities, CAST(sum(n_records) - count(*) AS BIGINT) AS n_duplicates FROM u GROUP BY ALL"),
    "build_nodes": _on(GRAPH, "SELECT graph_id, id, array_to_string(labels, ',') AS labels, entity_type, name, source_file, start_line, end_line, description FROM nodes"),
    "build_edges": _on(GRAPH, "SELECT graph_id, src, dst, rel_type, p.line AS line, p.b AS is_builtin FROM edges"),
    "edge_upsert": "SELECT 'User:' || user_id AS src, 'Type:' || event_type AS dst, 'DID_IT' AS rel_type, CAST(max(event_id) AS INTEGER) AS line FROM events GROUP BY user_id, event_type",
    "node_upsert": """WITH l AS (SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(['KGNode'], list(CASE WHEN regexp_matches(event_type, '^\\p{Lu}') THEN event_type ELSE 'Type_' || event_type END)))), ',') AS labels, max(event_id) AS m FROM events GROUP BY user_id)
        SELECT 'User:' || l.user_id AS id, l.labels, e.event_type AS entity_type, CAST(e.event_id AS INTEGER) AS start_line, e.props AS description FROM l JOIN events e ON e.event_id = l.m""",
    "placeholder_upsert": "SELECT 'PotentialFunction:' || event_type AS id, event_type AS name, min(ts) AS created_at, max(ts) AS last_seen FROM events GROUP BY event_type",
    "cascade_delete": "SELECT graph_id, count(*) AS n FROM entities WHERE graph_id IS NULL OR graph_id NOT IN (SELECT graph_id FROM graphs WHERE user_id IS NULL AND graph_id IS NOT NULL) GROUP BY 1",
    "vector_topk": _on(_TOPK.format(l2=_L2, k=5), "SELECT * FROM tk"),
    "vector_min_merge": _on(_TOPK.format(l2=_L2, k=5), "SELECT vec_id, min(distance) AS distance, count(*) AS n_queries FROM tk GROUP BY vec_id"),
    "precision_recall_mrr": _on(_TOPK.format(l2=_L2, k=10), """, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT tk.query_id, count(*) FILTER (a.label = b.label) AS h, max(n.n) AS n, min(CASE WHEN a.label = b.label THEN rank END) AS f FROM tk JOIN embeddings a ON a.vec_id = tk.query_id JOIN embeddings b ON b.vec_id = tk.vec_id JOIN n ON n.label = a.label GROUP BY 1)
        SELECT query_id, round(h / 10, 6) AS precision, round(h / n, 6) AS recall, round(coalesce(CAST(1 AS DOUBLE) / f, 0.0), 6) AS reciprocal_rank FROM m"""),
    "tokenize_query": _on(TURNS, f""", a AS (SELECT conversation_id, pos, list_filter(regexp_extract_all(lower("user"), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})) AS ws FROM t)
        SELECT conversation_id, pos, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') AS words FROM a"""),
    "change_type": _on(TURNS, f"SELECT conversation_id, pos, {_CHANGE} AS change FROM t"),
    "intent": _on(TURNS, f"""SELECT conversation_id, pos, {_INTENT} AS intent, CASE WHEN contains(lower("user"), 'general_question') THEN 'general_question' WHEN contains(lower("user"), 'code_explanation') THEN 'code_explanation' WHEN contains(lower("user"), 'change_request') THEN 'change_request' WHEN contains(lower("user"), 'function_request') THEN 'function_request' ELSE 'general_question' END AS label FROM t"""),
    "dynamic_hops": _on(TURNS, f""", a AS (SELECT *, {_INTENT} AS intent, CASE WHEN trim("user") = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace("user", '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS n FROM t)
        SELECT conversation_id, pos, CAST(CASE WHEN intent IN ('change_request', 'function_request') THEN 2 WHEN n > 15 THEN 3 WHEN n < 5 THEN 1 ELSE 2 END AS INTEGER) AS hops FROM a"""),
    "sanitize_ids": rf"""SELECT rec_id, {_id_sql("name")} AS id_part, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(name, '[^\p{{L}}\p{{N}}_.\-]', '_', 'g'), '\.{{2,}}', '.', 'g'), '^\.|\.$', '', 'g'), ''), 'unnamed') AS name_part,
        regexp_replace(source_file, '[^\p{{L}}\p{{N}}_.\-/]', '_', 'g') AS path_part, CASE WHEN entity_type IS NULL OR entity_type = '' THEN 'UnknownEntity' WHEN regexp_matches(entity_type, '^\p{{Lu}}') THEN regexp_replace(entity_type, '[^\p{{L}}\p{{N}}_]', '_', 'g') ELSE 'Type_' || entity_type END AS label,
        coalesce(nullif(upper(regexp_replace(entity_type, '[^\p{{L}}\p{{N}}_]', '_', 'g')), ''), 'RELATED_TO') AS rel, split_part(name, '.', -1) AS simple FROM entities""",
    "clean_paths": rf"""WITH a AS (SELECT rec_id, {_path_sql("source_file")} AS path FROM entities) SELECT rec_id, path, regexp_replace(translate(regexp_replace(path, '(?i)\.py$', ''), '/', '.'), '\.?__init__$', '') AS module FROM a""",
    "entity_text": """WITH a AS (SELECT *, coalesce(description, 'Default description for ' || coalesce(entity_type, '') || ' ''' || coalesce(name, '') || '''.') AS d FROM entities)
        SELECT rec_id, 'Entity Type: ' || coalesce(entity_type, 'N/A') || chr(10) || 'Name: ' || coalesce(name, 'N/A') || chr(10) || 'Source File: ' || coalesce(source_file, 'N/A') || ':' || coalesce(CAST(start_line AS VARCHAR), 'N/A') || chr(10) ||
          CASE WHEN parent_type IS NOT NULL AND parent_name IS NOT NULL THEN 'Context: Defined within ' || parent_type || ' ''' || parent_name || '''' || chr(10) ELSE '' END || 'Description: ' || d || chr(10) AS text,
          CASE WHEN length(description) > 20 THEN substring(description, 1, 300) ELSE concat_ws(' ', entity_type, name) END AS short FROM a""",
    "naming_vote": _on(CHUNKS, r""", n AS (SELECT graph_id, 'class' AS kind, unnest(regexp_extract_all(text, 'class\s+([A-Za-z0-9_]+)', 1)) AS name FROM c UNION ALL SELECT graph_id, 'function', unnest(regexp_extract_all(text, 'def\s+([A-Za-z0-9_]+)', 1)) FROM c UNION ALL SELECT graph_id, 'variable', unnest(regexp_extract_all(text, '([a-z][A-Za-z0-9_]+)\s*=', 1)) FROM c),
        k AS (SELECT graph_id, kind, CASE WHEN contains(name, '_') THEN 's' WHEN regexp_matches(name, '^\p{Lu}') THEN 'p' WHEN regexp_matches(substring(name, 2), '\p{Lu}') THEN 'c' ELSE 's' END AS k FROM n WHERE name <> ''),
        v AS (SELECT graph_id, kind, count(*) FILTER (k = 's') AS n_snake, count(*) FILTER (k = 'c') AS n_camel, count(*) FILTER (k = 'p') AS n_pascal FROM k GROUP BY ALL)
        SELECT graph_id, kind, CASE WHEN n_snake = greatest(n_snake, n_camel, n_pascal) THEN 'snake_case' WHEN n_camel = greatest(n_snake, n_camel, n_pascal) THEN 'camelCase' ELSE 'PascalCase' END AS convention, n_snake, n_camel, n_pascal FROM v"""),
    "error_vote": _on(CHUNKS, r""", v AS (SELECT graph_id, CAST(sum(len(regexp_extract_all(text, 'try:'))) AS BIGINT) AS n_try, CAST(sum(len(regexp_extract_all(text, 'except\s+[A-Za-z0-9_]+'))) AS BIGINT) AS n_specific, CAST(sum(len(regexp_extract_all(text, 'except:'))) AS BIGINT) AS n_bare FROM c WHERE text IS NOT NULL GROUP BY 1)
        SELECT *, CASE WHEN n_try = 0 THEN 'no_error_handling' WHEN n_specific > n_bare THEN 'specific_exception_handling' ELSE 'generic_exception_handling' END AS style FROM v"""),
    "doc_vote": _on(CHUNKS, r""", v AS (SELECT graph_id, CAST(sum(len(regexp_extract_all(text, '(?s)""\".*?""\"'))) AS BIGINT) AS n_double, CAST(sum(len(regexp_extract_all(text, '(?s)''''''.*?'''''''))) AS BIGINT) AS n_single, CAST(sum(len(regexp_extract_all(text, '#'))) AS BIGINT) AS n_hash FROM c WHERE text IS NOT NULL GROUP BY 1)
        SELECT *, CASE WHEN n_double > 0 THEN CASE WHEN n_double >= n_single THEN 'docstrings_triple_double' ELSE 'docstrings_triple_single' END WHEN n_hash > 0 THEN 'inline_comments' ELSE 'minimal_documentation' END AS style FROM v""".replace('""\\"', '"""')),
    "judge_scores": _on(TURNS, """SELECT conversation_id, pos, CAST(length(assistant) % 10 AS INTEGER) AS relevance, 0 AS accuracy, CAST(length(assistant) % 10 AS INTEGER) AS rag, CAST(pos AS INTEGER) AS llm,
        CASE WHEN length(assistant) % 10 > pos THEN 'RAG' WHEN length(assistant) % 10 < pos THEN 'LLM-Only' ELSE 'Tie' END AS winner, 'fine' AS analysis FROM t WHERE assistant IS NOT NULL"""),
    "compare_answers": _on(TURNS, """SELECT conversation_id || '/' || pos AS k, CAST(length(assistant) % 10 AS DOUBLE) AS avg_rag, CAST(pos AS DOUBLE) AS avg_llm,
        CASE WHEN length(assistant) % 10 > pos THEN 'RAG' WHEN length(assistant) % 10 < pos THEN 'LLM-Only' ELSE 'Tie' END AS winner FROM t WHERE assistant IS NOT NULL"""),
    "answer_overlap": _on(TURNS, r""", w AS (SELECT conversation_id || '/' || pos AS k, list_filter(regexp_split_to_array(lower(coalesce("user", '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(lower(coalesce(assistant, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS c FROM t),
        o AS (SELECT unnest([1, 2, 3, 4]) AS n), g AS (SELECT k, n, 'c' AS side, unnest(list_transform(generate_series(1, len(c) - n + 1), lambda i: array_to_string(c[i:i + n - 1], ' '))) AS g FROM w, o UNION ALL SELECT k, n, 'r', unnest(list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i:i + n - 1], ' '))) FROM w, o),
        m AS (SELECT k, n, g, count(*) FILTER (side = 'c') AS a, count(*) FILTER (side = 'r') AS b FROM g GROUP BY ALL), hh AS (SELECT k, n, CAST(sum(least(a, b)) AS DOUBLE) AS h FROM m GROUP BY k, n),
        x AS (SELECT w.k, o.n, len(c) AS nc, len(r) AS nr, coalesce(hh.h, 0) AS h FROM w CROSS JOIN o LEFT JOIN hh ON hh.k = w.k AND hh.n = o.n)
        SELECT k, round(coalesce(CASE WHEN min(h) > 0 THEN exp(sum(CASE WHEN h > 0 THEN ln(h / (nc - n + 1)) END) / 4) * CASE WHEN min(nc) >= min(nr) THEN 1.0 ELSE exp(1 - CAST(min(nr) AS DOUBLE) / min(nc)) END END, 0.0), 6) AS bleu,
          round(coalesce(2.0 * max(CASE WHEN n = 1 THEN h END) / nullif(max(greatest(nc - 0, 0) + greatest(nr - 0, 0)), 0), 0.0), 6) AS rouge_1,
          round(coalesce(2.0 * max(CASE WHEN n = 2 THEN h END) / nullif(max(greatest(nc - 1, 0) + greatest(nr - 1, 0)), 0), 0.0), 6) AS rouge_2,
          round(coalesce(2.0 * max(CASE WHEN n = 3 THEN h END) / nullif(max(greatest(nc - 2, 0) + greatest(nr - 2, 0)), 0), 0.0), 6) AS rouge_3,
          round(coalesce(2.0 * max(CASE WHEN n = 4 THEN h END) / nullif(max(greatest(nc - 3, 0) + greatest(nr - 3, 0)), 0), 0.0), 6) AS rouge_4 FROM x GROUP BY k"""),
    "exact_match": _on(TURNS, r"""SELECT conversation_id, pos, list_filter(regexp_split_to_array(lower(coalesce("user", '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') = list_filter(regexp_split_to_array(lower(coalesce(assistant, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS same FROM t"""),
    "property_bag": """SELECT rec_id, CAST((rec_id IS NOT NULL)::INT + (graph_id IS NOT NULL)::INT + (entity_type IS NOT NULL)::INT + (name IS NOT NULL)::INT + (source_file IS NOT NULL)::INT + (start_line IS NOT NULL)::INT + (end_line IS NOT NULL)::INT + (start_byte IS NOT NULL)::INT + (end_byte IS NOT NULL)::INT
        + (parent_type IS NOT NULL)::INT + (parent_name IS NOT NULL)::INT + (module_name IS NOT NULL)::INT + (imported_items IS NOT NULL)::INT + (description IS NOT NULL)::INT + (indexed_at IS NOT NULL)::INT AS INTEGER) AS n_properties,
        coalesce(name, 'none') AS name, coalesce(CAST(to_json(imported_items) AS VARCHAR), '[]') AS items FROM entities""",
    "zipped_turns": "WITH h AS (SELECT conversation_id, min(history) AS history FROM conversations WHERE history IS NOT NULL AND conversation_id IS NOT NULL GROUP BY 1), i AS (SELECT *, unnest(generate_series(1, len(history))) AS i FROM h) SELECT conversation_id, CAST(i - 1 AS BIGINT) AS ord, history[i].\"user\" AS u, history[i].assistant AS a FROM i",
    "token_stats": _on(CHUNKS, "SELECT graph_id, count(*) AS n_chunks, min(tokens) AS min_tokens, max(tokens) AS max_tokens, round(avg(tokens), 6) AS avg_tokens, list_sort(list(tokens))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median_tokens FROM c GROUP BY 1"),
    "token_histogram": _on(CHUNKS, "SELECT graph_id, CAST(tokens // 100 * 100 AS VARCHAR) || '-' || CAST(tokens // 100 * 100 + 100 AS VARCHAR) AS bucket, count(*) AS n FROM c GROUP BY ALL"),
    "chunks_per_file": _on(CHUNKS, "SELECT graph_id, source_file, count(*) AS n_chunks FROM c GROUP BY ALL"),
    "overlap_lines": _on(CHUNKS, """, a AS (SELECT *, lead(start_line) OVER (PARTITION BY graph_id, source_file ORDER BY start_line, end_line, id) AS nx FROM c WHERE start_line IS NOT NULL AND end_line IS NOT NULL)
        SELECT graph_id, CAST(sum(CASE WHEN end_line >= nx THEN end_line - nx + 1 ELSE 0 END) AS BIGINT) AS overlap_lines, count(*) FILTER (end_line >= nx) AS n_overlaps FROM a GROUP BY 1"""),
    "whitespace_tokens": _on(CHUNKS, f"SELECT graph_id, round(avg({_PERWORDS}), 6) AS avg_words FROM c GROUP BY 1"),
    "breakpoints": _on(CHUNKS + "," + _LINES, """SELECT id, line, 'structure' AS reason FROM l4 WHERE structure UNION ALL SELECT id, min(line), 'comment' FROM l4 WHERE (comment OR starts_with(ltrim(s), '@')) AND ahead IS NOT NULL GROUP BY id, ahead
        UNION ALL SELECT id, line, 'dedent' FROM l4 WHERE line > 0 AND code = 0 AND before > 0"""),
    "entity_distribution": "SELECT graph_id, entity_type, count(*) AS n FROM entities GROUP BY ALL",
    "description_stats": _on(GRAPH + "," + _SCORES, "SELECT * FROM ds"),
    "dedup_longest": "SELECT source, lang, doc_id, n FROM (SELECT source, lang, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1",
    "dedup_first": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1",
    "conversation_list": "SELECT conversation_id, min(graph_id) AS graph_id, min(user_id) AS user_id, min(name) AS name, max(created_at) AS created_at, CAST(max(coalesce(len(history), 0)) AS INTEGER) AS n_turns FROM conversations GROUP BY 1",
    "conversation_history": _on(TURNS, 'SELECT conversation_id, pos, ts, "user", assistant FROM t'),
    "conversation_append": "SELECT conversation_id, CAST(max(coalesce(len(history), 0)) + 1 AS BIGINT) AS n_turns, 'next?' AS last_user FROM conversations WHERE conversation_id IS NOT NULL GROUP BY 1",
    "accessible_conversations": "SELECT DISTINCT c.conversation_id, c.graph_id FROM conversations c JOIN graphs g ON g.graph_id = c.graph_id AND g.user_id = c.user_id",
    "graphs_by_user": "SELECT user_id, count(*) AS n_graphs, max(strftime(created_at, '%d/%m/%Y')) AS a_day FROM graphs GROUP BY 1",
    "expanded_query": _on(TURNS, r""", a AS (SELECT *, regexp_replace(split_part(regexp_replace(coalesce(assistant, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), chr(10), 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS f FROM t) SELECT conversation_id, pos, CASE WHEN f = '' THEN "user" ELSE concat_ws(' ', "user", f) END AS q FROM a"""),
    "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM b GROUP BY user_id, s""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total_value FROM events GROUP BY ALL",
    "part_similarity": "SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 9) AS similarity FROM part",
}
ORACLE_SQL |= {f"star_{k}": ORACLE_SQL[k].replace(GRAPH.strip(), STAR.strip()) for k in ON_STAR}
