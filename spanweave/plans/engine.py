"""The engine: index a folder, retrieve context for a question, evaluate, and the thin service methods.

Every stage is a DataFrame; one action writes each table. A failing stage raises."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanweave.functions.text import change_type, default_description, dynamic_hops, entity_text, gated_description, keyword_intent, special_term
from spanweave.operators import changes, metrics, report, store, traversal, vectors
from spanweave.operators.chunking import chunk_files
from spanweave.operators.dedup import unique_entities, valid_entities
from spanweave.operators.graph import Graph, graph_of_unique
from spanweave.plans.model import Model, answer, classify, describe, expand, graph_query, recommend, rerank_order
from spanweave.sources.files import index_metadata_row, python_files
from spanweave.sources.parsing import extract_entities

@dataclass(frozen=True)
class Retrieved:
    """Lazy parts of a retrieved context."""

    question: str
    intent: str
    hops: int
    entities: DataFrame
    nodes: DataFrame
    relationships: DataFrame
    chunks: DataFrame
    extras: dict[str, DataFrame] = field(default_factory=dict)


class CodeGraphEngine:
    """`model` answers and describes if given; `embed(rows, id_col, text_col)` gives (id, embedding) and defaults to
    hashed words of `dims` dimensions; `embedding_model` is its name in the metadata of an index."""

    def __init__(self, spark: SparkSession, root: str, dims: int = 64, model: Model | None = None, embed: Callable[[DataFrame, str, str], DataFrame] | None = None, embedding_model: str = "hashed words"):
        self.spark, self.root, self.dims, self.model, self.embedding_model = spark, root.rstrip("/"), dims, model, embedding_model
        self.embed = embed or (lambda rows, i, t: vectors.hash_embedding(rows, i, t, dims))

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, graph_id: str | None = None) -> DataFrame:
        d = self.spark.read.parquet(self._path(name))
        return d if graph_id is None else d.where(F.col("graph_id") == graph_id)

    def _write(self, df: DataFrame, name: str) -> None:
        """Replaces the partitions of the graphs in `df` only."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(self._path(name))

    def index(self, folder: str, graph_id: str, name: str = "", user_id: str = "", token_limit: int = 1050) -> None:
        """Parses, deduplicates, chunks, embeds and writes all tables of one graph."""
        files = python_files(self.spark, folder, graph_id)
        if not files.limit(1).count():
            raise ValueError(f"no Python files under {folder}")
        raw = extract_entities(files).withColumn("rec_id", F.col("seq")).withColumn("description", F.lit(None).cast("string"))
        self._write(raw, "entities_raw")
        raw = self.read("entities_raw", graph_id)
        unique = describe(unique_entities(valid_entities(raw)), self.model)
        self._write(unique, "entities")
        g = graph_of_unique(self.read("entities", graph_id))
        self._write(g.nodes, "nodes")
        self._write(g.edges, "edges")
        self._write(chunk_files(files, token_limit), "chunks")
        c = self.read("chunks", graph_id)
        self._write(self.embed(c, "id", "text").withColumn("graph_id", F.lit(graph_id)), "chunk_vectors")
        u = self.read("entities", graph_id)
        text = entity_text(F.col("entity_type"), F.col("name"), F.col("source_file"), F.col("start_line"), F.col("parent_type"), F.col("parent_name"), default_description(F.col("description"), F.col("entity_type"), F.col("name")))
        self._write(self.embed(u.select("id", text.alias("text")), "id", "text").withColumn("graph_id", F.lit(graph_id)), "entity_vectors")
        # the counts are read from the tables just written
        meta = index_metadata_row(self.spark, graph_id, files, u.count(), c.count(), token_limit, self.embedding_model)
        self._write(meta.withColumn("graph_id", F.lit(graph_id)), "index_metadata")
        row = self.spark.createDataFrame([(graph_id, name, folder, user_id)], "graph_id string, name string, folder_path string, user_id string").withColumn("created_at", F.current_timestamp())
        self._write(row, "graphs")

    def graph(self, graph_id: str) -> Graph:
        return Graph(self.read("nodes", graph_id), self.read("edges", graph_id))

    def _nearest(self, table: str, graph_id: str, text: str, k: int) -> DataFrame:
        q = self.embed(self.spark.createDataFrame([("q", text)], "id string, text string"), "id", "text").first()["embedding"]
        v = self.read(table, graph_id).select("id", "embedding")
        return vectors.topk_one(v, q, k).withColumnRenamed("vec_id", "id")

    def retrieve(self, question: str, graph_id: str, k_entities: int = 15, k_chunks: int = 5, hops: int = 3) -> Retrieved:
        """Nearest entities, their bounded neighbourhood, extras by intent, and the nearest chunks of the question
        and of the best entities' descriptions, each chunk once with its smallest distance."""
        plan = self.spark.createDataFrame([(question,)], "q string").select(keyword_intent(F.col("q")).alias("i"), dynamic_hops(F.col("q"), keyword_intent(F.col("q")), F.lit(hops)).alias("h"), change_type(F.col("q")).alias("c")).first()
        intent = classify(question, plan["i"], self.model)
        g = self.graph(graph_id)
        hits = self._nearest("entity_vectors", graph_id, expand(question, self.model), k_entities).withColumn("ord", F.row_number().over(W.orderBy("distance", "id")) - 1)
        seeds = hits.select(F.lit(graph_id).alias("graph_id"), "id", "ord")
        ids = traversal.expand(g, seeds, plan["h"])
        extras: dict[str, DataFrame] = {}
        if intent in ("change_request", "function_request"):
            extras["similar"] = traversal.similar_names(g, seeds)
            extras["change_points"] = changes.change_points(g, seeds, plan["c"])
            extras["impact"] = traversal.risk_level(g, seeds)
            if intent == "function_request":
                extras["related"] = traversal.related_functions(g, seeds)
        elif intent == "general_question":
            extras["top_files"] = traversal.top_files(g)
        best = seeds.where("ord < 5").join(g.nodes, ["graph_id", "id"]).orderBy("ord").select(gated_description(F.col("description"), F.col("entity_type"), F.col("name")).alias("t"))
        # the question, five descriptions and three terms of type and name at most
        terms = seeds.where("ord < 3").join(g.nodes, ["graph_id", "id"]).orderBy("ord").select(special_term(F.col("entity_type"), F.col("name")).alias("t"))
        texts = list(dict.fromkeys(t for t in [question, *[r["t"] for r in best.collect()], *[r["t"] for r in terms.collect()]] if t))
        found = None
        for t in texts:
            h = self._nearest("chunk_vectors", graph_id, t, k_chunks)
            found = h if found is None else found.unionByName(h)
        merged = vectors.min_merge(found.withColumnRenamed("id", "vec_id")).withColumnRenamed("vec_id", "id")
        chunks = self.read("chunks", graph_id).join(merged, "id").orderBy("distance", "id")
        if intent == "general_question" and not hits.limit(1).count():
            extras["keyword_nodes"] = traversal.keyword_search(g.nodes, question, ["name", "description"], "id")
        return Retrieved(question, intent, plan["h"], hits, traversal.node_details(g, ids), traversal.induced_edges(g, ids), chunks, extras)

    def context(self, r: Retrieved, graph_id: str, max_rels: int = 20, max_chunks: int = 15, max_chars: int = 55_000) -> str:
        """The context of an answer as text: relations by priority, change points, then chunks, cut to `max_chars`."""
        g = self.graph(graph_id)
        inside = g.edges.join(r.relationships.select("graph_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "rel_type"), ["graph_id", "src", "dst", "rel_type"], "left_semi")
        lines = [x["line"] for x in report.relation_lines(g, inside, max_rels).orderBy("ord").collect()]
        parts = ["Relations", *lines]
        if "change_points" in r.extras:
            parts += ["Change points"] + [f"- {c['change']} in {c['name']} ({c['source_file']}:{c['line']})" for c in r.extras["change_points"].limit(5).collect()]
        rows = r.chunks.limit(max_chunks).collect()
        rows = [rows[i] for i in rerank_order(r.question, [c["text"] or "" for c in rows], self.model)]
        parts += ["Code"] + [f"# {c['source_file']}:{c['start_line']}-{c['end_line']}\n{c['text']}" for c in rows]
        return "\n".join(parts)[:max_chars]

    def recommendation(self, question: str, graph_id: str, kind: str | None = None) -> str:
        """What to change for a request: the five best change points, the code's conventions, and what the changes touch;
        put into words by the model if there is one."""
        g = self.graph(graph_id)
        kind = kind or self.spark.createDataFrame([(question,)], "q string").select(change_type(F.col("q")).alias("c")).first()["c"]
        hits = self._nearest("entity_vectors", graph_id, question, 15).withColumn("ord", F.row_number().over(W.orderBy("distance", "id")) - 1)
        seeds = hits.select(F.lit(graph_id).alias("graph_id"), "id", "ord")
        points = changes.change_points(g, seeds, kind).limit(5).collect()
        chunks = self.read("chunks", graph_id)
        lines = ["Change points", *(f"- {p['change']}: {p['entity_type']} {p['name']} ({p['source_file']}:{p['line']})" for p in points)]
        lines += ["Patterns", *(f"- {r['kind']} names: {r['convention']}" for r in changes.naming_votes(chunks).orderBy("kind").collect())]
        lines += [f"- {r['style']}" for votes in (changes.error_votes(chunks), changes.doc_votes(chunks)) for r in votes.collect()]
        lines += ["Impact", *(f"- {r['target_id']}: {r['risk']}, {r['n_direct']} direct callers" for r in traversal.risk_level(g, seeds).orderBy(F.desc("score"), "target_id").limit(5).collect())]
        return recommend(question, "\n".join(lines), self.model)

    def ask_graph(self, question: str, graph_id: str) -> DataFrame:
        """A question answered by a query the model writes over the graph; nodes by keyword where it writes none."""
        g = self.graph(graph_id)
        sql = graph_query(question, self.model)
        return self.spark.sql(re.sub(r"\b(nodes|edges)\b", r"{\1}", sql), nodes=g.nodes, edges=g.edges) if sql else traversal.keyword_search(g.nodes, question, ["name", "description"], "id")

    def evaluate(self, graph_id: str) -> dict[str, DataFrame]:
        g = self.graph(graph_id)
        c = self.read("chunks", graph_id)
        chunks = c.select("graph_id", "id", "text", F.struct("source_file", "language", "chunk_index", "start_line", "end_line", "token_count").alias("metadata"), F.lit(None).cast("timestamp").alias("indexed_at"))
        return {
            "labels": metrics.node_counts_by_label(g), "types": metrics.edge_counts_by_type(g), "density": metrics.graph_density(g), "hubs": metrics.hub_nodes(g), "centrality": metrics.centrality_nodes(g),
            "components": metrics.component_counts(g), "tokens": metrics.token_stats(chunks), "histogram": metrics.token_histogram(chunks), "overlap": metrics.overlap_lines(chunks), "score": metrics.quality_score(g, chunks),
        }

    def evaluate_retrieval(self, graph_id: str, questions: list[str], k: int = 5) -> DataFrame:
        """The k nearest entities of each question: (question, rank, id, distance)."""
        out = None
        for q in questions:
            h = self._nearest("entity_vectors", graph_id, q, k).withColumn("rank", F.row_number().over(W.orderBy("distance", "id"))).select(F.lit(q).alias("question"), "rank", "id", "distance")
            out = h if out is None else out.unionByName(h)
        return out

    # ------------------------------------------------------------------------------------ service methods
    def graphs(self, user_id: str) -> DataFrame:
        return store.graphs_of(self.read("graphs"), user_id)

    def visualization(self, graph_id: str, limit: int = 500) -> tuple[DataFrame, DataFrame]:
        g = self.graph(graph_id)
        return traversal.viz_nodes(g, limit), traversal.viz_edges(g, limit)

    def graph_row(self, user_id: str, graph_id: str) -> DataFrame:
        return store.graphs_of(self.read("graphs", graph_id), user_id)

    def start_chat(self, user_id: str, graph_id: str, question: str, name: str = "") -> tuple[str, str]:
        """Opens a conversation on a graph of the user and answers its first question: (conversation id, answer)."""
        conversation_id = uuid.uuid4().hex
        return conversation_id, self._turn(user_id, graph_id, conversation_id, question, name)

    def send_message(self, user_id: str, conversation_id: str, question: str) -> str:
        row = self.read("turns").where((F.col("conversation_id") == conversation_id) & (F.col("user_id") == user_id)).select("graph_id", "name").limit(1).collect()
        if not row:
            raise KeyError(f"no conversation {conversation_id} of {user_id}")
        return self._turn(user_id, row[0]["graph_id"], conversation_id, question, row[0]["name"])

    def _turn(self, user_id: str, graph_id: str, conversation_id: str, question: str, name: str) -> str:
        """Appends one row to the table of turns; nothing that stands there is rewritten."""
        if not self.graph_row(user_id, graph_id).limit(1).count():
            raise KeyError(f"no graph {graph_id} of {user_id}")
        said = answer(question, self.context(self.retrieve(question, graph_id), graph_id), self.model)
        now = datetime.now(UTC)
        ddl = "graph_id string, user_id string, name string, conversation_id string, user string, assistant string, timestamp string, created_at timestamp"
        row = self.spark.createDataFrame([(graph_id, user_id, name, conversation_id, question, said, now.isoformat(), now.replace(tzinfo=None))], ddl)
        row.write.mode("append").partitionBy("graph_id").parquet(self._path("turns"))
        return said

    def conversations(self, user_id: str, graph_id: str | None = None) -> DataFrame:
        """The user's conversations, put together from their turns."""
        return store.conversations_of(self.read("turns", graph_id).where(F.col("user_id") == user_id))

    def history(self, conversation_id: str) -> DataFrame:
        return store.conversation_history(store.conversations_of(self.read("turns").where(F.col("conversation_id") == conversation_id)))

    def delete(self, user_id: str, graph_id: str) -> None:
        """Removes a graph of the user from every table, its conversations too."""
        if not self.graph_row(user_id, graph_id).limit(1).count():
            raise KeyError(f"no graph {graph_id} of {user_id}")
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in ("turns", "index_metadata", "entities_raw", "entities", "nodes", "edges", "chunks", "chunk_vectors", "entity_vectors", "graphs"):
            p = jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/graph_id={graph_id}")
            p.getFileSystem(conf).delete(p, True)
