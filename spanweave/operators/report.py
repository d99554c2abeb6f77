"""Formatted context, summaries and what charts are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanweave.functions.text import relationship_priority
from spanweave.operators import metrics
from spanweave.operators.graph import Graph
from spanweave.schemas import EDGE_PROPS

#: The label a node is shown by, the first that it has (fixed values).
SHOWN_TYPES = ["Method", "Function", "Class", "Module", "Call", "Import"]
PROP_CHARS = 50


def shown_type(labels: Column) -> Column:
    """The first of the preferred labels that a node has, else its first label, else Node."""
    return F.coalesce(*[F.when(F.array_contains(labels, t), F.lit(t)) for t in SHOWN_TYPES], F.try_element_at(labels, F.lit(1)), F.lit("Node"))


def shown_props(props: Column) -> Column:
    """` {name: value, ...}` of the properties that are set, values cut to 50 characters; empty without any."""
    names = [p.split(":")[0] for p in EDGE_PROPS[7:-1].split(",")]
    cut = lambda v: F.when(F.length(v) > PROP_CHARS, F.concat(F.substring(v, 1, PROP_CHARS), F.lit("..."))).otherwise(v)
    items = F.array_compact(F.array(*[F.when(props[n].isNotNull(), F.concat(F.lit(n + ": "), cut(props[n].cast("string")))) for n in names]))
    return F.when(props.isNull() | (F.size(items) == 0), F.lit("")).otherwise(F.concat(F.lit(" {"), F.array_join(items, ", "), F.lit("}")))


def relation_lines(g: Graph, edges: DataFrame, limit: int = 15) -> DataFrame:
    """(graph_id, ord, line): the first `limit` relations of each graph by priority, ends and type, as text. Ends that
    are no nodes show their id as Unknown/External."""
    r = F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("priority"), "src", "dst", "rel_type"))
    e = edges.withColumn("priority", relationship_priority(F.col("rel_type"))).withColumn("ord", r).where(F.col("ord") <= limit)
    n = g.nodes.select("graph_id", "id", F.concat(F.coalesce("name", "id"), F.lit(" ("), shown_type(F.col("labels")), F.lit(")")).alias("shown"))
    e = e.join(n.select("graph_id", F.col("id").alias("src"), F.col("shown").alias("s")), ["graph_id", "src"], "left").join(n.select("graph_id", F.col("id").alias("dst"), F.col("shown").alias("t")), ["graph_id", "dst"], "left")
    end = lambda shown, i: F.coalesce(shown, F.concat(i, F.lit(" (Unknown/External)")))
    line = F.concat(F.lit("- "), end(F.col("s"), F.col("src")), F.lit(" -["), F.col("rel_type"), shown_props(F.col("props")), F.lit("]-> "), end(F.col("t"), F.col("dst")))
    return e.select("graph_id", "ord", line.alias("line"))


def node_lines(nodes: DataFrame) -> DataFrame:
    """What is shown where a set of nodes has no relations."""
    return nodes.select("graph_id", "id", F.concat(F.lit("- "), F.coalesce("name", "id"), F.lit(" ("), shown_type(F.col("labels")), F.lit(")")).alias("line"))


def schema_probe(g: Graph) -> DataFrame:
    """The label sets of each graph and how many properties their nodes have at most."""
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("name", "source_file", "start_line", "end_line", "description")), F.lit(0))
    return g.nodes.groupBy("graph_id", F.array_join("labels", ",").alias("labels")).agg(F.max(filled).alias("n_properties"))


def sample(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of each graph by id, to look at."""
    return rows.withColumn("r", F.row_number().over(W.partitionBy("graph_id").orderBy("id"))).where(F.col("r") <= k).drop("r")


def context_blocks(chunks: DataFrame, limit: int = 15, cut: int = 500) -> DataFrame:
    """(graph_id, ord, block): the first `limit` chunks of each graph by id, with their place, cut to `cut` characters."""
    r = F.row_number().over(W.partitionBy("graph_id").orderBy("id"))
    line = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    block = F.concat(F.lit("# "), F.coalesce("source_file", F.lit("None")), F.lit(":"), line("start_line"), F.lit("-"), line("end_line"), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, cut))
    return chunks.withColumn("ord", r).where(F.col("ord") <= limit).select("graph_id", "ord", block.alias("block"))


def html_rows(scores: DataFrame) -> DataFrame:
    """(graph_id, html): a table row per graph with its score from 0 to 100 in its colour."""
    color = F.when(F.col("overall") >= 70, "green").when(F.col("overall") >= 40, "orange").otherwise("red")
    safe = F.replace(F.replace(F.col("graph_id"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    shown = F.round("overall").cast("int").cast("string")
    return scores.select("graph_id", F.concat(F.lit("<tr><td>"), safe, F.lit('</td><td style="color:'), color, F.lit('">'), shown, F.lit("</td></tr>")).alias("html"))


def html_report(scores: DataFrame, title: str = "Evaluation") -> str:
    """The rows as one page. `scores` has one row per graph."""
    rows = "\n".join(r["html"] for r in html_rows(scores).orderBy("graph_id").collect())
    return f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{title}</title></head><body>\n<table>\n{rows}\n</table>\n</body></html>\n"


def bar_chart(counts: DataFrame, by: str, value: str, k: int = 20, width: int = 400) -> str:
    """The k largest bars, ties by name, as a drawing in SVG."""
    rows = counts.orderBy(F.desc(value), by).limit(k).select(by, value).collect()
    most = max((r[value] for r in rows), default=1) or 1
    bars = [f'<text x="0" y="{18 * i + 13}">{str(r[by]).replace("&", "&amp;").replace("<", "&lt;")}: {r[value]}</text><rect x="200" y="{18 * i + 2}" width="{round(width * r[value] / most)}" height="14"/>' for i, r in enumerate(rows)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 210}" height="{18 * len(rows) + 4}">{"".join(bars)}</svg>'


def largest(counts: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The k largest bars of each graph for a chart, ties by name."""
    r = F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc(value), by))
    return counts.withColumn("r", r).where(F.col("r") <= k).drop("r")


def summary_lines(g: Graph, chunks: DataFrame) -> DataFrame:
    """(graph_id, section, ord, line): a text summary with the score, the ten commonest types and the five top hubs."""
    score = metrics.quality_score(g, chunks).select("graph_id", F.lit("score").alias("section"), F.lit(1).alias("ord"), F.format_string("Overall score %.1f (%s)", "overall", "grade").alias("line"))
    types = largest(metrics.entity_distribution(g.nodes), "entity_type", "n", 10).withColumn("ord", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("n"), "entity_type")))
    types = types.select("graph_id", F.lit("types").alias("section"), "ord", F.concat_ws(": ", "entity_type", F.col("n").cast("string")).alias("line"))
    hubs = metrics.hub_nodes(g, 5).withColumn("ord", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("n_neighbours"), "id")))
    hubs = hubs.select("graph_id", F.lit("hubs").alias("section"), "ord", F.concat(F.coalesce("name", "id"), F.lit(" with "), F.col("n_neighbours").cast("string"), F.lit(" neighbours")).alias("line"))
    return score.unionByName(types).unionByName(hubs)
