"""Queries on the property graph: bounded, unrolled joins; frontiers are distinct ids and nothing is collected.

All take a Graph and return DataFrames keyed by graph_id, so one plan serves every graph. Sets of start nodes are
DataFrames (graph_id, id): one set per graph. With a column seed_id as well they are one set per seed_id, all worked on
at once, and results carry it. Empty sets give empty results; null names never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanweave.functions.similarity import jaro_winkler
from spanweave.functions.text import keywords, relationship_priority
from spanweave.operators.graph import Graph

WALKED = ["CONTAINS", "CONTAINS_METHOD", "CALLS", "IMPORTS"]


def pairs(g: Graph, *rel_types: str) -> DataFrame:
    return g.edges.where(F.col("rel_type").isin(*rel_types)).select("graph_id", "src", "dst") if rel_types else g.edges.select("graph_id", "src", "dst")


def start_nodes(g: Graph, digest: str = "0", kind: str = "Function") -> DataFrame:
    """Start sets of one node each, (graph_id, id, seed_id): the nodes of a type whose id's MD5 digest begins so."""
    return g.nodes.where((F.col("entity_type") == kind) & F.md5("id").startswith(digest)).select("graph_id", "id", F.col("id").alias("seed_id"))


def _key(seeds: DataFrame) -> list[str]:
    return ["graph_id", *(["seed_id"] if "seed_id" in seeds.columns else [])]


def class_methods(g: Graph) -> DataFrame:
    """Every class with its methods."""
    e = pairs(g, "CONTAINS_METHOD")
    m = g.nodes.select("graph_id", F.col("id").alias("dst"), F.col("name").alias("method"), "start_line", "end_line")
    return e.join(m, ["graph_id", "dst"]).select("graph_id", F.col("src").alias("class_id"), F.col("dst").alias("method_id"), "method", "start_line", "end_line")


def dependents(g: Graph, seeds: DataFrame, limit: int = 10) -> DataFrame:
    """Distinct callers of a set of nodes, the first `limit` of each set by id."""
    key = _key(seeds)
    c = pairs(g, "CALLS").join(seeds.select(*key, F.col("id").alias("dst")), ["graph_id", "dst"]).select(*key, F.col("src").alias("id")).distinct()
    c = c.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("id"))).where(F.col("r") <= limit).drop("r")
    return c.join(g.nodes.select("graph_id", "id", "name", F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type")), ["graph_id", "id"]).select(*key, "id", "name", "entity_type")


def direct_impacts(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """(target, caller) for every change point at once; all functions and classes by default."""
    t = targets if targets is not None else g.nodes.where("entity_type in ('Function', 'Class')")
    c = pairs(g, "CALLS").join(t.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi")
    n = g.nodes.select("graph_id", F.col("id").alias("src"), "name", F.col("entity_type").alias("type"), "source_file", "start_line")
    return c.join(n, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("target_id"), F.col("src").alias("caller_id"), "name", "type", "source_file", "start_line")


def indirect_impacts(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """(target, caller) over exactly two calls, without direct callers."""
    t = targets if targets is not None else g.nodes.where("entity_type in ('Function', 'Class')")
    e = pairs(g, "CALLS")
    last = e.join(t.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi").select("graph_id", F.col("dst").alias("target_id"), F.col("src").alias("mid"))
    two = last.join(e.select("graph_id", F.col("src").alias("caller_id"), F.col("dst").alias("mid")), ["graph_id", "mid"]).select("graph_id", "target_id", "caller_id").distinct()
    return two.join(e.select("graph_id", F.col("dst").alias("target_id"), F.col("src").alias("caller_id")), ["graph_id", "target_id", "caller_id"], "left_anti")


def test_reach(g: Graph, targets: DataFrame | None = None, hops: int = 3) -> DataFrame:
    """(target, files): the distinct files with `test` in their path from which 1..hops calls reach the target.

    What goes along the calls is (node, file), distinct per step, not (target, caller): callers of one file count once.
    Given targets, only calls that lead to one within `hops` are followed."""
    t = targets if targets is not None else g.nodes.where("entity_type in ('Function', 'Class')")
    t = t.select("graph_id", F.col("id").alias("dst")).distinct()
    e = pairs(g, "CALLS")
    if targets is not None:
        near = t
        for _ in range(hops - 1):
            near = near.unionByName(e.join(near, ["graph_id", "dst"], "left_semi").select("graph_id", F.col("src").alias("dst"))).distinct()
        e = e.join(near, ["graph_id", "dst"], "left_semi")
    step = g.nodes.where(F.contains("source_file", F.lit("test"))).select("graph_id", F.col("id").alias("src"), "source_file")
    seen = None
    for _ in range(hops):
        step = step.join(e, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("src"), "source_file").distinct()
        seen = step if seen is None else seen.unionByName(step)
    seen = seen.withColumnRenamed("src", "dst").join(t, ["graph_id", "dst"], "left_semi")
    return seen.groupBy("graph_id", F.col("dst").alias("target_id")).agg(F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("test_files"))


def risk_level(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """Direct callers plus half the indirect ones: over 20 high, over 5 medium, else low."""
    t = (targets if targets is not None else g.nodes.where("entity_type in ('Function', 'Class')")).select("graph_id", F.col("id").alias("target_id"))
    d = direct_impacts(g, targets).groupBy("graph_id", "target_id").agg(F.count(F.lit(1)).alias("n_direct"))
    i = indirect_impacts(g, targets).groupBy("graph_id", "target_id").agg(F.count(F.lit(1)).alias("n_indirect"))
    return with_risk(t.join(d, ["graph_id", "target_id"], "left").join(i, ["graph_id", "target_id"], "left"))


def with_risk(r: DataFrame) -> DataFrame:
    r = r.fillna(0, ["n_direct", "n_indirect"])
    score = F.col("n_direct") + 0.5 * F.col("n_indirect")
    return r.withColumn("score", score.cast("double")).withColumn("risk", F.when(score > 20, "high").when(score > 5, "medium").otherwise("low"))


def expand(g: Graph, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(graph_id, id, depth): the start set and all that outgoing edges of the walked types reach within `hops`."""
    key = _key(seeds)
    e = pairs(g, *WALKED).distinct()
    front = seeds.select(*key, "id").distinct()
    reached = front.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        # distinct per step bounds the frontier; a node met again keeps its smallest depth in the end
        front = front.withColumnRenamed("id", "src").join(e, ["graph_id", "src"]).select(*key, F.col("dst").alias("id")).distinct()
        reached = reached.unionByName(front.withColumn("depth", F.lit(depth)))
    return reached.groupBy(*key, "id").agg(F.min("depth").alias("depth"))


def node_details(g: Graph, ids: DataFrame) -> DataFrame:
    """Labels and properties of a set of nodes; docstring and type are never stored and stay null."""
    key = _key(ids)
    n = g.nodes.join(ids.select(*key, "id").distinct(), ["graph_id", "id"])
    return n.select(*key, "id", F.array_join("labels", ",").alias("labels"), "name", "description", F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("type"), "source_file", "start_line", "end_line")


def induced_edges(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges inside a set of nodes with the degree of the source in the whole graph and the type's priority."""
    key = _key(ids)
    s = ids.select(*key, "id").distinct()
    e = g.edges.select("graph_id", "src", "dst", "rel_type")
    e = e.join(s.withColumnRenamed("id", "src"), ["graph_id", "src"]).join(s.withColumnRenamed("id", "dst"), [*key, "dst"], "left_semi")
    ends = g.edges.select("graph_id", F.explode(F.array("src", "dst")).alias("src")).groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("degree"))
    e = e.join(ends, ["graph_id", "src"]).withColumn("priority", relationship_priority(F.col("rel_type")))
    return e.select(*key, F.col("src").alias("source_id"), "rel_type", "degree", F.col("dst").alias("target_id"), "priority")


def similar_names(g: Graph, seeds: DataFrame, limit: int = 10, least: float = 0.7, salts: int = 16, block: int = 4_000_000) -> DataFrame:
    """Nodes of the same type as a start node whose name contains its name, is contained in it, or is alike by
    Jaro-Winkler over `least`; the first `limit` per start node by id.

    A search: the start nodes are asked against all. Names are compared, not nodes: each different name of a type once,
    spread over `salts` parts that the start nodes' names are repeated for, so no type is a hot key. Of the nodes of a
    name only the first `limit` + 1 by id can come out. The Python function sees only what containment does not
    decide.

    Beyond `block` pairs of names the nodes are gone through in the order of their ids, a first range of about that
    many pairs, then ranges that reach eight times as far each; a start node with `limit` hits needs no later range, one
    without goes through all."""
    from spanweave.session import cut_lineage

    n = g.nodes.where("name is not null").select("graph_id", "id", "name", "entity_type")
    s = n.where("entity_type in ('Function', 'Class', 'Method')").join(seeds.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi")
    s = cut_lineage(s.select(F.col("graph_id").alias("seed_graph"), F.col("id").alias("seed_id"), F.col("name").alias("seed_name"), "entity_type"))
    r = F.row_number().over(W.partitionBy("entity_type", "name").orderBy("id", "graph_id"))
    first = cut_lineage(n.join(s.select("entity_type").distinct(), "entity_type", "left_semi").withColumn("r", r).where(F.col("r") <= limit + 1).drop("r"))
    many = lambda df, name: df.groupBy("entity_type").agg(F.countDistinct(name).alias(name))
    most = many(first, "name").join(many(s, "seed_name"), "entity_type").agg(F.max(F.col("name") * F.col("seed_name"))).first()[0] or 0
    parts = min(-(-most // block), 512)
    if parts > 1:
        first = cut_lineage(first.repartitionByRange(parts * first.select("entity_type").distinct().count(), "entity_type", "id", "graph_id").withColumn("part", F.spark_partition_id()))
        first = first.join(first.groupBy("entity_type").agg(F.min("part").alias("low")), "entity_type").withColumn("part", F.col("part") - F.col("low")).drop("low")

    def hits(s: DataFrame, first: DataFrame) -> DataFrame:
        names = first.select("entity_type", "name").distinct().withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)))
        asked = s.select("entity_type", "seed_name").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        apart = lambda df: df.repartition(4 * salts, "entity_type", "salt")  # noqa: E731  a number given, as these are few bytes that would else be put together for one task
        p = apart(names).join(apart(asked), ["entity_type", "salt"]).withColumn("inside", F.contains("name", F.col("seed_name")) | F.contains("seed_name", F.col("name")))
        hit = p.where("inside").unionByName(p.where("not inside").where(jaro_winkler("seed_name", "name") > least)).select("entity_type", "seed_name", "name")
        return firsts(s.join(hit, ["entity_type", "seed_name"]).join(first, ["entity_type", "name"]).where("id <> seed_id"))

    def firsts(hit: DataFrame) -> DataFrame:
        r = F.row_number().over(W.partitionBy("seed_graph", "seed_id").orderBy("id", "graph_id"))
        return hit.withColumn("r", r).where(F.col("r") <= limit).select("seed_graph", "seed_id", "seed_name", "id", "name", "entity_type", "graph_id")

    if parts <= 1:
        found = hits(s, first)
    else:
        found, low, high = None, 0, 1
        while True:
            last = high >= parts
            got = hits(s, first.where(F.col("part") >= low if last else F.col("part").between(low, high - 1)))
            found = cut_lineage(got) if found is None else found.unionByName(cut_lineage(got))
            if last:
                break
            full = found.groupBy("seed_graph", "seed_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
            s = cut_lineage(s.join(full, ["seed_graph", "seed_id"], "left_anti"))
            low, high = high, high * 8
        found = firsts(found)
    return found.select("seed_id", "seed_name", "id", "name", "entity_type", "graph_id")


def related_functions(g: Graph, seeds: DataFrame, limit: int = 15) -> DataFrame:
    """Functions one or two undirected CALLS, CONTAINS or IMPORTS steps away, outside the start set; the first `limit`
    of each set by id.

    With one-node sets the second step goes through each node's first `limit` + 1 functions only: no more can come out,
    so a node that everything touches is no hot spot."""
    key = _key(seeds)
    e = pairs(g, "CALLS", "CONTAINS", "IMPORTS")
    both = e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    f = g.nodes.where("entity_type = 'Function'").select("graph_id", "id", "name", "source_file")
    to_functions = both.join(f.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi")
    if len(key) > 1:
        r = F.row_number().over(W.partitionBy("graph_id", "src").orderBy("dst"))
        to_functions = to_functions.withColumn("r", r).where(F.col("r") <= limit + 1).drop("r")
    one = seeds.select(*key, F.col("id").alias("src")).join(both, ["graph_id", "src"]).select(*key, F.col("dst").alias("id")).distinct()
    two = one.withColumnRenamed("id", "src").join(to_functions, ["graph_id", "src"]).select(*key, F.col("dst").alias("id"))
    ids = one.join(f.select("graph_id", "id"), ["graph_id", "id"], "left_semi").unionByName(two).distinct().join(seeds.select(*key, "id"), [*key, "id"], "left_anti")
    ids = ids.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("id"))).where(F.col("r") <= limit).drop("r")
    return ids.join(f, ["graph_id", "id"]).select(*key, "id", "name", "source_file")


def top_files(g: Graph, limit: int = 5) -> DataFrame:
    """The files of each graph with the most distinct children; files without any count with 0."""
    f = g.nodes.where("entity_type = 'File'").select("graph_id", "id", "name")
    n = pairs(g, "CONTAINS").groupBy("graph_id", F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_children"))
    f = f.join(n, ["graph_id", "id"], "left").fillna(0, ["n_children"])
    return f.withColumn("r", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("n_children"), "id"))).where(F.col("r") <= limit).drop("r")


def viz_nodes(g: Graph, limit: int = 500) -> DataFrame:
    """Nodes for drawing, the first `limit` of each graph by id."""
    n = g.nodes.withColumn("r", F.row_number().over(W.partitionBy("graph_id").orderBy("id"))).where(F.col("r") <= limit)
    name, kind = F.coalesce("name", F.lit("None")), F.coalesce("entity_type", F.lit("Unknown"))
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    return n.select("graph_id", "id", F.concat(name, F.lit("\n("), kind, F.lit(")")).alias("label"), F.concat(F.lit("File: "), na("source_file"), F.lit("\nLine: "), na("start_line"), F.lit("\n"), na("description")).alias("title"))


def viz_edges(g: Graph, limit: int = 500) -> DataFrame:
    """Edges for drawing, the first `limit` of each graph by ends and type, numbered from 0."""
    r = F.row_number().over(W.partitionBy("graph_id").orderBy("src", "dst", "rel_type"))
    e = g.edges.withColumn("r", r).where(F.col("r") <= limit)
    return e.select("graph_id", F.concat(F.lit("edge_"), (F.col("r") - 1).cast("string")).alias("edge_id"), F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.col("rel_type").alias("label"), F.concat(F.lit("Relationship: "), "rel_type").alias("title"))


def _any_in(words: Column, text: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def keyword_search(rows: DataFrame, question: str, columns: list[str], order: str, limit: int = 50) -> DataFrame:
    """Rows in which any keyword of the question stands in any of the columns, case aside; the first `limit` by order."""
    words = keywords(F.lit(question))
    hit = None
    for lowered in [F.lower(F.col(c)) for c in columns]:
        h = F.coalesce(_any_in(words, lowered), F.lit(False))
        hit = h if hit is None else hit | h
    return rows.where(hit).orderBy(order).limit(limit)


def random_edges(g: Graph, nodes: int = 100, per_node: int = 5, seed: int = 7) -> DataFrame:
    """A seeded sample for plotting: `nodes` nodes of each graph by hash, and of each the first `per_node` edges of either
    direction by its ends."""
    h = F.md5(F.concat_ws("#", F.lit(str(seed)), "id"))
    n = g.nodes.withColumn("r", F.row_number().over(W.partitionBy("graph_id").orderBy(h, "id"))).where(F.col("r") <= nodes).select("graph_id", "id")
    e = pairs(g).distinct()
    touching = e.withColumn("id", F.explode(F.array("src", "dst"))).join(n, ["graph_id", "id"], "left_semi").distinct()
    r = F.row_number().over(W.partitionBy("graph_id", "id").orderBy("src", "dst"))
    return touching.withColumn("r", r).where(F.col("r") <= per_node).select("graph_id", "src", "dst").distinct()
