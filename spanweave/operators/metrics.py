"""Metrics of graphs, chunks and entities, and the 0-100 score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanweave.functions.text import DEFAULT_DESCRIPTION
from spanweave.operators.graph import Graph
from spanweave.operators.traversal import pairs

#: Token limit that chunks are measured against (fixed value).
TOKEN_LIMIT = 1050
#: Nodes with more neighbours are handled apart when two-step neighbourhoods are counted.
HEAVY_DEGREE = 1000


def node_counts_by_label(g: Graph) -> DataFrame:
    """Nodes per label; a node counts once for each of its labels."""
    return g.nodes.select("graph_id", F.explode("labels").alias("label")).groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n"))


def edge_counts_by_type(g: Graph) -> DataFrame:
    return g.edges.groupBy("graph_id", "rel_type").agg(F.count(F.lit(1)).alias("n"))


def graph_density(g: Graph) -> DataFrame:
    """Nodes, edges, density E / (N (N - 1)) and edges per node; density 0 up to one node."""
    n = g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = g.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    d = n.join(e, "graph_id", "left").fillna(0, ["n_edges"])
    N, E = F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    return d.withColumn("density", F.when(N > 1, E / (N * (N - 1))).otherwise(F.lit(0.0))).withColumn("per_node", E / N)


def neighbours(g: Graph) -> DataFrame:
    """Distinct undirected neighbour pairs in both directions."""
    e = pairs(g)
    return e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def hub_nodes(g: Graph, k: int = 10) -> DataFrame:
    """The k nodes of each graph with the most distinct neighbours."""
    n = neighbours(g).groupBy("graph_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_neighbours"))
    n = n.withColumn("r", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("n_neighbours"), "id"))).where(F.col("r") <= k).drop("r")
    return n.join(g.nodes.select("graph_id", "id", "name", "entity_type"), ["graph_id", "id"])


def _two_steps(n: DataFrame, degree: DataFrame, asked: DataFrame, heavy: int) -> DataFrame:
    """(graph_id, id, n_two): the exact number of distinct two-step neighbours of the nodes asked for."""
    from spanweave.session import cut_lineage

    typed = cut_lineage(n.where("starts").select("graph_id", F.col("src").alias("id"), F.col("dst").alias("u")).join(asked, ["graph_id", "id"], "left_semi").join(degree, ["graph_id", "u"]))
    steps = n.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("w"))
    light = typed.where(F.col("deg") <= heavy).select("graph_id", "id", "u").join(steps, ["graph_id", "u"]).where("w <> id").select("graph_id", "id", "w").distinct()
    by_heavy = typed.where(F.col("deg") > heavy).select("graph_id", "id", F.col("u").alias("h"))
    sets = by_heavy.groupBy("graph_id", "id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    near = steps.withColumnRenamed("u", "h").join(cut_lineage(by_heavy.select("graph_id", "h").distinct()), ["graph_id", "h"], "left_semi")
    union = sets.select("graph_id", "hs").distinct().withColumn("h", F.explode("hs")).join(near, ["graph_id", "h"]).groupBy("graph_id", "hs").agg(F.countDistinct("w").alias("n_union"))
    heavy_n = sets.join(union, ["graph_id", "hs"]).select("graph_id", "id", (F.col("n_union") - 1).alias("n_heavy"))  # the node itself is in it
    covered = light.join(by_heavy, ["graph_id", "id"]).join(near, ["graph_id", "h", "w"], "left_semi").select("graph_id", "id", "w").distinct()
    light_n = light.join(covered, ["graph_id", "id", "w"], "left_anti").groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("n_light"))
    c = asked.select("graph_id", "id").join(heavy_n, ["graph_id", "id"], "left").join(light_n, ["graph_id", "id"], "left").fillna(0)
    return c.select("graph_id", "id", (F.col("n_heavy") + F.col("n_light")).alias("n_two"))


def centrality_nodes(g: Graph, k: int = 10, heavy: int = HEAVY_DEGREE, ahead: int = 10) -> DataFrame:
    """The k functions and classes of each graph with the largest sum of distinct one-step and two-step neighbours.

    No node has more two-step neighbours than its neighbours have others in all. The `ahead` * k nodes of each graph
    with the largest such bound are counted exactly; of the rest only those whose bound reaches the k-th of these counts
    are, as no other can be among the k.

    Two-step neighbours through nodes of up to `heavy` neighbours are joined and made distinct. Through heavier
    ones nothing is paired: all nodes that touch the same set of heavy nodes share one union of their neighbours,
    counted once per such set; what light paths add is what stands next to none of the set."""
    from spanweave.session import cut_lineage

    start = g.nodes.where("entity_type in ('Function', 'Class')").select("graph_id", "id")
    e = pairs(g)
    n = e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).repartition("graph_id", "src").distinct()
    marks = start.select("graph_id", F.col("id").alias("src"), F.lit(True).alias("starts")).distinct()
    n = cut_lineage(n.join(marks, ["graph_id", "src"], "left"))  # read by every step below, all rows of a node together
    degree = n.groupBy("graph_id", F.col("src").alias("u")).agg(F.count(F.lit(1)).alias("deg"))
    one = n.where("starts").select("graph_id", F.col("src").alias("id"), F.col("dst").alias("u")).join(degree, ["graph_id", "u"]).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("n_one"), F.sum("deg").alias("most"))
    bounds = cut_lineage(start.join(one, ["graph_id", "id"], "left").fillna(0))  # n_one + the sum of deg - 1
    best = lambda by: F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc(by), "id"))

    def counted(asked: DataFrame) -> DataFrame:
        c = asked.join(_two_steps(n, degree, asked, heavy), ["graph_id", "id"])
        return c.select("graph_id", "id", "n_one", "n_two", (F.col("n_one") + F.col("n_two")).alias("centrality"))

    done = cut_lineage(counted(cut_lineage(bounds.withColumn("r", best("most")).where(F.col("r") <= ahead * k).drop("r"))))
    kth = done.withColumn("r", best("centrality")).where(F.col("r") == k).select("graph_id", F.col("centrality").alias("least"))
    rest = cut_lineage(bounds.join(kth, "graph_id").where("most >= least").join(done, ["graph_id", "id"], "left_anti").drop("least"))
    if not rest.isEmpty():
        done = done.unionByName(counted(rest))
    return done.withColumn("r", best("centrality")).where(F.col("r") <= k).drop("r")


def connected_components(g: Graph, max_rounds: int = 60) -> DataFrame:
    """(graph_id, id, component): true components, named by their smallest node id.

    Large-star and small-star rounds on the edge list: each replaces edges by ones towards the smallest neighbour
    and converges in a logarithmic number of rounds. The edge list is written to the shared folder each round,
    so lineage stays short and a lost executor costs one round; only a count reaches the driver."""
    from spanweave.session import cut_lineage

    e = cut_lineage(neighbours(g).where("src <> dst").where("src > dst").select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")))
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("graph_id", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, ["graph_id", "a"]).where("b > a").select("graph_id", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("graph_id", "a").agg(F.min("b").alias("m"))
        s = large.join(low2, ["graph_id", "a"])
        small = s.where("b <> m").select("graph_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("graph_id", "a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = cut_lineage(small)
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("graph_id", "a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not converge")
    roots = e.groupBy("graph_id", F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return g.nodes.select("graph_id", "id").join(roots, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("root", "id").alias("component"))


def component_counts(g: Graph) -> DataFrame:
    c = connected_components(g).groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"))


# --------------------------------------------------------------------------------------------------- chunks
def chunk_rows(chunks: DataFrame, text: bool = True, **derived: Column) -> DataFrame:
    """Chunks flat, each id once (the latest row), paths clean, with `tokens` and other values derived from the text.

    Values are worked out before the rows of an id are brought together; without `text` no text is shuffled."""
    from spanweave.functions.text import clean_path, token_count

    c = chunks.select("graph_id", "id", "text", "metadata.*", "indexed_at").withColumn("source_file", clean_path(F.col("source_file")))
    c = c.withColumns({"tokens": token_count(F.col("text")), **derived})
    kept = [*(["text"] if text else []), "source_file", "language", "chunk_index", "start_line", "end_line", "token_count", "tokens", *derived]
    return c.groupBy("graph_id", "id").agg(F.max_by(F.struct(*kept), F.struct("indexed_at", "source_file")).alias("r")).select("graph_id", "id", "r.*")


def token_stats(chunks: DataFrame) -> DataFrame:
    """Smallest, largest, mean and upper median of the tokens per chunk of each graph.

    The median is read from the histogram of token counts by a running sum; no list is gathered."""
    c = chunk_rows(chunks, False)
    h = c.groupBy("graph_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("graph_id").orderBy("tokens")
    h = h.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy("graph_id")))
    median = h.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("graph_id").agg(F.min("tokens").alias("median_tokens"))
    s = c.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"), F.round(F.avg("tokens"), 6).alias("avg_tokens"))
    return s.join(median, "graph_id")


def token_histogram(chunks: DataFrame, width: int = 100) -> DataFrame:
    lo = (F.floor(F.col("tokens") / width) * width).cast("int")
    h = chunk_rows(chunks, False).groupBy("graph_id", lo.alias("lo")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("graph_id", F.concat(F.col("lo").cast("string"), F.lit("-"), (F.col("lo") + width).cast("string")).alias("bucket"), "n")


def overlap_lines(chunks: DataFrame) -> DataFrame:
    """Lines that consecutive chunks of a file share, by (start, end) order."""
    w = W.partitionBy("graph_id", "source_file").orderBy("start_line", "end_line", "id")
    c = chunk_rows(chunks, False).where("start_line is not null and end_line is not null").withColumn("next", F.lead("start_line").over(w))
    over = F.when(F.col("end_line") >= F.col("next"), F.col("end_line") - F.col("next") + 1).otherwise(0)
    return c.withColumn("over", over).groupBy("graph_id").agg(F.sum("over").cast("long").alias("overlap_lines"), F.count_if(F.col("over") > 0).alias("n_overlaps"))


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunk_rows(chunks, False).groupBy("graph_id", "source_file").agg(F.count(F.lit(1)).alias("n_chunks"))


def whitespace_tokens(chunks: DataFrame) -> DataFrame:
    """Mean number of white-space separated words per chunk."""
    from spanweave.functions.text import word_count

    return chunk_rows(chunks, False, words=word_count(F.coalesce("text", F.lit("")))).groupBy("graph_id").agg(F.round(F.avg("words"), 6).alias("avg_words"))


# ------------------------------------------------------------------------------------------------- entities
def entity_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy("graph_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def description_stats(g: Graph) -> DataFrame:
    """Lengths of the entities' descriptions and how many are defaults, in number and per cent."""
    n = g.nodes.where("description is not null")
    ours = F.startswith("description", F.lit(DEFAULT_DESCRIPTION))
    return n.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_entities"), F.min(F.length("description")).alias("min_length"), F.max(F.length("description")).alias("max_length"),
        F.round(F.avg(F.length("description")), 6).alias("avg_length"), F.count_if(ours).alias("n_default"),
        F.round(F.count_if(ours) * 100.0 / F.count(F.lit(1)), 6).cast("double").alias("pct_default"),
    )


#: Factors and bounds of the score and its grades (fixed values).
PER_NODE, USE, USE_OFF, DENSITY, SHARE = 8, 36, 1, 25_000, 25
GRADES = {"overall": (40, 70), "per_node": (1, 3), "use": (0.5, 0.7)}
DEFAULTS_POOR, DEFAULTS_FAIR = 80, 20


def quality_score(g: Graph, chunks: DataFrame) -> DataFrame:
    """The four partial scores of 0-25, their sum on 0-100 and the grades. A graph without chunks or without described
    entities has 0 for that part."""
    d = graph_density(g).join(token_stats(chunks).select("graph_id", "avg_tokens"), "graph_id", "left").join(description_stats(g).select("graph_id", "pct_default"), "graph_id", "left")
    d = d.fillna(0.0, ["avg_tokens"]).fillna(100.0, ["pct_default"])
    cap = lambda c: F.least(F.lit(25.0), F.greatest(F.lit(0.0), c))
    use = F.col("avg_tokens") / TOKEN_LIMIT
    d = d.select("graph_id", cap(F.col("per_node") * PER_NODE).alias("graph_score"), cap(use * USE - USE_OFF).alias("chunk_score"), cap(SHARE * (1 - F.col("pct_default") / 100)).alias("entity_score"), cap(F.col("density") * DENSITY).alias("connectivity_score"), "per_node", use.alias("use"), "pct_default")
    total = (F.col("graph_score") + F.col("chunk_score") + F.col("entity_score") + F.col("connectivity_score"))
    grade = lambda c, lo, hi: F.when(c < lo, "poor").when(c < hi, "fair").otherwise("good")
    d = d.withColumn("overall", total)
    return d.select("graph_id", *[F.round(c, 6).alias(c) for c in ("graph_score", "chunk_score", "entity_score", "connectivity_score", "overall")],
                    grade(F.col("overall"), *GRADES["overall"]).alias("grade"), grade(F.col("per_node"), *GRADES["per_node"]).alias("graph_grade"), grade(F.col("use"), *GRADES["use"]).alias("chunk_grade"),
                    F.when(F.col("pct_default") > DEFAULTS_POOR, "poor").when(F.col("pct_default") > DEFAULTS_FAIR, "fair").otherwise("good").alias("entity_grade"))
