"""Retrieval and answer metrics: precision, recall, reciprocal rank, exact match, BLEU and ROUGE, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ranked_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: precision and recall at k and the reciprocal rank of the first relevant hit (0 without any).
    hits: (query_id, rank, vec_id); relevant: (query_id, vec_id, n_relevant)."""
    h = hits.join(relevant.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    total = relevant.groupBy("query_id").agg(F.max("n_relevant").alias("n_relevant"))
    m = h.groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("n_hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    m = m.join(total, "query_id", "left")
    return m.select("query_id", F.round(F.col("n_hits") / k, 6).alias("precision"), F.round(F.coalesce(F.col("n_hits") / F.col("n_relevant"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def overlap_scores(rows: DataFrame, key: str, candidate: str, reference: str, order: int = 2) -> DataFrame:
    """BLEU up to `order`-grams with brevity penalty (0 if any order has no match) and ROUGE-1 to ROUGE-`order` F-measures
    per key.

    N-grams are exploded and counted, clipped by the other side's count; rows without words score 0."""
    w = rows.select(F.col(key).alias("k"), words(F.col(candidate)).alias("c"), words(F.col(reference)).alias("r"))
    grams = None
    for side in ("c", "r"):
        for n in range(1, order + 1):
            g = w.select("k", F.lit(n).alias("n"), F.lit(side).alias("side"), F.explode(_spans(side, n)).alias("g"))
            grams = g if grams is None else grams.unionByName(g)
    m = grams.groupBy("k", "n", "g").agg(F.count_if(F.col("side") == "c").alias("a"), F.count_if(F.col("side") == "r").alias("b"))
    hits = m.groupBy("k").agg(*[F.sum(F.when(F.col("n") == n, F.least("a", "b"))).alias(f"h{n}") for n in range(1, order + 1)])
    d = w.select("k", F.size("c").alias("nc"), F.size("r").alias("nr")).join(hits, "k", "left")
    logs = sum((F.log(F.nullif(F.col(f"h{n}"), F.lit(0)) / F.nullif(F.col("nc") - (n - 1), F.lit(0))) for n in range(1, order + 1)), F.lit(0.0))
    penalty = F.when(F.col("nc") >= F.col("nr"), F.lit(1.0)).otherwise(F.exp(1 - F.col("nr") / F.nullif("nc", F.lit(0))))
    size = lambda c, n: F.greatest(F.col(c) - (n - 1), F.lit(0))
    rouge = [F.round(F.coalesce(2.0 * F.col(f"h{n}") / F.nullif(size("nc", n) + size("nr", n), F.lit(0)), F.lit(0.0)), 6).alias(f"rouge_{n}") for n in range(1, order + 1)]
    return d.select("k", F.round(F.coalesce(F.exp(logs / order) * penalty, F.lit(0.0)), 6).alias("bleu"), *rouge)


def _spans(side: str, n: int) -> Column:
    """The n-grams of an array column; null if it is shorter."""
    at = F.sequence(F.lit(1), F.size(side) - n + 1)
    return F.when(F.size(side) >= n, F.transform(at, lambda i: F.array_join(F.slice(F.col(side), i, F.lit(n)), " ")))


@F.pandas_udf(T.DoubleType())
def _longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        row = np.zeros(len(y) + 1, dtype=np.int64)
        y = np.asarray(y)
        for w in x:  # of each prefix of y: the row before plus a match, or the best so far
            met = np.concatenate([[0], np.where(y == w, row[:-1] + 1, 0)])
            row = np.maximum.accumulate(np.maximum(row, met))
        out.append(float(row[-1]))
    return pd.Series(out, dtype="float64")


def rouge_l(candidate: Column, reference: Column) -> Column:
    """ROUGE-L F-measure of two texts: their longest common subsequence of words; 0 where either has none."""
    a, b = words(candidate), words(reference)
    return F.round(F.coalesce(2.0 * _longest_common(a, b) / F.nullif(F.size(a) + F.size(b), F.lit(0)), F.lit(0.0)), 6)


def grounding(answer: Column, context: Column) -> Column:
    """Share of an answer's different words that its context has; null for an answer without words. What stands in for
    faithfulness, and with the question as context for relevance, where no model judges."""
    a = F.array_distinct(words(answer))
    return F.round(F.size(F.array_intersect(a, words(context))) / F.nullif(F.size(a), F.lit(0)), 6)


def exact_match(candidate: Column, reference: Column) -> Column:
    return F.coalesce(words(candidate) == words(reference), F.lit(False))


def call_coverage(edges: DataFrame) -> DataFrame:
    """Share of calls that resolve to a definition of the graph."""
    e = edges.where("rel_type = 'CALLS'")
    outside = F.col("dst").startswith("PotentialFunction:") | F.col("dst").startswith("BuiltinFunction:")
    return e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(~outside).alias("n_resolved"), F.round(F.count_if(~outside) / F.count(F.lit(1)), 6).alias("coverage"))


def schema_adherence(edges: DataFrame, allowed: list[str]) -> DataFrame:
    ok = F.col("rel_type").isin(*allowed)
    return edges.groupBy("graph_id").agg(F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("adherence"))


def accuracy(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of one set of keys against another, in one row."""
    a, b = found.select(*keys).distinct(), truth.select(*keys).distinct()
    both = a.join(b, keys, "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    n = a.agg(F.count(F.lit(1)).alias("n_found")), b.agg(F.count(F.lit(1)).alias("n_truth"))
    one = lambda d: d.withColumn("k", F.lit(1))
    d = one(both).join(one(n[0]), "k").join(one(n[1]), "k")
    p, r = F.coalesce(F.col("hit") / F.nullif("n_found", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("hit") / F.nullif("n_truth", F.lit(0)), F.lit(0.0))
    return d.select("hit", "n_found", "n_truth", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"))
