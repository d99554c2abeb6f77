"""Exact vector search: every query vector against all vectors, in blocks.

Up to one block of queries goes to the tasks with the closure: vectors stream through Arrow batches, a partition keeps
its own k best by one matrix product, and k rows per query and partition are shuffled. More queries than that are cut
into blocks by hash, vectors too, and each pair of blocks is one group of a join: nothing is collected, no block is
larger than its bound allows, and k rows per query and block of vectors are left. Squared Euclidean distance in doubles.

Null vectors and vectors of another length than the query match nothing; ties go to the smaller id; k larger than
the table gives all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanweave.functions.similarity import squared_l2

#: Queries in a block; vectors in a block of the join.
BLOCK, VECTORS = 4096, 65_536


def topk_block(vectors: DataFrame, ids: list[int], queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, distance) of the k nearest vectors per partition for one block of queries."""
    q = np.asarray(queries, dtype=np.float64)
    qid = np.asarray(ids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.full((len(q), 0), 0.0)
        best_i = np.zeros((len(q), 0), dtype=np.int64)
        for b in batches:
            rows = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None and v is not None and len(v) == q.shape[1] and None not in v]
            if not rows or not len(q):
                continue
            x = np.array([v for _, v in rows], dtype=np.float64)
            vid = np.array([i for i, _ in rows], dtype=np.int64)
            # the product form picks candidates with room for its rounding; differences then give the exact order
            approx = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * q @ x.T
            for s in range(len(q)):
                m = min(len(vid), k + 16)
                near = np.argpartition(approx[s], m - 1)[:m] if m < len(vid) else np.arange(len(vid))
                if m < len(vid):
                    near = np.flatnonzero(approx[s] <= approx[s][near].max() + 1e-9)
                d = ((x[near] - q[s]) ** 2).sum(1)
                merged_d, merged_i = np.concatenate([best_d[s], d]), np.concatenate([best_i[s], vid[near]])
                o = np.lexsort((merged_i, np.round(merged_d, 12)))[:k]
                if s == 0:
                    new_d, new_i = np.full((len(q), len(o)), np.inf), np.zeros((len(q), len(o)), dtype=np.int64)
                new_d[s, : len(o)], new_i[s, : len(o)] = merged_d[o], merged_i[o]
            best_d, best_i = new_d, new_i
        if best_d.shape[1]:
            w = best_d.shape[1]
            keep = np.isfinite(best_d.ravel())
            cols = [np.repeat(qid, w)[keep], best_i.ravel()[keep], best_d.ravel()[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "distance"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, distance double")


def _block_join(v: DataFrame, q: DataFrame, k: int, block: int, most: int = VECTORS) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest vectors of each query out of each block of vectors."""
    n_q, n_v = (max(1, -(-d.count() // size)) for d, size in ((q, block // 2), (v, most // 2)))  # half full on average
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn("vb", every(n_v))
    right = v.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(n_v))).withColumn("qb", every(n_q))

    def nearest(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        size = rows["embedding"].map(len) if len(rows) else None
        for dims, group in queries.groupby(queries["q"].map(len)) if len(queries) and len(rows) else ():
            near = rows[size == dims]
            x = np.array(near["embedding"].tolist(), dtype=np.float64).reshape(len(near), dims)
            ids = near["vec_id"].to_numpy()
            whole = ~np.isnan(x).any(axis=1)
            x, ids = x[whole], ids[whole]
            for i, one in zip(group["query_id"], group["q"]):
                d = np.round(((x - np.asarray(one, dtype=np.float64)) ** 2).sum(axis=1), 12)
                least = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                for j in least[np.lexsort((ids[least], d[least]))][:k]:
                    out.append((i, ids[j], d[j]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "distance"]).astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(nearest, "query_id long, vec_id long, distance double")


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, distance). `vectors` and `queries` have (id, embedding); the distances reported are
    recomputed by a JVM expression on the winners."""
    v = vectors.select(vectors.columns[0], vectors.columns[1]).toDF("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    q = queries.select(queries.columns[0], queries.columns[1]).toDF("query_id", "q").where("query_id is not null and q is not null")
    first = q.orderBy("query_id").limit(block + 1).collect()
    if len(first) > block:
        out = _block_join(v, q, k, block)
    else:
        by_len: dict[int, list] = {}
        for r in first:
            by_len.setdefault(len(r["q"]), []).append(r)
        out = v.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
        for rows in by_len.values():
            out = out.unionByName(topk_block(v, [r["query_id"] for r in rows], np.array([r["q"] for r in rows], dtype=np.float64), k))
    w = W.partitionBy("query_id").orderBy(F.round("distance", 12), "vec_id")
    best = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("distance")
    best = best.join(q, "query_id").join(v, "vec_id")
    return best.select("query_id", "rank", "vec_id", F.round(squared_l2(F.col("q"), F.col("embedding")), 6).alias("distance"))


def topk_one(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k nearest vectors of one query given as numbers: one scan, a bounded heap per task."""
    v = vectors.select(vectors.columns[0], vectors.columns[1]).toDF("vec_id", "embedding")
    d = squared_l2(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return v.withColumn("distance", d).where("distance is not null").orderBy("distance", "vec_id").limit(k).select("vec_id", F.round("distance", 6).alias("distance"))


def min_merge(hits: DataFrame) -> DataFrame:
    """Hits of several query texts merged: each vector once, with its smallest distance and the number of hits."""
    return hits.groupBy("vec_id").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("n_queries"))


def hash_embedding(texts: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """(id, embedding): the embedder without a model. Words are hashed to `dims` signed buckets and the counts are
    scaled to length 1. Null and empty texts give the zero vector."""
    import zlib

    src = texts.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                v = np.zeros(dims)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dims] += 1.0 if h & 0x80000000 else -1.0
                n = float(np.sqrt((v * v).sum()))
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return src.mapInArrow(run, f"{id_col} {src.schema[0].dataType.simpleString()}, embedding array<float>")
