"""Reading and writing: source trees, JSON lists, plain lines, index metadata, vector tables, reports."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def python_files(spark: SparkSession, root: str, graph_id: str, pattern: str = "*.[pP][yY]") -> DataFrame:
    """(graph_id, path, content) of all Python files under `root`; bytes that are no UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    return decoded(raw).select(F.lit(graph_id).alias("graph_id"), "path", "content")


def decoded(raw: DataFrame) -> DataFrame:
    """(path, content) with bytes decoded leniently."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if x is None else bytes(x).decode("utf-8", "ignore") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["path", "content"])

    return raw.mapInArrow(run, "path string, content string")


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, wherever Hadoop's file systems reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def cloned(url: str, folder: str) -> str:
    """A shallow clone of a repository into a folder that all executors share; the folder. Needs git; a failure raises."""
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", url, folder], check=True, capture_output=True)
    return folder


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def line_tokens(lines: DataFrame) -> DataFrame:
    """Number of words over all lines that are not blank."""
    t = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.where(t != "").select(F.explode(F.split(t, r"\s+")).alias("w")).agg(F.count(F.lit(1)).alias("n_tokens"))


def index_metadata_row(spark: SparkSession, index_id: str, files: DataFrame, n_entities: int, n_chunks: int, token_limit: int, embedding_model: str) -> DataFrame:
    """The metadata row of an index, with the limit that was used."""
    f = files.select("path").distinct().orderBy("path").limit(25).agg(F.array_sort(F.collect_list("path")).alias("processed_files"))  # a sample of 25
    return f.select(F.lit(index_id).alias("index_id"), F.current_timestamp().alias("indexed_at"), "processed_files", F.lit(f"{index_id}_entities").alias("entity_vector_collection"),
                    F.lit(f"{index_id}_chunks").alias("chunk_vector_collection"), F.lit("structure_aware").alias("chunking_strategy"), F.lit(token_limit).alias("token_limit_per_chunk"),
                    F.lit(embedding_model).alias("embedding_model"), F.lit(n_entities).alias("num_unique_entities_processed"), F.lit(n_chunks).alias("num_text_chunks_processed"), F.lit("python").alias("language_processed"))


def latest_index(metadata: DataFrame) -> DataFrame:
    """The index written last, ties by id."""
    return metadata.orderBy(F.desc_nulls_last("indexed_at"), "index_id").limit(1)


def collections(metadata: DataFrame) -> DataFrame:
    """The vector collections of every index."""
    return metadata.select("index_id", F.explode(F.array("entity_vector_collection", "chunk_vector_collection")).alias("collection")).where("collection is not null").distinct()


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors by graph, so that one graph is read by partition pruning."""
    vectors.write.mode("overwrite").partitionBy("graph_id").parquet(path)


def report(score: DataFrame) -> DataFrame:
    """One JSON report per graph."""
    return score.select("graph_id", F.to_json(F.struct(*[c for c in score.columns if c != "graph_id"])).alias("report"))
