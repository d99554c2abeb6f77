"""Deduplication of extracted entities (one rule per type) and of anything keyed.

Partial aggregates throughout: a key that holds a third of all rows is reduced before the shuffle. Nulls in a key
count as the empty string; ties go to the smallest sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import clean_path, stable_id

KEPT = ["name", "source_file", "start_line", "end_line", "start_byte", "end_byte", "snippet", "parent_type", "parent_name", "module_name", "imported_items", "description", "seq"]


def valid_entities(entities: DataFrame, seq: str = "rec_id") -> DataFrame:
    """Entities with type, name and graph, a clean file path and the sequence number `seq`."""
    e = entities.where("entity_type is not null and name is not null and graph_id is not null")
    return e.withColumn("source_file", clean_path(F.col("source_file"))).withColumn("name", F.trim("name")).withColumn("seq", F.col(seq).cast("long"))


def entity_key(mode: str = "clean") -> Column:
    """The key under which records are one entity. `reference` drops the parent of functions and classes, which
    merges methods of the same name in different classes of a file."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parent = text("parent_name") if mode == "clean" else F.lit("")
    rest = (
        F.when(F.col("entity_type").isin("Function", "Class"), parent)
        .when(F.col("entity_type") == "Call", F.concat_ws("|", text("parent_type"), text("parent_name"), text("start_byte")))
        .when(F.col("entity_type") == "Import", F.lit(""))
        .when(F.col("entity_type") == "ImportFrom", F.coalesce(F.array_join(F.array_sort("imported_items"), ","), F.lit("")))
        .otherwise(text("start_byte"))
    )
    return F.md5(F.concat_ws("\u0001", F.col("graph_id"), F.col("entity_type"), F.col("name"), text("source_file"), rest))


def unique_entities(entities: DataFrame, mode: str = "clean") -> DataFrame:
    """One row per entity, with its id: functions and classes keep the longest snippet, all others the first record."""
    e = entities.withColumn("key", entity_key(mode))
    longest = F.when(F.col("entity_type").isin("Function", "Class"), -F.coalesce(F.length("snippet"), F.lit(0))).otherwise(F.lit(0))
    row = F.struct(*KEPT)
    u = e.groupBy("graph_id", "entity_type", "key").agg(F.min_by(row, F.struct(longest.alias("l"), "seq")).alias("r"), F.count(F.lit(1)).alias("n_records"))
    u = u.select("graph_id", "entity_type", "key", "n_records", "r.*")
    return u.withColumn("id", stable_id(F.concat_ws("_", "entity_type", "name"), F.col("key"))).drop("key")


def dedup_counts(entities: DataFrame, mode: str = "clean") -> DataFrame:
    """Records, entities and duplicates per graph and type."""
    u = unique_entities(entities, mode)
    return u.groupBy("graph_id", "entity_type").agg(F.sum("n_records").alias("n_records"), F.count(F.lit(1)).alias("n_entities"), (F.sum("n_records") - F.count(F.lit(1))).alias("n_duplicates"))


def keep_best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in `order`, by a partial aggregate instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r")).select(*keys, "r.*")
