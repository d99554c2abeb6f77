"""The property graph: nodes and edges built from entities, and keyed upserts of either.

Resolution joins are equi-joins on (graph, file, name) against counted lookups, linear in the entities. Edges are
unique per (graph, src, dst, type), self-loops and edges without an endpoint are dropped, types are upper case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import BUILTINS, default_description, last_segment, sanitize_id, sanitize_label, sanitize_path, sanitize_relationship
from spanweave.operators.dedup import unique_entities, valid_entities
from spanweave.schemas import EDGE_COLUMNS, EDGE_PROPS, NODE_COLUMNS


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def file_id(graph, path):  # noqa: ANN001, ANN201
    return F.concat(F.lit("File:"), graph, F.lit(":"), sanitize_path(path))


def placeholder_id(kind, graph, name):  # noqa: ANN001, ANN201
    return F.concat(kind, F.lit(":"), graph, F.lit(":"), sanitize_id(name))


def _props(**given):  # noqa: ANN003, ANN202
    names = [p.split(":") for p in EDGE_PROPS[7:-1].split(",")]
    return F.struct(*[(given.get(n, F.lit(None)).cast(t)).alias(n) for n, t in names])


def _lookup(unique: DataFrame, types: list[str], with_type: bool) -> DataFrame:
    """(graph, file, name[, type]) -> number of definitions and the id if there is one."""
    keys = ["graph_id", "source_file", "name", *(["entity_type"] if with_type else [])]
    return unique.where(F.col("entity_type").isin(*types)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("def_id"))


def call_edges(unique: DataFrame) -> DataFrame:
    """CALLS edges with the placeholder's kind and name where the callee is no definition of the file."""
    calls = unique.where("entity_type = 'Call'").select("graph_id", "source_file", "name", "parent_type", "parent_name", "start_line", "id", "seq")
    callers = _lookup(unique, ["Function", "Class"], True).select("graph_id", "source_file", F.col("name").alias("parent_name"), F.col("entity_type").alias("parent_type"), F.col("n").alias("n_caller"), F.col("def_id").alias("caller_id"))
    callees = _lookup(unique, ["Function", "Class"], False).select("graph_id", "source_file", F.col("name").alias("simple"), F.col("n").alias("n_callee"), F.col("def_id").alias("callee_id"))
    c = calls.withColumn("simple", last_segment(F.col("name")))
    c = c.join(callers, ["graph_id", "source_file", "parent_name", "parent_type"], "left").join(callees, ["graph_id", "source_file", "simple"], "left")
    src = F.when(F.col("parent_type").isNull() | F.col("parent_name").isNull(), file_id(F.col("graph_id"), F.col("source_file"))).when(F.col("n_caller") == 1, F.col("caller_id")).otherwise(F.col("id"))
    builtin = F.col("name").isin(*BUILTINS)
    kind = F.when(builtin, "BuiltinFunction").otherwise("PotentialFunction")
    known = F.col("n_callee") == 1
    dst = F.when(known, F.col("callee_id")).otherwise(placeholder_id(kind, F.col("graph_id"), F.col("name")))
    return c.select("graph_id", src.alias("src"), dst.alias("dst"), F.lit("CALLS").alias("rel_type"), _props(line=F.col("start_line"), is_builtin=F.when(~F.coalesce(known, F.lit(False)), builtin)).alias("props"),
                    F.when(~F.coalesce(known, F.lit(False)), F.col("name")).alias("placeholder"), kind.alias("kind"), "seq")


def _edges(unique: DataFrame, calls: DataFrame) -> DataFrame:
    in_file = file_id(F.col("graph_id"), F.col("source_file"))
    contains = unique.select("graph_id", in_file.alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("rel_type"), _props(start=F.col("start_line"), end=F.col("end_line")).alias("props"), "seq")
    classes = _lookup(unique, ["Class"], False).where("n = 1").select("graph_id", "source_file", F.col("name").alias("parent_name"), "def_id")
    methods = unique.where("entity_type = 'Function' and parent_type = 'Class'").join(classes, ["graph_id", "source_file", "parent_name"])
    methods = methods.select("graph_id", F.col("def_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS_METHOD").alias("rel_type"), _props(line=F.col("start_line")).alias("props"), "seq")
    imports = unique.where("entity_type in ('Import', 'ImportFrom')")
    imports = imports.select("graph_id", in_file.alias("src"), F.col("id").alias("dst"), F.lit("IMPORTS").alias("rel_type"),
                             _props(line=F.col("start_line"), module=F.coalesce("module_name", "name"), items=F.substring(F.to_json("imported_items"), 1, 1000)).alias("props"), "seq")
    return contains.unionByName(methods).unionByName(imports).unionByName(calls.drop("placeholder", "kind"))


def upsert_edges(new: DataFrame, nodes: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
    """One edge per (graph, src, dst, type): the last properties by `seq` win. Rows without an end, self-loops and,
    given nodes, edges whose ends are no nodes are dropped; `old` edges lose against new ones."""
    e = new.where("src is not null and dst is not null and src <> dst").withColumn("rel_type", sanitize_relationship(F.col("rel_type"))).withColumn("age", F.lit(1))
    if old is not None:
        e = old.select(*EDGE_COLUMNS, F.lit(0).cast("long").alias("seq"), F.lit(0).alias("age")).unionByName(e.select(*EDGE_COLUMNS, "seq", "age"))
    e = e.groupBy("graph_id", "src", "dst", "rel_type").agg(F.max_by("props", F.struct("age", "seq")).alias("props"))
    if nodes is not None:
        ids = nodes.select("graph_id", "id")
        e = e.join(ids.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")
    return e.select(*EDGE_COLUMNS)


def upsert_nodes(new: DataFrame, old: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """One node per (graph, id): all properties of the last write, labels of old and new united."""
    rest = [c for c in NODE_COLUMNS if c not in ("graph_id", "id", "labels")]
    n = new.where("id is not null").select(*NODE_COLUMNS, F.col(order).cast("long").alias("seq"), F.lit(1).alias("age"))
    if old is not None:
        n = n.unionByName(old.select(*NODE_COLUMNS, F.lit(0).cast("long").alias("seq"), F.lit(0).alias("age")))
    g = n.groupBy("graph_id", "id").agg(F.max_by(F.struct(*rest), F.struct("age", "seq")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"))
    return g.select("graph_id", "id", "labels", *[f"r.{c}" for c in rest])


def upsert_placeholders(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Placeholders (graph_id, id, kind, name, seen): created_at is the first and last_seen the last sighting."""
    n = new.select("graph_id", "id", "kind", "name", F.col("seen").alias("created_at"), F.col("seen").alias("last_seen"))
    if old is not None:
        n = n.unionByName(old.select("graph_id", "id", "kind", "name", "created_at", "last_seen"))
    return n.groupBy("graph_id", "id").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), F.min("created_at").alias("created_at"), F.max("last_seen").alias("last_seen"))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """The uniqueness constraint as a query: it holds if no row comes out."""
    return nodes.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def build_graph(entities: DataFrame, mode: str = "clean") -> Graph:
    """Nodes and edges of all graphs in `entities` (any records with the entity columns)."""
    return graph_of_unique(unique_entities(valid_entities(entities), mode))


def graph_of_unique(unique: DataFrame) -> Graph:
    """Nodes and edges of deduplicated entities; they are read by many steps and are best a written table."""
    calls = call_edges(unique)
    label = sanitize_label(F.col("entity_type"))
    own = unique.select("graph_id", "id", F.array(F.lit("KGNode"), label).alias("labels"), "entity_type", "name", "source_file", "start_line", "end_line",
                        default_description(F.col("description"), F.col("entity_type"), F.col("name")).alias("description"))
    none = lambda t: F.lit(None).cast(t)
    files = unique.where("source_file is not null").select("graph_id", "source_file").distinct()
    files = files.select("graph_id", file_id(F.col("graph_id"), F.col("source_file")).alias("id"), F.array(F.lit("KGNode"), F.lit("File")).alias("labels"), F.lit("File").alias("entity_type"),
                         F.substring_index("source_file", "/", -1).alias("name"), "source_file", none("int").alias("start_line"), none("int").alias("end_line"), none("string").alias("description"))
    marks = calls.where("placeholder is not null").groupBy("graph_id", F.col("dst").alias("id"), "kind").agg(F.min("placeholder").alias("name"))
    marks = marks.select("graph_id", "id", F.array(F.lit("KGNode"), F.col("kind")).alias("labels"), F.col("kind").alias("entity_type"), "name", none("string").alias("source_file"),
                         none("int").alias("start_line"), none("int").alias("end_line"), none("string").alias("description"))
    nodes = own.unionByName(files).unionByName(marks)
    return Graph(nodes.select(*NODE_COLUMNS), upsert_edges(_edges(unique, calls)))
