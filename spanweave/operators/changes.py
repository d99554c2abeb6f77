"""Change points, their ranking and the code patterns of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.graph import Graph
from spanweave.operators.traversal import class_methods


def insertion_points(g: Graph) -> DataFrame:
    """Per class where a method can be added: after its last method by line, or at the class's end."""
    last = class_methods(g).groupBy("graph_id", "class_id").agg(F.max_by(F.struct("method", "end_line"), F.struct("start_line", "method_id")).alias("m"), F.count(F.lit(1)).alias("n_methods"))
    c = g.nodes.where("entity_type = 'Class'").select("graph_id", F.col("id").alias("class_id"), "name", "end_line").join(last, ["graph_id", "class_id"], "left")
    has = F.col("m").isNotNull()
    return c.select("graph_id", "class_id", "name", F.when(has, "after_method").otherwise("end_of_class").alias("place"), F.col("m.method").alias("after"), F.coalesce("m.end_line", "end_line").alias("line"), F.coalesce("n_methods", F.lit(0)).alias("n_methods"))


def change_points(g: Graph, hits: DataFrame, kind: str) -> DataFrame:
    """Ranked change points of retrieved entities. `hits` has (graph_id, id, ord). Classes get insertion points for
    add_method, functions their body line for modify_function, all others count as related. Score: 10, or 5 for
    related ones, 3 more with points, 1 more with a name; equal scores keep the order of the hits."""
    n = hits.join(g.nodes.select("graph_id", "id", "name", "entity_type", "source_file", "start_line"), ["graph_id", "id"]).where("entity_type in ('Function', 'Class', 'Method')")
    points = insertion_points(g).select("graph_id", F.col("class_id").alias("id"), F.col("line").alias("insert_line"))
    n = n.join(points, ["graph_id", "id"], "left")
    insert = (F.col("entity_type") == "Class") & F.lit(kind == "add_method")
    modify = (F.col("entity_type") == "Function") & F.lit(kind == "modify_function")
    n = n.withColumn("change", F.when(insert, "add_method").when(modify, "modify_function").otherwise("related_change"))
    n = n.withColumn("line", F.when(insert, F.col("insert_line")).when(modify, F.col("start_line") + 1))
    score = F.when(F.col("change") == "related_change", 5).otherwise(10) + F.when(F.col("line").isNotNull(), 3).otherwise(0) + F.when(F.col("name").isNotNull(), 1).otherwise(0)
    return n.select("graph_id", "id", "name", "entity_type", "source_file", "change", "line", score.alias("score"), "ord").orderBy(F.desc("score"), "ord")


def naming_class(name: Column) -> Column:
    """snake_case, camelCase or PascalCase of one name."""
    rest = F.substring(name, 2, 1 << 30)
    return F.when(F.contains(name, F.lit("_")), "snake_case").when(F.substring(name, 1, 1).rlike(r"^\p{Lu}"), "PascalCase").when(rest.rlike(r"\p{Lu}"), "camelCase").otherwise("snake_case")


#: What names are read by (fixed values, which define the published vote); the variable pattern enters each word once, at its start.
NAME_PATTERNS = {"class": r"class\s+([A-Za-z0-9_]+)", "function": r"def\s+([A-Za-z0-9_]+)", "variable": r"(?<![A-Za-z0-9_])[A-Z0-9_]*+([a-z][A-Za-z0-9_]++)\s*="}


def _style_counts(names: Column) -> Column:
    """(s, c, p): how many names are of each style."""
    count = lambda k: F.size(F.filter(names, lambda n: (n != "") & (naming_class(n) == k))).cast("long")
    return F.struct(count("snake_case").alias("s"), count("camelCase").alias("c"), count("PascalCase").alias("p"))


def naming_counts(text: Column) -> Column:
    """One struct of style counts per kind of name."""
    return F.struct(*[_style_counts(F.regexp_extract_all(text, F.lit(p), F.lit(1))).alias(k) for k, p in NAME_PATTERNS.items()])


#: What errors and comments are counted by (fixed values).
ERROR_PATTERNS = {"n_try": "try:", "n_specific": r"except\s+[A-Za-z0-9_]+", "n_bare": "except:"}
DOC_PATTERNS = {"n_double": r'(?s)""".*?"""', "n_single": r"(?s)'''.*?'''", "n_hash": "#"}


def _pattern_counts(text: Column, patterns: dict[str, str]) -> Column:
    return F.struct(*[F.regexp_count(text, F.lit(p)).cast("long").alias(k) for k, p in patterns.items()])


def error_counts(text: Column) -> Column:
    return _pattern_counts(text, ERROR_PATTERNS)


def doc_counts(text: Column) -> Column:
    return _pattern_counts(text, DOC_PATTERNS)


def _counted(chunks: DataFrame, counts: Column, by: str, key: str | None) -> DataFrame:
    """Counts per chunk, worked out where the text is read; with `key`, each key once. Only counts are shuffled."""
    c = chunks.where("text is not null").select(by, *([key] if key else []), counts.alias("n"))
    return c.groupBy(by, key).agg(F.max("n").alias("n")) if key else c


def naming_votes(chunks: DataFrame, by: str = "graph_id", key: str | None = None) -> DataFrame:
    """The naming convention of classes, functions and variables per group; ties go snake, camel, Pascal."""
    c = _counted(chunks, naming_counts(F.col("text")), by, key)
    c = c.select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n.{k}").alias("m")) for k in NAME_PATTERNS])))
    c = c.groupBy(by, "kind").agg(*[F.sum(f"m.{x}").alias(x) for x in "scp"]).where("s + c + p > 0")
    top = F.greatest("s", "c", "p")
    style = F.when(F.col("s") == top, "snake_case").when(F.col("c") == top, "camelCase").otherwise("PascalCase")
    return c.select(by, "kind", style.alias("convention"), F.col("s").alias("n_snake"), F.col("c").alias("n_camel"), F.col("p").alias("n_pascal"))


def error_votes(chunks: DataFrame, by: str = "graph_id", key: str | None = None) -> DataFrame:
    """How errors are handled: none, specific if named exceptions outnumber bare ones, else generic."""
    c = _counted(chunks, error_counts(F.col("text")), by, key).groupBy(by).agg(*[F.sum(f"n.{x}").alias(x) for x in ("n_try", "n_specific", "n_bare")])
    return c.withColumn("style", F.when(F.col("n_try") == 0, "no_error_handling").when(F.col("n_specific") > F.col("n_bare"), "specific_exception_handling").otherwise("generic_exception_handling"))


def doc_votes(chunks: DataFrame, by: str = "graph_id", key: str | None = None) -> DataFrame:
    """How code is documented: docstrings by quote, inline comments, or hardly. Only double quotes count as docstrings."""
    c = _counted(chunks, doc_counts(F.col("text")), by, key).groupBy(by).agg(*[F.sum(f"n.{x}").alias(x) for x in ("n_double", "n_single", "n_hash")])
    style = F.when(F.col("n_double") > 0, F.when(F.col("n_double") >= F.col("n_single"), "docstrings_triple_double").otherwise("docstrings_triple_single"))
    return c.withColumn("style", F.coalesce(style, F.when(F.col("n_hash") > 0, "inline_comments"), F.lit("minimal_documentation")))
