"""Reading scores and suggestions out of a model's text; ranking by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def metric_score(text: Column, metric: str) -> Column:
    """The fixed format `Metric (1-10): n` in any case and with or without brackets; 0 if it is absent."""
    return F.coalesce(_number(F.regexp_extract(text, rf"(?i){metric}\s*\(?1-10\)?\s*:\s*(\d+)", 1)), F.lit(0))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _first(text: Column, words: tuple[str, ...]) -> Column:
    """Where the first of some words starts, letter case aside; null without any."""
    at = [F.nullif(F.locate(w.lower(), F.lower(text)), F.lit(0)) for w in words]
    return at[0] if len(at) == 1 else F.least(*at)


def after(text: Column, *words: str) -> Column:
    """What follows the first of some words; null without any."""
    at = [F.nullif(F.locate(w.lower(), F.lower(text)), F.lit(0)) for w in words]
    ends = [i + len(w) for i, w in zip(at, words)]
    start = ends[0]
    for i, e in zip(at[1:], ends[1:]):
        start = F.when(i.isNotNull() & (start.isNull() | (e < start)), e).otherwise(start)
    return F.substring(text, start, F.length(text))


def until(text: Column, *words: str) -> Column:
    """What precedes the first of some words; all of it without any."""
    return F.coalesce(F.substring(text, F.lit(1), _first(text, words) - 1), text)


def section(text: Column, titles: tuple[str, ...], ends: tuple[str, ...] = ()) -> Column:
    """The part of a verdict under one of some titles: from the colon after the title to the first of `ends`."""
    part = after(after(text, *titles), ":")
    return _strip(until(part, *ends) if ends else part)


def analysis(text: Column) -> Column:
    """The paragraph under `overall analysis`, else the last paragraph."""
    got = section(text, ("overall analysis",), ("\n\n",))
    return _strip(F.when(got != "", got).otherwise(F.element_at(F.split(text, "\n\n"), -1)))


def suggestions(text: Column) -> Column:
    """What a verdict suggests; null without such a part."""
    return section(text, ("suggestions", "improvement"))


def answer_analysis(text: Column) -> Column:
    """What a verdict says of an answer's quality, up to its suggestions; null without such a part."""
    return section(text, ("analysis", "quality"), ("specific suggestions", "improvement"))


def retrieval_advantages(text: Column) -> Column:
    """When retrieval helps, as a comparison of answers says; null without such a part."""
    return section(text, ("RAG provides", "RAG advantages", "when RAG"), ("LLM-only", "when the LLM"))


def model_sufficient(text: Column) -> Column:
    """When the model alone is enough, as a comparison of answers says; null without such a part."""
    return section(text, ("LLM-only approach", "when the LLM", "LLM might be"))


def paired_scores(text: Column, metric: str) -> tuple[Column, Column]:
    """(with retrieval, model only): the first number after each side's name after the metric's; null if either is
    absent."""
    part = after(text, metric.replace("_", " "))
    rag, llm = (_number(F.regexp_extract(after(part, side), r"\d+", 0)) for side in ("RAG", "LLM"))
    both = rag.isNotNull() & llm.isNotNull()
    return F.when(both, rag), F.when(both, llm)


def winner(rag: Column, llm: Column) -> Column:
    return F.when(rag > llm, "RAG").when(llm > rag, "LLM-Only").otherwise("Tie")


def compare_answers(texts: DataFrame, id_col: str, text_col: str, metrics: list[str]) -> DataFrame:
    """Average scores over the metrics (absent ones count 0) and the overall winner per row."""
    rag, llm = F.lit(0.0), F.lit(0.0)
    for m in metrics:
        r, x = paired_scores(F.col(text_col), m)
        rag, llm = rag + F.coalesce(r, F.lit(0)), llm + F.coalesce(x, F.lit(0))
    n = max(1, len(metrics))
    d = texts.select(id_col, F.round(rag / n, 6).alias("avg_rag"), F.round(llm / n, 6).alias("avg_llm"))
    return d.withColumn("winner", winner(F.col("avg_rag"), F.col("avg_llm")))


def rerank_scores(text: Column) -> Column:
    """All numbers after `Score:` in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?is)score\s*:\s*(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def rerank(hits: DataFrame, scores: DataFrame, first: int = 10) -> DataFrame:
    """The first hits by score, falling, equal ones in their order; the others as they were. `hits` has `ord` from 0,
    `scores` (ord, score); without a score for each of the first hits nothing moves."""
    top = hits.where(F.col("ord") < first).join(scores, "ord", "left")
    whole = F.count("score").over(W.partitionBy()) == F.count(F.lit(1)).over(W.partitionBy())  # over at most `first` rows
    top = top.withColumn("score", F.when(whole, F.col("score")))
    moved = top.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("score"), "ord")) - 1)
    return moved.unionByName(hits.where(F.col("ord") >= first).withColumn("score", F.lit(None).cast("int")).withColumn("place", F.col("ord")))


def change_suggestions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Suggestions of a model's text: file, lines, code before and after, explanation; one row per `File:` part whose
    first line names a file and its lines. Code stands in a fence under `Before:` and `After:`."""
    d = texts.select(id_col, F.posexplode(F.split(F.concat(F.lit("\n"), text_col), "\nFile:")).alias("ord", "part")).where("ord > 0")
    head = F.element_at(F.split("part", "\n"), 1)
    lines = F.transform(F.regexp_extract_all(after(head, "(line"), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    d = d.select(id_col, "ord", "part", _strip(until(head, "(line")).alias("file"), lines.alias("lines"))

    def code(title: str) -> Column:
        fence = F.get(F.split(after(F.col("part"), title), "```"), F.lit(1))
        return F.nullif(_strip(F.substring(fence, F.locate("\n", fence), F.length(fence))), F.lit(""))

    return d.where((F.col("file") != "") & (F.size("lines") > 0)).select(
        id_col, "file", F.get("lines", F.lit(0)).alias("start_line"), F.coalesce(F.get("lines", F.lit(1)), F.get("lines", F.lit(0))).alias("end_line"),
        code("Before:").alias("before_code"), code("After:").alias("after_code"), _strip(until(after(F.col("part"), "Explanation:"), "\n\n")).alias("explanation"),
    )
