"""Structure-aware chunking of source files under a token budget, and its window-shaped parts as SQL.

The greedy cut carries state from line to line, so a file is one unit of work; files run in parallel. Breakpoints
are lines where imports, classes, functions or decorators start, the first comment up to three lines above one,
and lines that return to column 0 right after an indented line of code."""

from __future__ import annotations

import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanweave.functions.text import indent

STRUCTURE = re.compile(r"^\s*(?:import\s|from\s+\S+\s+import\b|class\s|def\s|async\s+def\s|@)")
COMMENT_REACH = 3


def comment_lines(text: str) -> set[int]:
    """0-based lines that hold a comment; by the line's first character where the text cannot be tokenised."""
    try:
        return {t.start[0] - 1 for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT}
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return {i for i, line in enumerate(text.split("\n")) if line.lstrip().startswith("#")}


def breakpoints(text: str, structure: set[int] | None = None) -> list[int]:
    """0-based lines a chunk may be cut at."""
    lines = text.split("\n")
    starts = structure if structure is not None else {i for i, line in enumerate(lines) if STRUCTURE.match(line)}
    first_comment: dict[int, int] = {}
    for c in sorted(comment_lines(text) | {i for i in starts if lines[i].lstrip().startswith("@")}):
        later = [s for s in range(c + 1, c + 1 + COMMENT_REACH) if s in starts]
        if later:
            first_comment.setdefault(later[0], c)
    out = {0} | starts | set(first_comment.values())
    code = [len(x) - len(x.lstrip()) if x.strip() and not x.strip().startswith("#") else None for x in lines]
    out |= {i for i in range(1, len(lines)) if code[i] == 0 and (code[i - 1] or 0) > 0}
    return sorted(out)


def chunk_lines(text: str, limit: int, mode: str = "reference") -> list[tuple[int, int, int]]:
    """(first line, last line, tokens), 1-based and inclusive. A line costs its characters / 4 and one for its line
    feed. `reference` ends a chunk on the breakpoint line itself, `clean` right before it. Blank chunks are left out."""
    lines = text.split("\n")
    n = len(lines)
    cost = [len(x) // 4 + (1 if i < n - 1 else 0) for i, x in enumerate(lines)]
    marks = breakpoints(text)
    out, i = [], 0
    while i < n:
        end, used = i, 0
        while end < n and not (used > 0 and used + cost[end] > limit):
            used += cost[end]
            end += 1
        stop = end
        if end < n:
            inside = [b for b in marks if i <= b < end]
            if mode == "reference":
                stop = (inside[-1] if inside else end - 1) + 1
            else:
                later = [b for b in marks if i < b <= end]
                stop = later[-1] if later else end
        if any(x.strip() for x in lines[i:stop]):
            out.append((i + 1, stop, sum(cost[i:stop])))
        i = stop
    return out


def chunk_files(files: DataFrame, limit: int = 1050, mode: str = "reference") -> DataFrame:
    """Chunks of (graph_id, path, content): the chunk schema with index and lines from 1. Null and blank files give
    none; ids derive from graph, path and index."""
    src = files.select("graph_id", "path", "content").where("content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g, p, t in zip(*(b.column(c).to_pylist() for c in ("graph_id", "path", "content"))):
                lines = t.split("\n")
                for k, (lo, hi, tokens) in enumerate(chunk_lines(t, limit, mode), 1):
                    rows.append((g, p, "\n".join(lines[lo - 1 : hi]), k, lo, hi, tokens))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["graph_id", "source_file", "text", "chunk_index", "start_line", "end_line", "token_count"])

    c = src.mapInArrow(run, "graph_id string, source_file string, text string, chunk_index int, start_line int, end_line int, token_count int")
    cid = F.concat(F.lit("chunk_"), F.md5(F.concat_ws("\u0001", "graph_id", "source_file", F.col("chunk_index").cast("string"))))
    return c.select("graph_id", cid.alias("id"), "text", "source_file", F.lit("python").alias("language"), "chunk_index", "start_line", "end_line", "token_count")


def breakpoint_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The breakpoints as plain SQL windows over the lines of each text: (id, line from 0, reason). Structure lines
    are found by their first word, comments by their first character."""
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line", "s"))
    w = W.partitionBy("id").orderBy("line")
    bare = F.regexp_replace("s", r"^\s+|\s+$", "")
    t = t.withColumn("structure", F.col("s").rlike(r"^\s*(import\s|from\s+\S+\s+import\b|class\s|def\s|async\s+def\s|@)"))
    t = t.withColumn("comment", bare.startswith("#")).withColumn("code", F.when((bare != "") & ~bare.startswith("#"), indent(F.col("s"))))
    t = t.withColumn("ahead", F.min(F.when(F.col("structure"), F.col("line"))).over(w.rowsBetween(1, COMMENT_REACH)))
    t = t.withColumn("before", F.lag("code").over(w))
    first = t.where("(comment or ltrim(s) like '@%') and ahead is not null").groupBy("id", "ahead").agg(F.min("line").alias("line")).select("id", "line", F.lit("comment").alias("reason"))
    return (
        t.where("structure").select("id", "line", F.lit("structure").alias("reason")).unionByName(first)
        .unionByName(t.where("line > 0 and code = 0 and before > 0").select("id", "line", F.lit("dedent").alias("reason")))
    )
