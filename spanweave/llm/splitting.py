"""Problem 6: cut oversized items at natural boundaries, with a given overlap.

Method. One regular expression per (limit, overlap) cuts a whole text in a single pass: its alternatives are
ordered by the strength of the boundary they end at (blank line, line, sentence, white space), each with a
bounded quantifier that takes as much as the limit lets it, and the last one falls back to characters.
`regexp_extract_all` yields the cores, which concatenate to the text exactly; running sums of their lengths give each
piece's offset. The overlap is read by a lookback into the text, cut by a second expression into even blocks, of which an
overlap touches two at most. All is done by Spark SQL array functions before the pieces become rows, so that no row
carries the whole text: the work is linear in the text, and no row leaves the JVM.

Tokens are characters (code points) divided by 4, rounded down.

Defined cases: null or empty text, a null limit, and items within the limit give no piece; a limit below 1
counts as 1; an overlap is clamped to what leaves at least one new token per piece; a null overlap is 0;
repeated rows of one id count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A boundary may be taken where the piece has at least this share (in 1/8) of the room, strongest first.
LEAST_EIGHTHS = {"blank line": 4, "line": 3, "sentence": 3, "space": 2}
#: Lengths summed in one go; characters in a block that overlaps are read from, at least.
RUN, BLOCK = 128, 256


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def _pattern(room: Column) -> Column:
    """The cutting expression for cores of at most `room` characters."""
    most = room.cast("string")
    least = {k: F.greatest(F.lit(1), F.floor(room * n / 8).cast("int")) for k, n in LEAST_EIGHTHS.items()}

    def upto(kind: str, end: str, width: int) -> Column:
        low = F.greatest(F.lit(0), least[kind] - width)
        high = F.greatest(F.lit(0), room - width)
        return F.concat(F.lit(".{"), F.least(low, high).cast("string"), F.lit(","), high.cast("string"), F.lit("}" + end))

    return F.concat(
        F.lit("(?s)\\A?.{1,"), most, F.lit("}\\z|"),
        upto("blank line", "\\n\\n(?!\\n)", 2), F.lit("|"),
        upto("line", "\\n", 1), F.lit("|"),
        upto("sentence", "[.!?;:。！？]\\s", 2), F.lit("|"),
        upto("space", "\\s", 1), F.lit("|"),
        F.lit(".{1,"), most, F.lit("}(?![\\p{M}\\u200d\\ufe0f])|.{1,"), most, F.lit("}"),
    )


def oversized(items: DataFrame, limits: DataFrame, graph_col: str = "graph_id", index_col: str = "index_id") -> DataFrame:
    """(graph_id, id, text, token_limit, overlap) of each item whose tokens exceed the limit of its index, once per id.

    The limits are one small row per index, joined by an ordinary equi-join; the size test runs before any text is
    grouped, so only oversized texts are shuffled for removing repeated rows."""
    per_index = limits.groupBy(F.col(index_col).alias("__index")).agg(F.max("token_limit_per_chunk").alias("token_limit"), F.max("chunk_overlap_tokens").alias("overlap"))
    big = (
        items.select(F.col(graph_col).alias("graph_id"), F.col("id"), F.col("text"))
        .join(per_index, F.col("graph_id") == F.col("__index"))
        .where(tokens(F.col("text")) > F.col("token_limit"))
    )
    return big.groupBy("graph_id", "id").agg(F.min("text").alias("text"), F.max("token_limit").alias("token_limit"), F.max("overlap").alias("overlap"))


def _cut(big: DataFrame) -> DataFrame:
    """`big` with __over, the characters of overlap, and __cores, the texts of the pieces without overlap."""
    limit = F.greatest(F.lit(1), F.col("token_limit"))
    over = F.least(F.greatest(F.lit(0), F.coalesce(F.col("overlap"), F.lit(0))), limit - 1)
    d = big.withColumn("__over", (over * 4).cast("int")).withColumn("__room", (limit * 4 + 3 - over * 4).cast("int"))
    return d.select("graph_id", "id", "text", "__over", F.regexp_extract_all("text", _pattern(F.col("__room")), F.lit(0)).alias("__cores"))


def _sums(first: Column, values: Column) -> Column:
    """`first` and the running sums of `values` after it."""
    return F.aggregate(values, F.array(first), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once, however often the body and its functions of elements read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(lengths: Column) -> Column:
    """The running sums before each length. In slices of RUN, so that growing arrays are copied within a slice only."""
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / RUN).cast("int")), lambda i: F.slice(n, i * RUN + 1, F.lit(RUN)))
    total = lambda g: F.aggregate(g, F.lit(0), lambda a, v: a + v)
    run = lambda x: F.flatten(F.transform(x["s"], lambda g, i: F.slice(_sums(F.get(x["o"], i), g), F.lit(1), F.size(g))))
    return _let(lengths, lambda n: _let(cut(n), lambda s: _let(F.struct(s.alias("s"), _sums(F.lit(0), F.transform(s, total)).alias("o")), run)))


def split_items(big: DataFrame) -> DataFrame:
    """Pieces of `oversized` rows: id, piece (from 0), start (character offset of what is new), n_overlap (characters
    repeated from the piece before), n_tokens, text. Without their overlaps the pieces concatenate to the text."""
    d = _cut(big).where(F.size("__cores") > 0).withColumn("__size", F.greatest(F.lit(BLOCK), F.col("__over")))
    blocks = F.when(F.col("__over") > 0, F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), F.col("__size").cast("string"), F.lit("}")), F.lit(0)))

    def before(x: Column, start: Column) -> Column:
        back = F.least(x["over"], start)
        low = start - back
        k = F.floor(low / x["size"]).cast("int")
        two = F.concat(F.get(x["blocks"], k), F.coalesce(F.get(x["blocks"], k + 1), F.lit("")))
        return F.when(back > 0, F.substring(two, low - k * x["size"] + 1, back)).otherwise("")

    def pieces(x: Column) -> Column:
        starts = _starts(F.transform(x["cores"], F.length))
        return F.zip_with(x["cores"], starts, lambda core, start: F.struct(start.alias("start"), before(x, start).alias("head"), core.alias("core")))

    own = F.struct(F.col("__over").alias("over"), F.col("__size").alias("size"), F.col("__cores").alias("cores"), blocks.alias("blocks"))
    d = d.select("graph_id", "id", F.posexplode(_let(own, pieces)).alias("piece", "p"))
    whole = F.concat("p.head", "p.core")
    return d.select("graph_id", "id", "piece", F.col("p.start").alias("start"), F.length("p.head").alias("n_overlap"), tokens(whole).alias("n_tokens"), whole.alias("text"))


def found(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(id) of each item that the operator cuts into two or more pieces."""
    return _cut(oversized(items, limits)).where(F.size("__cores") > 1).select("id")
