"""Problem 9: bring visually identical text to one consistent form.

Method. DuckDB runs inside each Arrow partition: one SQL expression of `translate`, `regexp_replace`,
`replace` and `nfc_normalize` maps full- and half-width forms to the ordinary ones, non-breaking to ordinary
spaces, composes accents, drops characters without width and maps look-alike letters to one representative.
Documents with one form and different texts are the pairs that look the same.

What stays different, because a reader sees it: raised and lowered digits, letter case, missing accents,
a dot or its lack (dotless i), ligatures, curly quotes, tabs and line ends, a zero-width joiner between two pictographs
(it draws one combined picture; anywhere else it is dropped), a selector that picks how a pictograph is drawn, and the
tags of a flag.

Defined cases: a null text has a null form and is in no pair; an empty text has the empty form and looks the
same as a text of characters without width only; repeated rows each count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Look-alike letters (fixed values): each character and the letter it is drawn like.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "а": "a", "с": "c", "ԁ": "d", "е": "e",
    "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y", "х": "x", "ԝ": "w",
    "ѵ": "v", "Ѵ": "V", "Ӏ": "I", "Г": "Γ", "П": "Π", "Ф": "Φ", "Л": "Λ",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "κ": "k", "υ": "u", "γ": "y",
    "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Armenian, Roman numerals and letter-like signs drawn as single Latin letters
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Տ": "S", "Օ": "O", "ԍ": "G",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l",
    "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ɑ": "a", "ɡ": "g",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L",
    "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # other characters of the same sign
    "µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å", "∆": "Δ", "∑": "Σ", "∏": "Π", "‐": "-", "‑": "-",
}
#: Spaces of a plain space's width that do not break (fixed values).
NO_BREAK_SPACES = "   "
#: Characters without width, as ranges: the default-ignorable code points of Unicode without the Hangul fillers, which
#: have a width (fixed values). The joiner U+200D is handled apart; variation selectors and tags stay where they show.
NO_WIDTH = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
JOINER, HELD = "\u200d", "\ufdd0"
#: Pictographs and what may follow one before a joiner (RE2 ranges).
PICTOGRAPH = r"[\x{2190}-\x{21ff}\x{2300}-\x{23ff}\x{2600}-\x{27bf}\x{2b00}-\x{2bff}\x{fe0f}\x{1f000}-\x{1faff}]"


#: What stays of them: a flag's tags, a selector that picks how a pictograph or a key is drawn.
SHOWN = rf"\x{{1f3f4}}[\x{{e0020}}-\x{{e007f}}]+|{PICTOGRAPH}[\x{{fe0e}}\x{{fe0f}}]|[0-9#*]\x{{fe0f}}\x{{20e3}}"


@lru_cache(1)
def width_forms() -> dict[str, str]:
    """Full-width, half-width and small forms and their ordinary characters, by rule: the tagged decompositions."""
    out = {"\u3000": " "}
    for cp in (*range(0xFE50, 0xFE6C), *range(0xFF01, 0xFFEF)):
        d = unicodedata.decomposition(chr(cp)).split()
        if d and d[0] in ("<wide>", "<narrow>", "<small>"):
            out[chr(cp)] = chr(int(d[1], 16))
    return out


@lru_cache(1)
def letter_map() -> tuple[dict[str, str], dict[str, str]]:
    """Look-alikes as (one character, several characters), with every accented letter whose base is a look-alike,
    so that an accent apart and a composed one end in the same form."""
    one, more = {c: to for c, to in LOOK_ALIKES.items() if ord(c) >= 0x3000}, {}
    for cp in range(0xA0, 0x3000):
        c = chr(cp)
        parts = unicodedata.normalize("NFD", c)
        if parts[0] in LOOK_ALIKES or c in LOOK_ALIKES:
            to = unicodedata.normalize("NFC", LOOK_ALIKES.get(c) or LOOK_ALIKES[parts[0]] + parts[1:])
            if len(to) == 1:
                one[c] = to
            elif cp < 0x1F00:  # polytonic Greek without a one-character counterpart keeps its composed form
                more[c] = to
    return one, more


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def form_sql(column: str = "text") -> str:
    """The DuckDB expression of the consistent form of `column`."""
    widths, (one, more) = width_forms(), letter_map()
    first = {**widths, **{c: " " for c in NO_BREAK_SPACES}}
    gone = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in NO_WIDTH)
    x = f"regexp_replace({column}, '({SHOWN})|[{gone}]', '\\1', 'g')"
    x = f"regexp_replace({x}, '({PICTOGRAPH}){JOINER}', '\\1{HELD}', 'g')"
    x = f"replace({x}, '{JOINER}', '')"
    x = f"regexp_replace({x}, '{HELD}({PICTOGRAPH})', '{JOINER}\\1', 'g')"
    x = f"replace({x}, '{HELD}', '')"
    x = f"nfc_normalize(translate({x}, {_quoted(''.join(first))}, {_quoted(''.join(first.values()))}))"
    x = f"translate({x}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    for c, to in sorted(more.items()):
        x = f"replace({x}, {_quoted(c)}, {_quoted(to)})"
    return f"nfc_normalize({x})"


def consistent_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, form) of every row: a narrow map, DuckDB on each Arrow batch of the partition."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sql = f"SELECT doc_id, text, {form_sql()} AS form FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": "1"})
        try:
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                got = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from got.cast(target).to_batches()
        finally:
            con.close()

    schema = T.StructType([src.schema["doc_id"], src.schema["text"], T.StructField("form", T.StringType())])
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    target = pa.schema([("doc_id", kinds[src.schema["doc_id"].dataType.simpleString()]), ("text", pa.string()), ("form", pa.string())])
    return src.mapInArrow(run, schema)


@lru_cache(1)
def check_sql() -> str:
    """CTEs that end in `forms` (doc_id, text, form) over `documents`: the form by another way, to check it by. The
    characters are rows; those without width go by their neighbours; what each other becomes is worked out here from
    its canonical decomposition; they are put together again and composed at the end."""
    flat = width_forms() | {c: " " for c in NO_BREAK_SPACES}
    table = {}
    for cp in (*range(0xA0, 0xAC00), *range(0xF900, 0x10000)):
        c = chr(cp)
        parts = unicodedata.normalize("NFD", flat.get(c, c))
        to = unicodedata.normalize("NFC", LOOK_ALIKES.get(c) or LOOK_ALIKES.get(parts[0], parts[0]) + parts[1:])
        if to != unicodedata.normalize("NFC", c) and (len(to) == 1 or not 0x1F00 <= cp < 0x2000):
            table[c] = to
    values = ", ".join(f"({_quoted(c)}, {_quoted(to)})" for c, to in table.items())
    gone = " OR ".join(f"unicode(ch) BETWEEN {lo} AND {hi}" for lo, hi in NO_WIDTH)
    pictograph = lambda c: f"coalesce(regexp_full_match({c}, '{PICTOGRAPH}'), false)"
    return f"""
        look(ch, drawn) AS (VALUES {values}),
        c0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, unnest(range(length(text))) AS i FROM documents),
        c1 AS (SELECT *, lag(ch) OVER w AS l, lead(ch) OVER w AS r FROM c0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        c2 AS (SELECT doc_id, ch, i FROM c1 WHERE NOT ({gone}) OR unicode(ch) IN (65038, 65039) AND {pictograph("l")} OR unicode(ch) = 65039 AND unicode(r) = 8419 AND l IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '#', '*')),
        c3 AS (SELECT *, lag(ch) OVER w AS l, lead(ch) OVER w AS r FROM c2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        c4 AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS t FROM c3 WHERE unicode(ch) <> 8205 OR {pictograph("l")} AND {pictograph("r")} GROUP BY doc_id),
        c5 AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?s).')) AS ch, unnest(range(length(t))) AS i FROM (SELECT doc_id, nfc_normalize(t) AS t FROM c4)),
        c6 AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(drawn, ch), '' ORDER BY i)) AS form FROM c5 LEFT JOIN look USING (ch) GROUP BY doc_id),
        forms AS (SELECT d.doc_id, d.text, CASE WHEN d.text IS NOT NULL THEN coalesce(c6.form, '') END AS form FROM documents d LEFT JOIN c6 USING (doc_id))"""


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, f, t): 128-bit digests of form and text, so that no text is shuffled; written once, as several
    steps read them and DuckDB must not run for each."""
    from spanweave.session import cut_lineage

    forms = consistent_forms(docs.where(F.col(text_col).isNotNull()), id_col, text_col)
    return cut_lineage(forms.select("doc_id", F.unhex(F.md5("form")).alias("f"), F.unhex(F.md5("text")).alias("t")))


def look_alike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a text: doc_id, class_id (digest of its form), n_texts (different texts of the
    class), n_links (documents of the class with another text). Copies are counted, not expanded into pairs."""
    d = _digests(docs, id_col, text_col)
    per_text = d.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    per_form = per_text.groupBy("f").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))
    counts = per_text.join(per_form, "f").select("f", "t", "n_texts", (F.col("n_docs") - F.col("n")).alias("n_links"))
    return d.join(counts, ["f", "t"]).select("doc_id", F.lower(F.hex("f")).alias("class_id"), "n_texts", "n_links")


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of one form and different texts.

    Only forms with two or more different texts go on (a partial min/max aggregate), their different texts are
    paired, and each pair of texts is joined with the documents of either; exact copies never meet each other.
    Both joins are salted, so neither a form of very many texts nor a much-copied text stays with one task."""
    d = _digests(docs, id_col, text_col)
    several = d.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select("f")
    d = d.join(several, "f", "left_semi")
    texts = d.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n")).select("f", "t")
    # a form with very many texts is spread over the salts on one side and repeated on the other, here and below
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    one = texts.select("f", F.col("t").alias("t1"), F.pmod(F.xxhash64("t"), F.lit(salts)).alias("salt"))
    pairs = one.join(texts.select("f", F.col("t").alias("t2"), every.alias("salt")), ["f", "salt"]).where("t1 < t2").select("t1", "t2")
    left = pairs.join(d.select(F.col("t").alias("t1"), F.col("doc_id").alias("x")), "t1").select("t2", "x", F.pmod(F.xxhash64("x"), F.lit(salts)).alias("salt"))
    right = d.select(F.col("t").alias("t2"), F.col("doc_id").alias("y"), every.alias("salt"))
    return left.join(right, ["t2", "salt"]).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
