"""The queries of the training-data problems and the SQL that checks some of them.

Every query reads its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import badfiles, badpairs, bpe, docpairs, lookalike, markup, mixing, splitting, survivors
from spanweave.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


def _p6(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "index_metadata"))


def _p8(which: int) -> Query:
    return lambda spark, sf_dir: mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[which]


QUERIES: dict[str, Query] = {
    "p1_found": _on("entities", docpairs.found),
    "p1_pairs": _on("entities", docpairs.documentation_pairs),
    "p2_found": _on("chunks", lambda c: badfiles.judged_files(c).where("defect is not null").select("graph_id", "source_file")),
    "p2_rates": _on("chunks", badfiles.rates),
    "p3_found": _on("conversations", badpairs.found),
    "p4_found": _on("entities", survivors.found),
    "p4_survivors": _on("entities", survivors.surviving_records),
    "p5_found": _on("conversations", markup.found),
    "p5_clean": _on("conversations", lambda c: markup.cleaned(c).select("conversation_id", "turn", "text")),
    "p6_found": _p6(splitting.found),
    "p6_pieces": _p6(lambda c, i: splitting.split_items(splitting.oversized(c, i))),
    "p7_ids": _on("documents", bpe.encode_corpus),
    "p8_mix": _p8(0),
    "p8_shares": _p8(1),
    "p9_found": _on("documents", lookalike.look_alike_pairs),
    "p9_forms": _on("documents", lambda d: lookalike.consistent_forms(d).select("doc_id", "form")),
    "p9_classes": _on("documents", lambda d: lookalike.look_alike_classes(d).select("doc_id", F.col("n_texts"), F.col("n_links"))),
}

ORACLE_SQL: dict[str, str] = {
    "p6_found": """
        SELECT DISTINCT c.id FROM chunks c JOIN index_metadata i ON c.graph_id = i.index_id
        WHERE length(c.text) // 4 > i.token_limit_per_chunk""",
    "p9_forms": f"WITH {lookalike.check_sql()} SELECT doc_id, form FROM forms",
    "p9_found": f"""
        WITH {lookalike.check_sql()}, f AS (SELECT doc_id, text, md5(form) AS form FROM forms WHERE text IS NOT NULL)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
        FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p9_classes": f"""
        WITH {lookalike.check_sql()}, f AS (SELECT doc_id, text, form FROM forms WHERE text IS NOT NULL),
             t AS (SELECT form, text, count(*) AS n FROM f GROUP BY ALL),
             g AS (SELECT form, count(*) AS n_texts, sum(n) AS n_docs FROM t GROUP BY form)
        SELECT f.doc_id, g.n_texts, CAST(g.n_docs - t.n AS BIGINT) AS n_links
        FROM f JOIN t USING (form, text) JOIN g USING (form)""",
}
