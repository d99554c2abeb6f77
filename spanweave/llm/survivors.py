"""Problem 4: one surviving record per group of records of one definition, field by field.

Method. Consistent bundles: fields that depend on each other are taken whole from one record: the code with the
extent it takes up, the start, the description, and the place (lines, extent and end at that start). A
branch-and-bound search over the candidates of all bundles of a group maximises their trust under the functional
dependencies code -> extent and code -> lines: the chosen place must have an extent and a number of lines that the
chosen code is recorded with. The trust of code, start and description comes before that of the place, so these three
are always the best members'; which extent the code is taken with and which place goes with it is the search's choice.

Grouping. Records are blocked by graph, file, type, parent and name, spellings aside. Within a block records
with the same code (white space aside) are one definition; a cut-off code belongs to a code that continues it,
at the same start if there is one; a record without code belongs to the definition at its start. Equal code at
different places of one state of a file (records written within STATE_SECONDS) are different definitions.

Scale. Equal (code, start) rows of a block fall together in a partial aggregate before anything else, whatever
their number. Prefixes are found by one sort per block and comparing neighbours. No group is gathered.

Defined cases: records without graph, file or name form no group; without code and start they stay alone; null
indexed_at is the oldest; ties go to the smallest rec_id; repeated rows count as members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from spanweave.llm.badfiles import clean_path
from spanweave.llm.docpairs import parse_definition, says_nothing, simple_name

#: Records of one file written within this time are of one state of it.
STATE_SECONDS = 10
Candidate = tuple[tuple, dict[str, Any]]  # trust by level, fields


def choose_bundles(bundles: Sequence[Sequence[Candidate]], dependencies: Sequence[tuple[Sequence[str], str]] = ()) -> list[Candidate | None]:
    """One candidate per bundle (None for a bundle left empty) with the largest trust.

    A trust is a tuple; the trusts of a choice are compared level by level, on each level bundle by bundle, and a
    filled bundle beats an empty one on every level it has. A dependency (determinants, field) forbids choices whose
    determinants agree with another chosen candidate's while the field differs. Branch and bound: candidates in falling
    trust; the bound of a branch is its trust so far and the best trust of every bundle to come; a branch whose bound
    does not beat the best found is cut. Leaving a bundle empty is the last branch."""
    order = [sorted(b, key=lambda c: c[0], reverse=True) for b in bundles]
    depth = max((len(c[0]) for b in order for c in b), default=0)
    filled = lambda t: (1, t)
    tops = [[max((filled(c[0][k]) for c in b if len(c[0]) > k), default=EMPTY) for b in order] for k in range(depth)]
    best_value: list | None = None
    best: list[Candidate | None] = [None] * len(order)

    def consistent(fields: dict[str, Any], chosen: list[Candidate | None]) -> bool:
        facts = [c[1] for c in chosen if c] + [fields]
        for determinants, field in dependencies:
            if field not in fields:
                continue
            seen: dict[tuple, Any] = {}
            for f in facts:
                if field in f and all(d in f for d in determinants):
                    key = tuple(f[d] for d in determinants)
                    if seen.setdefault(key, f[field]) != f[field]:
                        return False
        return True

    def bound(chosen: list[Candidate | None]) -> list:
        k = len(chosen)
        return [[filled(c[0][i]) if c and len(c[0]) > i else EMPTY for c in chosen] + tops[i][k:] for i in range(depth)]

    def visit(chosen: list[Candidate | None]) -> None:
        nonlocal best_value, best
        value = bound(chosen)
        if best_value is not None and value <= best_value:
            return
        k = len(chosen)
        if k == len(order):
            best_value, best = value, chosen
            return
        for c in order[k]:
            if consistent(c[1], chosen):
                visit([*chosen, c])
        visit([*chosen, None])

    visit([])
    return best


#: The trust of an empty bundle.
EMPTY: tuple = (0,)
#: What the chosen code says of the place it may stand at.
DEPENDENCIES = ((("code",), "extent"), (("code",), "lines"))


@F.pandas_udf(T.BooleanType())
def _speaks(desc: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([d is not None and not says_nothing(d, n) for d, n in zip(desc, name)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _whole(snippet: pd.Series) -> pd.Series:
    return snippet.map(lambda s: parse_definition(s) is not None).astype(bool)


#: White space that codes are compared without.
BLANKS = " \t\n\r\f\x0b"


def _code(snippet: str = "snippet") -> Column:
    return F.nullif(F.translate(snippet, BLANKS, ""), F.lit(""))


def _members(entities: DataFrame) -> DataFrame:
    """Records of blocks with two or more: block key `b`, digest `c` of the code (null without), trust parts. The
    count of the blocks reads the key columns alone; everything dear is worked out for what remains."""
    e = entities.where(F.col("entity_type").isin("Function", "Class"))
    e = e.withColumn("file", clean_path(F.col("source_file"))).withColumn("simple", simple_name(F.col("name")))
    e = e.where("graph_id is not null and file <> '' and simple <> ''")
    key = F.md5(F.concat_ws("\u0001", "graph_id", "file", "entity_type", F.coalesce("parent_type", F.lit("")), F.coalesce(simple_name(F.col("parent_name")), F.lit("")), "simple"))
    at = F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(1 << 60)).cast("bigint"))
    r = e.select(F.unhex(key).alias("b"), "rec_id", "start_byte", "end_byte", "start_line", "end_line", "snippet", at.alias("at"), "description", "simple")
    several = r.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
    r = r.join(several, "b", "left_semi").withColumn("c", F.unhex(F.md5(_code())))
    speaks = F.when(F.col("description").isNull(), F.lit(False)).otherwise(_speaks("description", "simple"))
    return r.select("b", "c", "rec_id", "start_byte", "end_byte", "start_line", "end_line", "at", "snippet", speaks.alias("speaks"))


def _collapsed(members: DataFrame) -> DataFrame:
    """One row per (block, code, start), with the different places recorded for it. Equal rows fall together first."""
    r = members.withColumn("best", F.struct("at", (-F.col("rec_id")).alias("neg")))
    r = r.groupBy("b", "c", "start_byte", "end_byte", "start_line", "end_line").agg(
        F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("rec_id"), F.min_by("snippet", "rec_id").alias("snippet"),
        F.max("best").alias("best"), F.max(F.when(F.col("speaks"), F.col("best"))).alias("best_desc"),
    )
    place = F.when(F.col("start_byte").isNotNull(), F.struct("best", "c", "start_line", "end_line", (F.col("end_byte") - F.col("start_byte")).alias("extent"), (F.col("end_line") - F.col("start_line")).alias("lines")))
    return r.groupBy("b", "c", "start_byte").agg(
        F.sum("n").alias("n"), F.min("rec_id").alias("rec_id"), F.min_by("snippet", "rec_id").alias("snippet"),
        F.max("best").alias("best"), F.max("best_desc").alias("best_desc"), F.collect_list(place).alias("places"),
    )


def _places(members: DataFrame) -> DataFrame:
    """(b, c, start_byte, place) for codes that stand at several places of one state; others have no row."""
    r = members.where("c is not null and start_byte is not null").select("b", "c", "start_byte", F.floor(F.col("at") / (STATE_SECONDS * 1_000_000)).alias("slot")).distinct()
    # a state may straddle two slots of the clock: each record stands in its own slot and the next
    r = r.withColumn("state", F.explode(F.array("slot", F.col("slot") + 1)))
    states = r.groupBy("b", "c", "state").agg(F.min("start_byte").alias("lo"), F.max("start_byte").alias("hi")).where("lo < hi").select("b", "c", "state")
    starts = r.join(states, ["b", "c", "state"], "left_semi").select("b", "c", "state", "start_byte").distinct()
    rank = starts.withColumn("place", F.dense_rank().over(W.partitionBy("b", "c", "state").orderBy("start_byte")))
    known = rank.groupBy("b", "c", "start_byte").agg(F.min("place").alias("place"))
    # starts of other states of these codes go to the nearest known place
    every = r.select("b", "c", "start_byte").join(states.select("b", "c").distinct(), ["b", "c"], "left_semi").distinct().join(known, ["b", "c", "start_byte"], "left")
    pin = F.when(F.col("place").isNotNull(), F.struct("start_byte", "place"))
    w = W.partitionBy("b", "c").orderBy("start_byte")
    every = every.withColumn("lower", F.last(pin, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("upper", F.first(pin, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    down, up = F.col("start_byte") - F.col("lower.start_byte"), F.col("upper.start_byte") - F.col("start_byte")
    near = F.when(F.col("upper").isNull() | (down <= up), F.col("lower.place")).otherwise(F.col("upper.place"))
    return every.select("b", "c", "start_byte", near.alias("place"))


def _clusters(entities: DataFrame) -> DataFrame:
    """The collapsed rows with a column `g`: the definition within the block they belong to."""
    from spanweave.session import cut_lineage

    members = cut_lineage(_members(entities))
    rows = cut_lineage(_collapsed(members))
    places = _places(members)
    # cut-off codes: in the order of a block's codes, what continues a code stands right behind it, so a cut-off
    # code belongs to the first code from it on that is not itself cut off and continued by the next one
    codes = rows.where("c is not null").groupBy("b", "c").agg(F.min_by("snippet", "rec_id").alias("snippet"))
    w = W.partitionBy("b").orderBy("code")
    codes = codes.withColumn("code", _code()).withColumn("next", F.lead("code").over(w))
    cut = codes.where(F.col("next").isNotNull() & F.expr("startswith(next, code)")).where(~_whole("snippet")).select("b", "c", F.lit(True).alias("cut"))
    cut = cut_lineage(cut)  # few rows; the parser must not run again for each reader
    last = F.first(F.when(F.col("cut").isNull(), F.col("c")), True).over(w.rowsBetween(0, W.unboundedFollowing))
    target = codes.select("b", "c", "code").join(cut, ["b", "c"], "left").select("b", "c", last.alias("g"))
    # at the same start the longest code that continues it comes first
    coded = rows.where("c is not null")
    full = coded.where("start_byte is not null").select("b", "start_byte", F.col("c").alias("full_c"), _code().alias("full"))
    here = coded.join(cut, ["b", "c"], "left_semi").select("b", "c", "start_byte", _code().alias("code")).join(full, ["b", "start_byte"])
    here = here.where("startswith(full, code) and length(full) > length(code)").groupBy("b", "c", "start_byte").agg(F.max_by("full_c", F.struct(F.length("full"), "full_c")).alias("here_c"))
    link = coded.join(here, ["b", "c", "start_byte"], "left").withColumn("k", F.coalesce("here_c", "c")).drop("here_c")
    link = link.join(target.withColumnRenamed("c", "k"), ["b", "k"]).drop("k")
    link = link.join(places, ["b", "c", "start_byte"], "left").withColumn("g", F.concat_ws("#", F.hex("g"), F.coalesce(F.col("place"), F.lit(1)).cast("string")))
    # without code: the definition at the same start, the latest if several
    starts = link.where("start_byte is not null").groupBy("b", "start_byte").agg(F.max_by("g", F.struct("best", "g")).alias("at_g"))
    bare = rows.where("c is null").join(starts, ["b", "start_byte"], "left")
    alone = F.concat_ws("#", F.lit("start"), F.col("start_byte").cast("string"))
    bare = bare.where("start_byte is not null").withColumn("g", F.coalesce("at_g", alone)).drop("at_g")
    return link.drop("place").unionByName(bare)


def survivors(entities: DataFrame, find: Callable[[DataFrame], DataFrame] = _clusters) -> DataFrame:
    """One row per group of two or more records: rec_id (the smallest), members, the record that supplies each
    bundle (snippet_rec_id, start_byte_rec_id, description_rec_id, place_rec_id; -1 where no record has a value), and
    the place's start_line, end_line and extent (null without a place).

    Trust: most characters of code other than white space, latest indexed_at, smallest rec_id for the snippet; the
    latter two for start, place and description, which must say something. Of a group only what can be chosen comes
    together: the best code, the best start with the different places recorded there, the best description."""
    m = find(entities)
    size = F.length(_code())
    code = F.when(F.col("c").isNotNull(), F.struct(size.alias("size"), F.col("best.at").alias("at"), F.col("best.neg").alias("neg"), "c", "places"))
    # first by start, so that the places at one start are together; then the best of each bundle carries its own along
    g = m.groupBy("b", "g", "start_byte").agg(
        F.min("rec_id").alias("rec_id"), F.sum("n").alias("members"), F.max(code).alias("code"),
        F.max("best").alias("best"), F.flatten(F.collect_list("places")).alias("places"), F.max("best_desc").alias("des"),
    )
    g = g.groupBy("b", "g").agg(
        F.min("rec_id").alias("rec_id"), F.sum("members").alias("members"), F.max("code").alias("code"),
        F.max(F.when(F.col("start_byte").isNotNull(), F.struct("best", "places"))).alias("pos"), F.max("des").alias("des"),
    ).where("members > 1").select("rec_id", "members", "code", "pos", "des")
    out_names = ["snippet_rec_id", "start_byte_rec_id", "description_rec_id", "place_rec_id", "start_line", "end_line", "extent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [chosen_record(c, p, d) for c, p, d in zip(*(b.column(c).to_pylist() for c in ("code", "pos", "des")))]
            cols = [b.column("rec_id"), b.column("members"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(out_names)))]
            yield pa.RecordBatch.from_arrays(cols, names=["rec_id", "members", *out_names])

    return g.mapInArrow(run, "rec_id long, members long, " + ", ".join(f"{n} long" for n in out_names))


def chosen_record(code: dict | None, pos: dict | None, des: dict | None) -> tuple[int | None, ...]:
    """The search of one group: ids of the records that supply code, start, description and place, then start_line,
    end_line and extent of the place. The code is a candidate with each extent it is recorded with, at its own start or
    at the chosen one; the places at the chosen start are candidates with theirs. Where no place recorded there agrees with
    the code, the place is built: the line of the latest one, the extent and lines of the code."""
    places = pos["places"] if pos else []
    codes: list[Candidate] = []
    if code:
        known: dict[tuple, tuple] = {}
        for p in [*code["places"], *places]:
            if p["c"] == code["c"] and p["extent"] is not None:
                key, t = (p["extent"], p["lines"]), (p["best"]["at"], p["best"]["neg"])
                known[key] = max(t, known.get(key, t))
        trust = (code["size"], code["at"], code["neg"])
        codes = [((trust, (), (1, *t)), {"code": code["c"], "extent": e, **({"lines": n} if n is not None else {})}) for (e, n), t in known.items()]
        codes = codes or [((trust, (), (0,)), {"code": code["c"]})]
    # of the places of one extent and number of lines only the most trusted can be chosen
    best: dict[tuple, Candidate] = {}
    for p in places:
        key = p["extent"], p["lines"]
        fields = {k: v for k, v in zip(("extent", "lines"), key) if v is not None} | ({"code": code["c"]} if code else {}) | {"place": p}
        one = ((), (p["extent"] is not None, p["lines"] is not None, p["best"]["at"], p["best"]["neg"])), fields
        if key not in best or one[0] > best[key][0]:
            best[key] = one
    where = list(best.values())
    starts = [(((pos["best"]["at"], pos["best"]["neg"]),), {})] if pos else []
    speaking = [(((des["at"], des["neg"]),), {})] if des else []
    c, s, d, w = choose_bundles([codes, starts, speaking, where], DEPENDENCIES)
    last = lambda x: -x[0][0][-1] if x else -1
    if w or not places:
        p = w[1]["place"] if w else {"start_line": None, "end_line": None, "extent": None}
        return last(c), last(s), last(d), -p["best"]["neg"] if w else -1, p["start_line"], p["end_line"], p["extent"]
    line = max((q["best"]["at"], q["best"]["neg"], q["start_line"]) for q in places if q["start_line"] is not None)[2] if any(q["start_line"] is not None for q in places) else None
    lines = c[1].get("lines")
    return last(c), last(s), last(d), -1, line, None if line is None or lines is None else line + lines, c[1].get("extent")


def surviving_records(entities: DataFrame) -> DataFrame:
    """The built records: code, start and description from the records that supply them, lines and end from the chosen
    place. Every supplier is looked up by one join."""
    s = survivors(entities)
    roles = {"own": "rec_id", "code": "snippet_rec_id", "start": "start_byte_rec_id", "des": "description_rec_id"}
    wanted = s.withColumn("role", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("of")) for r, c in roles.items()))))
    wanted = wanted.select("rec_id", "members", "start_line", "end_line", "extent", F.col("role.role").alias("role"), F.col("role.of").alias("of"))
    e = entities.select(F.col("rec_id").alias("of"), "graph_id", clean_path(F.col("source_file")).alias("source_file"), "entity_type", simple_name(F.col("name")).alias("name"), "snippet", "start_byte", "description")
    got = wanted.join(e, "of", "left")
    by = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c))).alias(c)
    out = got.groupBy("rec_id").agg(*(F.first(c).alias(c) for c in ("members", "start_line", "end_line", "extent")), *(by("own", c) for c in ("graph_id", "source_file", "entity_type", "name")), by("code", "snippet"), by("start", "start_byte"), by("des", "description"))
    return out.select(
        "rec_id", "members", "graph_id", "source_file", "entity_type", "name", "snippet", "start_byte", (F.col("start_byte") + F.col("extent")).cast("int").alias("end_byte"),
        F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "description",
    )


def found(entities: DataFrame) -> DataFrame:
    return survivors(entities).select("rec_id", "snippet_rec_id", "start_byte_rec_id", "description_rec_id")
