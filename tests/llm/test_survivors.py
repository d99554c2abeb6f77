import datetime as dt
import itertools
import random
import re

from spanweave.llm import survivors as S
from spanweave.llm.docpairs import parse_definition, says_nothing

DDL = "rec_id long, graph_id string, entity_type string, name string, source_file string, parent_type string, parent_name string, start_line int, end_line int, start_byte int, end_byte int, snippet string, description string, indexed_at timestamp, b string, c string, n string"
T0 = dt.datetime(2025, 1, 1)


def frame(spark, xs):
    base = dict(rec_id=0, graph_id="g", entity_type="Function", name="f", source_file="repos/a.py", parent_type=None, parent_name=None, start_line=1, end_line=2, start_byte=0, end_byte=9, snippet="def f():\n    return 1", description=None, indexed_at=T0, b="x", c="y", n="z")
    return spark.createDataFrame([tuple({**base, **x}.values()) for x in xs], DDL)


def out(df):
    return sorted(tuple(r) for r in S.found(df).collect())


def test_bundles_follow_the_rules(spark):
    d = lambda k: T0 + dt.timedelta(days=k)
    df = frame(spark, [
        dict(rec_id=5, indexed_at=d(1)), dict(rec_id=6, name=" f() ", source_file="repos\\a.py ", snippet="def f():\r\n    return 1  ", indexed_at=d(3), start_byte=None), dict(rec_id=7, snippet="def f(", indexed_at=d(9), description="TODO"),
        dict(rec_id=8, snippet=None, indexed_at=d(2), description="Counts rows."), dict(rec_id=9, snippet="def f():\n    return 2", start_byte=70), dict(rec_id=10, snippet=None, start_byte=None), dict(rec_id=11, graph_id=None), dict(rec_id=12, name=None),
    ])
    assert out(df) == [(5, 6, 7, 8)]


def test_places_of_one_state_differ(spark):
    d = lambda k, s=0: T0 + dt.timedelta(days=k, milliseconds=s)
    two = [dict(rec_id=1, start_byte=10, indexed_at=d(0)), dict(rec_id=2, start_byte=90, indexed_at=d(0, 300)), dict(rec_id=3, start_byte=14, indexed_at=d(4)), dict(rec_id=4, start_byte=94, indexed_at=d(5))]
    assert out(frame(spark, two)) == [(1, 3, 3, -1), (2, 4, 4, -1)]
    assert out(frame(spark, two[:2])) == []
    assert out(frame(spark, [two[0], two[0] | dict(rec_id=8)])) == [(1, 1, 1, -1)]


def test_empty_and_repeated(spark):
    assert out(frame(spark, [dict()]).limit(0)) == []
    assert out(frame(spark, [dict(rec_id=i, indexed_at=None) for i in range(300)])) == [(0, 0, 0, -1)]


def test_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/entities.parquet")
    rows = e.where("entity_type in ('Function','Class')").collect()
    blocks = {}
    path = lambda s: re.sub(r"^.*?(?=repos/)", "", re.sub("/+", "/", (s or "").strip().replace("\\", "/")))
    name = lambda s: re.sub(r"\(.*$", "", (s or "").strip()).strip().split(".")[-1]
    for r in rows:
        blocks.setdefault((r["graph_id"], path(r["source_file"]), r["entity_type"], r["parent_type"], name(r["parent_name"]), name(r["name"])), []).append(r)
    want = []
    for v in blocks.values():
        code = [re.sub(r"\s+", "", r["snippet"]) if r["snippet"] else None for r in v]
        group = list(range(len(v)))

        def join(i, j):
            a, b = group[i], group[j]
            for k in range(len(group)):
                if group[k] == a:
                    group[k] = b

        for i, j in itertools.permutations(range(len(v)), 2):
            if code[i] and code[i] == code[j]:
                join(i, j)
            elif code[i] and code[j] and code[j].startswith(code[i]) and parse_definition(v[i]["snippet"]) is None:
                join(i, j)
            elif code[i] is None and v[i]["start_byte"] is not None and v[i]["start_byte"] == v[j]["start_byte"]:
                join(i, j)
        for gid in set(group):
            m = [i for i in range(len(v)) if group[i] == gid]
            if len(m) < 2:
                continue
            best = lambda ok, key: max((i for i in m if ok(i)), key=key, default=None)
            at = lambda i: (v[i]["indexed_at"], -v[i]["rec_id"])
            picks = [best(lambda i: code[i], lambda i: (len(code[i]), *at(i))), best(lambda i: v[i]["start_byte"] is not None, at), best(lambda i: not says_nothing(v[i]["description"], v[i]["name"]), at)]
            want.append((min(v[i]["rec_id"] for i in m), *(-1 if p is None else v[p]["rec_id"] for p in picks)))
    assert sorted(want) == out(e)


def test_branch_and_bound_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        bundles = [[((rng.randint(0, 5),), {"zip": rng.randint(0, 2), "city": rng.randint(0, 2)} if k == 0 else {"zip": rng.randint(0, 2), "city": rng.randint(0, 2), f"x{k}": 1}) for _ in range(rng.randint(0, 4))] for k in range(3)]
        deps = [(["zip"], "city")]

        def fine(choice):
            seen = {}
            return all(seen.setdefault(c[1]["zip"], c[1]["city"]) == c[1]["city"] for c in choice if c)

        every = [c for c in itertools.product(*[[*b, None] for b in bundles]) if fine(c)]
        value = lambda c: [(1, x[0]) if x else (0, ()) for x in c]
        assert value(S.choose_bundles(bundles, deps)) == max(map(value, every))


def test_chains_of_cuts_lead_to_the_whole_code(spark):
    whole = "def f(a, b):\n    x = [1, 2]\n    return x"
    cuts = [whole[:k] for k in (8, 11, 20, 24)]
    df = frame(spark, [dict(rec_id=9, snippet=whole, start_byte=5)] + [dict(rec_id=i, snippet=c, start_byte=None if i == 2 else 100 + i) for i, c in enumerate(cuts)])
    assert [(r[0], r[1]) for r in out(df)] == [(0, 9)]


def test_search_changes_the_choice(spark):
    """The code is recorded with two extents; the latest record of it has one that no place at the chosen start has, so
    taking each bundle's best in turn would leave the record without a place."""
    d = lambda k: T0 + dt.timedelta(days=k)
    df = frame(spark, [
        dict(rec_id=1, start_byte=10, end_byte=40, start_line=2, end_line=3, indexed_at=d(1)),
        dict(rec_id=2, start_byte=10, end_byte=77, start_line=2, end_line=9, indexed_at=d(6), snippet=None),
        dict(rec_id=3, start_byte=5, end_byte=99, start_line=1, end_line=2, indexed_at=d(3)),
        dict(rec_id=4, start_byte=10, end_byte=None, start_line=None, end_line=None, indexed_at=d(7), snippet=None),
    ])
    r = S.surviving_records(df).collect()
    assert [(x["rec_id"], x["start_byte"], x["end_byte"], x["start_line"], x["end_line"]) for x in r] == [(1, 10, 40, 2, 3)]
    assert out(df) == [(1, 3, 4, -1)]
    place = lambda at, neg, c, extent, lines: {"best": {"at": at, "neg": neg}, "c": c, "start_line": 1, "end_line": 1 + lines, "extent": extent, "lines": lines}
    pos = {"best": {"at": 7, "neg": -4}, "places": [place(6, -2, None, 67, 7), place(1, -1, b"k", 30, 1)]}
    code = {"size": 9, "at": 8, "neg": -3, "c": b"k", "places": [place(8, -3, b"k", 94, 1)]}
    assert S.chosen_record(code, pos, None) == (3, 4, -1, 1, 1, 2, 30)
    assert S.chosen_record(code, pos | {"places": pos["places"][:1]}, None) == (3, 4, -1, -1, 1, 2, 94)  # built
    assert S.chosen_record(None, pos, None)[3] == 2  # without a code nothing forbids the latest place
    assert S.chosen_record(code, None, None) == (3, -1, -1, -1, None, None, None)


def test_names_in_mixed_case_describe_nothing(spark):
    for text in ("Function LocalPlannerWalker.", "The LocalPlannerWalker function", "local planner walker", "Localplannerwalker.", "This description is missing and not yet available, please add the documentation here later, it could not be generated, TODO"):
        assert says_nothing(text, "LocalPlannerWalker"), text
    for text in ("LocalPlannerWalker walks rows.", "Plans routes"):
        assert not says_nothing(text, "LocalPlannerWalker"), text
    df = frame(spark, [dict(rec_id=1, entity_type="Class", name="RowCache", description="Keeps rows.", snippet="class RowCache:\n    x = 1"), dict(rec_id=2, entity_type="Class", name="RowCache", description="Function RowCache.", indexed_at=T0 + dt.timedelta(days=2), snippet="class RowCache:\n    x = 1")])
    assert out(df) == [(1, 2, 2, 1)]


def test_many_places_are_chosen_from_quickly():
    place = lambda at, neg, c, extent: {"best": {"at": at, "neg": neg}, "c": c, "start_line": 1, "end_line": 2, "extent": extent, "lines": 1}
    pos = {"best": {"at": 9, "neg": -1}, "places": [place(i % 7, -i, b"k" if i % 3 else None, 10 + i % 40) for i in range(5000)]}
    code = {"size": 9, "at": 8, "neg": -3, "c": b"k", "places": pos["places"][:50]}
    got = S.chosen_record(code, pos, None)
    fine = {p["extent"] for p in pos["places"] if p["c"] == b"k"}
    assert got[:2] == (3, 1) and got[6] in fine and got[3] == min(i for i in range(5000) if i % 7 == 6 and 10 + i % 40 in fine)
