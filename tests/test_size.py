"""What the queries move, on small graphs in which a plan that pairs too much shows."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import metrics, traversal
from spanweave.operators.graph import Graph

PROPS = "struct<line:int,start:int,end:int,module:string,items:string,is_builtin:boolean>"


def a_graph(spark, nodes, calls):
    """nodes: (id, type, name, file); calls: (caller, callee)."""
    n = spark.createDataFrame([("g", i, ["KGNode", t], t, name, file, None, None, None) for i, t, name, file in nodes], "graph_id string, id string, labels array<string>, entity_type string, name string, source_file string, start_line int, end_line int, description string")
    e = spark.createDataFrame([("g", a, b, "CALLS") for a, b in calls], "graph_id string, src string, dst string, rel_type string").withColumn("props", F.lit(None).cast(PROPS))
    return Graph(n, e)


def moved(spark, run):
    """The rows of a query, and how many rows all stages since then wrote for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in (lambda s: [s.apply(i) for i in range(s.size())])(sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    sc.listenerBus().waitUntilEmpty()
    before = set(stages())
    rows = run().collect()
    sc.listenerBus().waitUntilEmpty()
    return rows, sum(n for i, n in stages().items() if i not in before)


def through_one(spark, n=300):
    """n tests call one node that calls n functions."""
    nodes = [(f"c{i:03}", "Call", f"c{i}", f"test_{i % 3}.py") for i in range(n)] + [(f"t{i:03}", "Function", f"t{i}", "a.py") for i in range(n)] + [("mid", "PotentialFunction", "mid", None)]
    return a_graph(spark, nodes, [(f"c{i:03}", "mid") for i in range(n)] + [("mid", f"t{i:03}") for i in range(n)])


def test_test_reach_does_not_pair_callers_with_targets(spark):
    g = through_one(spark)
    rows, n = moved(spark, lambda: traversal.test_reach(g))
    assert {(r["target_id"], r["test_files"]) for r in rows} == {(f"t{i:03}", "test_0.py,test_1.py,test_2.py") for i in range(300)}
    assert n < 20_000
    one = g.nodes.where("id = 't007'")
    assert [tuple(r) for r in traversal.test_reach(g, one).collect()] == [("g", "t007", "test_0.py,test_1.py,test_2.py")]
    assert traversal.test_reach(g, one, 1).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_test_reach_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(40)]
    calls = {(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(70)) if a != b}
    file = {i: rng.choice(["test_a.py", "src/test/b.py", "c.py", None]) for i in ids}
    g = a_graph(spark, [(i, rng.choice(["Function", "Call"]), i, file[i]) for i in ids], calls)
    kind = {r["id"]: r["entity_type"] for r in g.nodes.collect()}

    def want(targets):
        out = {}
        for t in targets:
            at, files = {t}, set()
            for _ in range(3):
                at = {a for a, b in calls if b in at}
                files |= {file[a] for a in at if file[a] and "test" in file[a]}
            if files:
                out[t] = ",".join(sorted(files))
        return out

    assert {r["target_id"]: r["test_files"] for r in traversal.test_reach(g).collect()} == want([i for i in ids if kind[i] == "Function"])
    assert {r["target_id"]: r["test_files"] for r in traversal.test_reach(g, g.nodes.where("id in ('n1', 'n2', 'n3')")).collect()} == want(["n1", "n2", "n3"])


def test_similar_names_compares_in_ranges_until_enough(spark):
    """A block of few pairs, so that ranges are used; equal to all pairs at once, with far fewer of them compared."""
    from spanweave.functions.similarity import jaro_winkler_text

    rng = random.Random(3)
    words = ["load", "parse", "index", "token", "graph", "cache", "merge", "split"]
    names = ["_".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "s", "_all"]) for _ in range(500)] + ["qqq", "zzz", "qqq"]
    rows = [(f"{rng.randrange(10**6):06}{i}", "Class" if i % 5 == 0 else "Function", x, "f.py") for i, x in enumerate(names)]
    g = a_graph(spark, rows, [("a", "b")])
    asked = {i for i, _, _, _ in rows[::9]} | {rows[-1][0], rows[-2][0]}
    seeds = g.nodes.where(F.col("id").isin(*asked))

    def alike(a, b):
        return a in b or b in a or jaro_winkler_text(a, b) > 0.7

    want = {(s, i) for s, t, a, _ in rows if s in asked for i in sorted(i for i, u, b, _ in rows if u == t and i != s and alike(a, b))[:10]}
    for block in (500, 4_000_000):
        got = traversal.similar_names(g, seeds, block=block).collect()
        assert {(r["seed_id"], r["id"]) for r in got} == want and len(got) == len(want)


def test_similar_names_leaves_out_later_ranges(spark, monkeypatch):
    """Every name is alike to every other: after the first range nothing is compared any more."""
    rows = [(f"n{i:04}", "Function", f"load_table_{i:04}", "f.py") for i in range(2000)]
    g = a_graph(spark, rows, [("a", "b")])
    n = spark.sparkContext.accumulator(0)

    from spanweave.functions.similarity import jaro_winkler_text

    @F.udf("double")
    def counting(a, b):
        n.add(1)
        return jaro_winkler_text(a, b)

    monkeypatch.setattr(traversal, "jaro_winkler", counting)
    seeds = g.nodes.where("id like 'n%00'")
    got = traversal.similar_names(g, seeds, **({"block": 2000} if "block" in traversal.similar_names.__code__.co_varnames else {})).collect()
    assert len(got) == 200 and {r["id"] for r in got} <= {f"n{i:04}" for i in range(11)}
    assert n.value < 20_000  # of 40000 pairs


@pytest.mark.parametrize("heavy", [0, 20, 1000])
@pytest.mark.parametrize("ahead", [1, 3])
def test_centrality_counts_what_can_be_among_the_first(spark, heavy, ahead):
    """Several graphs in one; the first by the bound are not the first by count (many neighbours in common)."""
    rng = random.Random(heavy + ahead)
    ids = [f"n{i:03}" for i in range(120)]
    calls = {(a, b) for a, b in ((ids[int(rng.random() ** 2 * 120)], rng.choice(ids)) for _ in range(260)) if a != b}
    calls |= {(f"n{i:03}", f"n{j:03}") for i in range(20) for j in range(100, 112)}  # large bounds, few distinct nodes
    kind = {i: rng.choice(["Function", "Class", "Call"]) for i in ids}
    g = a_graph(spark, [(i, kind[i], i, "f.py") for i in ids], calls)
    nb = {i: {b for a, b in calls if a == i} | {a for a, b in calls if b == i} for i in ids}
    two = {i: set().union(*(nb[u] for u in nb[i])) - {i} for i in ids}
    want = sorted(((i, len(nb[i]), len(two[i])) for i in ids if kind[i] != "Call"), key=lambda x: (-x[1] - x[2], x[0]))[:7]
    got = [(r["id"], r["n_one"], r["n_two"]) for r in metrics.centrality_nodes(g, 7, heavy, ahead=ahead).collect()]
    assert sorted(got) == sorted(want)


def test_centrality_pairs_candidates_only(spark):
    """400 functions that touch two nodes of 200 neighbours each, and one that leads all: 80000 pairs if all were counted."""
    nodes = [(f"f{i:03}", "Function", f"f{i}", "a.py") for i in range(400)] + [(f"m{i}", "Call", f"m{i}", "a.py") for i in range(2)] + [("hub", "Function", "hub", "a.py")]
    g = a_graph(spark, nodes, [(f"f{i:03}", f"m{i % 2}") for i in range(400)] + [("hub", "m0"), ("hub", "m1")])
    rows, n = moved(spark, lambda: metrics.centrality_nodes(g, 1))
    assert [(r["id"], r["n_one"], r["n_two"]) for r in rows] == [("hub", 2, 400)]
    assert n < 30_000


def sets_of(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(k, set()).add(v)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_steps_equal_brute_force(spark, seed, monkeypatch):
    from spanweave.operators import twosteps

    rng = random.Random(seed)
    edges = lambda n, x, y: {(rng.randrange(x), rng.randrange(y)) for _ in range(n)}
    left, right, apart, near = edges(300, 40, 20), edges(400, 20, 60), edges(30, 40, 12), edges(60, 12, 60)
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), f"{names[0]} bigint, {names[1]} bigint").repartition(3)
    l, r, x, n = frame(left, "am"), frame(right, "mb"), frame(apart, "ah"), frame(near, "hb")
    b_of, near_of = sets_of(right), sets_of(near)
    want = {(a, b) for a, m in left for b in b_of.get(m, ())}
    less = want - {(a, b) for a, h in apart for b in near_of.get(h, ())}
    assert sorted(map(tuple, twosteps.two_steps(l, r).collect())) == sorted(want)
    got = twosteps.two_steps(l, r, x, n, counts=True, loops=False).collect()
    assert {tuple(v) for v in got} == {(a, len(s)) for a, s in sets_of((a, b) for a, b in less if a != b).items()}
    monkeypatch.setattr(twosteps, "CELL", 37)
    assert sorted(map(tuple, twosteps.two_steps(l, r, x, n).collect())) == sorted(less)
    run = twosteps._in_cell
    for most, listed in ((5, 3), (100, 7)):  # an a of more pairs than go at once, and several a at once

        def small(*given, most=most, listed=listed):
            def cell(batches):
                was = twosteps.PAIRS, twosteps.LIST
                twosteps.PAIRS, twosteps.LIST = most, listed
                try:
                    yield from run(*given)(batches)
                finally:  # the worker runs other queries after this
                    twosteps.PAIRS, twosteps.LIST = was

            return cell

        monkeypatch.setattr(twosteps, "_in_cell", small)
        assert sorted(map(tuple, twosteps.two_steps(l, r, x, n).collect())) == sorted(less)


def a_star(spark, calls):
    """A coded graph of calls between (kind, key)."""
    from spanweave.plans import stargraph as S

    ends = sorted({e for c in calls for e in c})
    n = spark.createDataFrame([(k * 8 + kind, "star", f"{S.KINDS[kind][0]}{k}", ["KGNode", S.KINDS[kind][1]], S.KINDS[kind][1], "x", None, None, None, None) for kind, k in ends],
                              "code bigint, graph_id string, id string, labels array<string>, entity_type string, name string, source_file string, start_line int, end_line int, description string")
    return S.Coded(n, spark.createDataFrame([(k * 8 + i, m * 8 + j, "CALLS") for (i, k), (j, m) in sorted(calls)], "src bigint, dst bigint, rel_type string"))


def through_parts(n=300):
    """n orders call a part that calls n suppliers."""
    from spanweave.plans import stargraph as S

    return {((S.CALL, i), (S.PART, 0)) for i in range(n)} | {((S.PART, 0), (S.SUPPLIER, i)) for i in range(n)}


def test_star_indirect_impacts_shuffles_no_pairs(spark):
    from spanweave.plans import stargraph

    c = a_star(spark, through_parts())
    rows, n = moved(spark, lambda: stargraph.indirect_impacts(c))
    assert {tuple(r) for r in rows} == {("star", f"Function:s{i}", f"Call:{j}") for i in range(300) for j in range(300)}
    assert len(rows) == 90_000 and n < 3000


def test_star_risk_level_shuffles_no_pairs(spark):
    from spanweave.plans import stargraph

    c = a_star(spark, through_parts())
    rows, n = moved(spark, lambda: stargraph.risk_level(c))
    assert {tuple(r) for r in rows} == {("star", f"Function:s{i}", 1, 300, 151.0, "high") for i in range(300)} and n < 5000


@pytest.mark.parametrize("seed", [1, 2])
def test_star_impacts_equal_those_on_ids(spark, seed):
    """Calls between all kinds, so that direct callers are also callers over two calls."""
    from spanweave.plans import stargraph

    rng = random.Random(seed)
    ends = [(rng.randrange(6), k) for k in range(25)]
    c = a_star(spark, {(a, b) for a, b in ((rng.choice(ends), rng.choice(ends)) for _ in range(120)) if a != b})
    g = c.graph()
    for own, general in ((stargraph.indirect_impacts, traversal.indirect_impacts), (stargraph.risk_level, traversal.risk_level)):
        assert sorted(map(tuple, own(c).collect())) == sorted(map(tuple, general(g).collect()))


def test_star_edges_need_both_ends(spark, tmp_path):
    """Keys that are no nodes, null and repeated ones."""
    import shutil

    from spanweave.plans import stargraph

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "d")
    for p in (tmp_path / "d").rglob("*"):
        p.chmod(0o755)
    (tmp_path / "d").chmod(0o755)
    at = str(tmp_path / "d" / "lineitem.parquet")
    li = spark.read.parquet(at)
    odd = li.limit(6).withColumn("l_orderkey", F.expr("CASE WHEN l_linenumber % 2 = 0 THEN -7 ELSE l_orderkey END")).withColumn("l_suppkey", F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 999999 END"))
    li.unionByName(odd).unionByName(li.limit(9)).write.parquet(at + "2")
    (tmp_path / "d" / "lineitem.parquet").unlink()
    shutil.move(at + "2", at)
    g = stargraph.star_graph(spark, str(tmp_path / "d"))
    ids = g.nodes.select("id").distinct()
    e = g.edges.select("src", "dst", "rel_type")
    assert e.count() == e.distinct().count() == e.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").count()
    was = stargraph.star_graph(spark, "/root/testdata/sf0.001").edges.select("src", "dst", "rel_type")
    assert was.exceptAll(e).isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_star_centrality_equals_that_on_ids(spark, seed):
    """Edges between all kinds and in both directions, at thresholds from nearly all to no heavy nodes."""
    from spanweave.plans import stargraph

    rng = random.Random(seed)
    ends = [(rng.randrange(6), k) for k in range(40)]
    c = a_star(spark, {(a, b) for a, b in ((rng.choice(ends), rng.choice(ends)) for _ in range(90)) if a != b})
    names = ("id", "n_one", "n_two", "centrality")
    for heavy, ahead in ((2, 1), (5, 10), (1000, 1)):
        got, want = stargraph.centrality_nodes(c, 6, heavy, ahead), metrics.centrality_nodes(c.graph(), 6, heavy, ahead)
        assert sorted(tuple(r[x] for x in names) for r in got.collect()) == sorted(tuple(r[x] for x in names) for r in want.collect())


def test_star_centrality_shuffles_no_pairs(spark):
    from spanweave.plans import stargraph

    c = a_star(spark, through_parts())
    rows, n = moved(spark, lambda: stargraph.centrality_nodes(c))
    assert {(r["id"], r["n_one"], r["n_two"]) for r in rows} == {(i, 1, 599) for i in sorted(f"Function:s{i}" for i in range(300))[:10]}
    assert n < 20_000
