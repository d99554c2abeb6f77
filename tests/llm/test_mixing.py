import itertools
import random

import pytest

from spanweave.llm import mixing as M

DOCS = "doc_id long, text string, source string, n_tokens string, copies string"
MIX = "source string, target_share double, max_repeats int"


def test_fit_is_exact_where_a_subset_is():
    rng = random.Random(2)
    for _ in range(150):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        rest = rng.randint(0, sum(sizes))
        counts = {n: sizes.count(n) for n in set(sizes)}
        take = M.fit_lengths(counts, rest, close=1000)
        assert all(0 <= k <= counts[n] for n, k in take.items())
        got = sum(n * k for n, k in take.items())
        best = max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= rest)
        assert got == best


def test_fit_large_counts():
    counts = {n: 1000 * n for n in range(3, 400)}
    total = sum(n * c for n, c in counts.items())
    for rest in (1, 2, 7, total // 3, total - 5, total):
        take = M.fit_lengths(counts, rest)
        assert 0 <= rest - sum(n * k for n, k in take.items()) <= (2 if rest < 3 or total - rest < 10 else 0) + (3 if total - rest == 5 else 0)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        s = rng.choice(["Big", "big ", "big", "small", "mid", "other", None])
        rows.append((i, None if i % 50 == 0 else "" if i % 51 == 0 else "word " * rng.randint(1, 40), s, "x", "y"))
    docs = spark.createDataFrame(rows + rows[:5], DOCS)
    return rows, *M.mix(docs, spark.createDataFrame([("big", 0.5, 2), ("small", 0.25, 3), ("mid", 0.2, 1), ("absent", 0.05, 1)], MIX))


def test_shares_and_repeats(mixed):
    rows, out, shares = mixed
    s = {r["source"]: r for r in shares.collect()}
    used = sum(r["tokens"] for r in s.values())
    for k, share in (("big", 0.5), ("small", 0.25), ("mid", 0.2)):
        assert abs(s[k]["tokens"] / used - share / 0.95) < 0.002
        assert s[k]["most_copies"] <= s[k]["max_repeats"] and s[k]["tokens"] == s[k]["budget"]
    assert s["absent"]["tokens"] == 0
    got = out.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    texts = {r[0]: r for r in rows}
    assert all(texts[r["doc_id"]][1] and r["copies"] >= 1 and texts[r["doc_id"]][2].strip().lower() == r["source"] for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    out, shares = M.mix(docs, spark.createDataFrame([("a", 1.0, 1)], MIX))
    assert out.count() == 0 and shares.count() == 1
    out, shares = M.mix(docs, spark.createDataFrame([], MIX))
    assert out.count() == 0 and shares.count() == 0


def test_fit_is_never_behind_another_subset():
    assert sum(n * k for n, k in M.fit_lengths({40000: 1, 50000: 1, 60000: 1}, 90000).items()) == 90000
    rng = random.Random(3)
    for i in range(150):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 9))]
        rest = rng.randint(1, sum(sizes))
        take = M.fit_lengths({n: sizes.count(n) for n in set(sizes)}, rest, close=4, seed=i)
        assert all(0 < k <= sizes.count(n) for n, k in take.items())
        assert sum(n * k for n, k in take.items()) == max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= rest)


@pytest.mark.parametrize("top", [400, 4000])
def test_single_lengths_are_drawn_at_any_size(top):
    """Neither the shortest nor the longest first, and by the seed."""
    counts = {n: 1 for n in range(2, top)}
    rest = sum(counts) // 3
    got = [M.fit_lengths(counts, rest, seed=s) for s in (1, 2)]
    assert got[0] != got[1]
    for take in got:
        assert sum(take) == rest and 0.4 < sum(take) / len(take) / (top / 2) < 1.6
        thirds = [sum(lo * top <= 3 * n < (lo + 1) * top for n in take) / (top / 3) for lo in range(3)]
        assert min(thirds) > 0.15 and max(thirds) < 0.55


def test_dense_and_coarse_histograms_are_met():
    rng = random.Random(4)
    for _ in range(12):
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 6000), rng.randint(400, 1500))}
        rest = rng.randint(10_000, sum(n * c for n, c in counts.items()))
        assert sum(n * k for n, k in M.fit_lengths(counts, rest).items()) == rest
    assert sum(n * k for n, k in M.fit_lengths({200000: 50, 100001: 50, 70003: 50}, 7_000_000).items()) == 7_000_000
