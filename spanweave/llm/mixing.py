"""Problem 8: mix sources to target weights.

Method. Subset-sum budget fitting. Documents are counted by exact token length per source; the largest total
that every source can serve with its allowed repeats fixes the budgets; whole passes over a source are taken
first. What remains of a budget is fitted on the length histogram alone: a proportional draw per length, rounded by
seeded hash, then a bounded-knapsack dynamic program over lengths in seeded order trades documents until the gap to
the budget is closed exactly where any subset can, and otherwise no subset is closer. Documents are then selected per length by seeded hash rank.

Scale. The histogram is a partial aggregate with one row per (source, length); one task per source solves its
program over it. Selection never sorts a whole length: hash slices of each (source, length) are counted, whole
slices are taken, and only the one slice that holds the border is ranked.

Defined cases: documents whose source is null or not in the mix, and null or empty texts (no tokens), are not
used; sources are compared in lower case without surrounding blanks; a source of the mix without documents
leaves its share empty and does not hold back the others; shares of the others stay relative to the given
shares; repeated rows of one id are one document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from spanweave.llm.bpe import count_tokens

#: Hash slices of each (source, length); of one slice at most is ranked.
SLICES = 1024
#: Width in tokens of the program's first try, after the proportional draw.
CLOSE_TOKENS = 65_536


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def measured(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of the mix, each id once."""
    mix = targets.select(source_key(F.col("source")).alias("source")).where("source is not null").distinct()
    d = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text").where("source is not null and text is not null and text <> ''")
    d = d.join(mix, "source", "left_semi")
    d = count_tokens(d, "text", "n_tokens", vocabulary).select("doc_id", "source", "n_tokens").where("n_tokens > 0")
    return d.groupBy("doc_id").agg(F.min_by("source", "n_tokens").alias("source"), F.min("n_tokens").alias("n_tokens"))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source of the mix: available tokens, budget, whole passes and the rest of the budget.

    The total is the largest one that no source has to exceed its repeats for (or `total_tokens`, if smaller)."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"))
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"))
    t = t.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    b = t.join(have, "source", "left").fillna(0, ["available", "n_docs"]).withColumn("target_share", F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0))))
    most = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("available") / F.col("target_share"))
    total = F.min(most).over(W.partitionBy())  # over one row per source of the mix
    b = b.withColumn("total", total if total_tokens is None else F.least(total, F.lit(float(total_tokens))))
    b = b.withColumn("budget", F.when(F.col("available") > 0, F.least(F.round(F.col("total") * F.col("target_share")).cast("long"), F.col("max_repeats") * F.col("available"))).otherwise(F.lit(0).cast("long")))
    b = b.withColumn("passes", F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")).cast("long"), F.col("max_repeats"))).otherwise(F.lit(0).cast("long")))
    return b.withColumn("rest", F.when(F.col("passes") < F.col("max_repeats"), F.col("budget") - F.col("passes") * F.col("available")).otherwise(F.lit(0).cast("long")))


def _unit(seed: int, n: int) -> float:
    """A number in [0, 1) by hash."""
    return int.from_bytes(hashlib.blake2b(f"{seed} {n}".encode(), digest_size=7).digest()) / (1 << 56)


def _trade(items: list[tuple[int, int]], gap: int, room: int) -> tuple[int, list[int]]:
    """The largest sum not above `gap` of a subset of the signed items (length, how many of it), over partial sums of
    at most `room` either way, and the items that make it. Per sum only the first item that reaches it is kept."""
    first = np.full(2 * room + 1, -1, dtype=np.int32)  # -1: not reached
    reached = np.zeros(2 * room + 1, dtype=bool)
    reached[room] = True
    for i, (n, k) in enumerate(items):
        if reached[room + gap]:
            break
        w, new = n * k, np.zeros_like(reached)
        if abs(w) > 2 * room:
            continue
        if w > 0:
            new[w:] = reached[:-w]
        else:
            new[:w] = reached[-w:]
        new &= ~reached
        first[new] = i
        reached |= new
    best = at = int(np.flatnonzero(reached[: room + gap + 1])[-1])
    chosen = []
    while at != room:
        i = int(first[at])
        chosen.append(i)
        at -= items[i][0] * items[i][1]
    return best - room, chosen


def fit_lengths(counts: dict[int, int], rest: int, close: int = CLOSE_TOKENS, seed: int = 7) -> dict[int, int]:
    """How many documents of each length to take so that the sum comes as close to `rest` as possible, not above.

    A proportional draw, rounded up or down by seeded hash per length, takes most of it; lengths visited in seeded
    order then bring it within a document of `rest`, and a bounded-knapsack program trades drawn documents for others
    until the sum is exact. It starts with sums of up to `close` either way and widens fourfold while a sum beyond
    could still come closer: an exchange needs no more documents than there are different sums within a longest
    document of its way, so (2 longest + gap + 1) * longest is wide enough for every exchange."""
    total = sum(n * c for n, c in counts.items())
    if rest <= 0 or total == 0:
        return {}
    if rest >= total:
        return dict(counts)
    unit = math.gcd(*counts)
    counts, rest, total = {n // unit: c for n, c in counts.items()}, rest // unit, total // unit
    order = sorted(counts, key=lambda n: (_unit(seed, n * unit), n))
    take = {}
    for n in order:
        whole, part = divmod(counts[n] * rest, total)
        take[n] = whole + (_unit(seed + 1, n * unit) < part / total)
    gap = rest - sum(n * k for n, k in take.items())
    moved = True
    while moved:  # one document of a length at a time, so that no length is preferred
        moved = False
        for n in order:
            if gap >= n and take[n] < counts[n]:
                take[n], gap, moved = take[n] + 1, gap - n, True
            elif gap < 0 and take[n] > 0:
                take[n], gap, moved = take[n] - 1, gap + n, True
    longest = max(counts)
    widest = min(total, (2 * longest + abs(gap) + 1) * longest)
    room = min(widest, max(close, 2 * longest + abs(gap)))
    while gap > 0:
        items = []
        for n in order:
            for free, sign in ((counts[n] - take[n], 1), (take[n], -1)):
                free, k = min(free, 2 * room // n), 1
                while free > 0:
                    items.append((sign * n, min(k, free)))
                    free -= k
                    k *= 2
        got, chosen = _trade(items, gap, room)
        if got == gap or room >= widest:
            for i in chosen:
                n, k = items[i]
                take[abs(n)] += k if n > 0 else -k
            break
        room = min(widest, 4 * room)
    return {n * unit: k for n, k in take.items() if k}


def _choose(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, extra) with extra 1 for the documents chosen for the rest of the budget."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    d = sizes.withColumn("slice", F.pmod(F.shiftrightunsigned(h, 20), F.lit(SLICES))).withColumn("h", h)
    counts = d.groupBy("source", "n_tokens", "slice").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("source", "n_tokens").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    quota = counts.join(plan, ["source", "n_tokens"]).withColumn("left", F.col("take") - F.coalesce(F.sum("n").over(w), F.lit(0)))
    quota = quota.where("left > 0").select("source", "n_tokens", "slice", "left", (F.col("left") < F.col("n")).alias("border"))
    d = d.join(quota, ["source", "n_tokens", "slice"])
    ranked = W.partitionBy("source", "n_tokens", "slice").orderBy("h", "doc_id")
    border = d.where("border").withColumn("r", F.row_number().over(ranked)).where("r <= left")
    return d.where("not border").select("doc_id", F.lit(1).alias("extra")).unionByName(border.select("doc_id", F.lit(1).alias("extra")))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, shares). documents: doc_id, source, n_tokens, copies >= 1, one row per document of the mix.
    shares: per source of the mix its target and actual share, tokens, available tokens, documents, largest copies."""
    from spanweave.session import cut_lineage

    sizes = cut_lineage(measured(docs, targets, vocabulary))  # tokenised once, read several times
    b = cut_lineage(budgets(sizes, targets, total_tokens).coalesce(1))  # one row per source of the mix
    hist = sizes.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    hist = hist.join(b.where("rest > 0").select("source", "rest"), "source")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit_lengths(dict(zip(pdf["n_tokens"].tolist(), pdf["n"].tolist())), int(pdf["rest"].iloc[0]), seed=seed)
        return pd.DataFrame({"source": pdf["source"].iloc[0], "n_tokens": list(take), "take": list(take.values())}).astype({"n_tokens": "int64", "take": "int64"})

    plan = hist.groupBy("source").applyInPandas(solve, "source string, n_tokens long, take long")
    extra = _choose(sizes, plan, seed)
    out = sizes.join(extra, "doc_id", "left").join(b.select("source", "passes"), "source")
    out = out.withColumn("copies", F.col("passes") + F.coalesce("extra", F.lit(0))).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    used = out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_used"), F.max("copies").alias("most_copies"))
    shares = b.join(used, "source", "left").fillna(0, ["tokens", "n_used", "most_copies"])
    every = W.partitionBy()  # over one row per source of the mix
    shares = shares.select(
        "source", "target_share", (F.col("tokens").cast("double") / F.sum("tokens").over(every)).alias("actual_share"),
        "tokens", "available", "budget", "n_docs", "n_used", "max_repeats", "most_copies",
    )
    return out, shares
