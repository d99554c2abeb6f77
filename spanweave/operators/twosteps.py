"""Distinct pairs (a, b) that some node m joins, out of (a, m) and (m, b), where there are many times more pairs than rows.

Pairs are never shuffled. The rows of a node m go together first; what leaves it is, for each cell of a grid over the
hashes of a and b, the a and the b of m that belong there. All that joins a to b is in one cell, so pairs are made,
made distinct and counted inside of it, some millions at a time. A cell holds about CELL rows of either side, so each
row goes to as many cells as the other side has parts. Ids are numbers (bigint); rows travel as packed columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of either side in a cell, pairs at once, rows packed at once, and ids in a list.
CELL, PAIRS, PACK, LIST = 6_000_000, 1_000_000, 1_000_000, 100_000
LEFT, RIGHT, APART, NEAR = range(4)
_BLOB = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(part: int, *runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """A row of one blob of runs of (m, x, side). Numbers are nearly in order and kept as differences."""
    out = pa.BufferOutputStream()
    batches = [pa.record_batch([pa.array(np.diff(v, prepend=v.dtype.type(0))) for v in run], names=["m", "x", "side"]) for run in runs]
    with pa.ipc.new_stream(out, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as w:
        for b in batches:
            w.write_batch(b)
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], schema=_BLOB)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """The runs of each blob."""
    for batch in batches:
        for blob in batch.column(1):
            with pa.ipc.open_stream(blob.as_buffer()) as r:
                yield [[np.cumsum(v := c.to_numpy(zero_copy_only=False), dtype=v.dtype) for c in b.columns] for b in r]


def _spread(parts: int):  # noqa: ANN202
    """Rows (m, x, side) to blobs of them for the parts that m is hashed to."""

    def out(m: np.ndarray, x: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        p = (_mixed(m) % np.uint64(parts)).astype(np.int32)
        by = np.lexsort((x, m, side, p))
        m, x, side, p = m[by], x[by], side[by], p[by]
        at = np.searchsorted(p, np.arange(parts + 1))
        for k in range(parts):
            if at[k] < at[k + 1]:
                s = slice(at[k], at[k + 1])
                yield _packed(k, (m[s], x[s], side[s]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = [], 0
        for b in batches:
            have.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n >= PACK:
                yield from out(*map(np.concatenate, zip(*have, strict=True)))
                have, n = [], 0
        if n:
            yield from out(*map(np.concatenate, zip(*have, strict=True)))

    return run


def _to_cells(rows: int, columns: int):  # noqa: ANN202
    """Rows (m, x, side), all of an m together, to blobs of (m, a) and (m, b) for the cells of the grid. m is numbered anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [run for blob in _unpacked(batches) for run in blob]
        if not have:
            return
        m, x, side = map(np.concatenate, zip(*have, strict=True))
        del have
        for one, other in ((LEFT, RIGHT), (APART, NEAR)):
            sides = []
            for s, parts in ((one, rows), (other, columns)):
                mine = side == s
                mm, xx = m[mine], x[mine]
                p = (_mixed(xx) % np.uint64(parts)).astype(np.int16)
                sides.append((mm, xx, p))
            both = np.intersect1d(sides[0][0], sides[1][0])
            if not len(both):
                continue
            cut = []
            for (mm, xx, p), parts in zip(sides, (rows, columns), strict=True):
                k = np.minimum(np.searchsorted(both, mm), len(both) - 1)
                in_both = both[k] == mm
                k, xx, p = k[in_both].astype(np.int32), xx[in_both], p[in_both]
                by = np.lexsort((xx, k, p))
                k, xx, p = k[by], xx[by], p[by]
                at = np.searchsorted(p, np.arange(parts + 1))
                cut.append([(k[at[i] : at[i + 1]], xx[at[i] : at[i + 1]]) for i in range(parts)])
            for i, (ka, a) in enumerate(cut[0]):
                for j, (kb, b) in enumerate(cut[1]):
                    if len(ka) and len(kb):
                        yield _packed(i * columns + j, (ka, a, np.full(len(ka), one, np.int8)), (kb, b, np.full(len(kb), other, np.int8)))

    return run


def _rows_of(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[0].. of lens[0], starts[1].. of lens[1] and so on."""
    upto = np.cumsum(lens)
    return np.repeat(starts - (upto - lens), lens) + np.arange(upto[-1] if len(upto) else 0)


class _Side:
    """(k, x) by k, for the k of one pair of sides, which are numbered through all blobs."""

    def __init__(self) -> None:
        self.k, self.x = [], []

    def add(self, k: np.ndarray, x: np.ndarray) -> None:
        self.k.append(k)
        self.x.append(x)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        k, x = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (self.k, self.x))
        self.k, self.x = [], []
        return k, x


def _in_cell(counts: bool, loops: bool):  # noqa: ANN202
    """Blobs of a cell to its distinct pairs: (a, number of b) or (a, list of b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, base = [_Side() for _ in range(4)], [0, 0]
        for (ka, a, s), (kb, b, _) in _unpacked(batches):
            at = base[s[0] // 2]
            sides[s[0]].add(ka + np.int32(at), a)
            sides[s[0] + 1].add(kb + np.int32(at), b)
            base[s[0] // 2] = at + int(max(ka[-1], kb[-1])) + 1
        if not base[0]:
            return
        ka, a = sides[LEFT].ends()
        ua, a = np.unique(a, return_inverse=True)
        a = a.astype(np.int32)
        kb, b = sides[RIGHT].ends()
        ub, b = np.unique(b, return_inverse=True)
        b = b.astype(np.int32)
        start = np.searchsorted(kb, np.arange(base[0] + 1)).astype(np.int64)
        del kb

        # what is left out of an a by its set of apart nodes; the a of one set go one after another
        kx, x = sides[APART].ends()
        at = np.minimum(np.searchsorted(ua, x), len(ua) - 1)
        known = ua[at] == x
        kx, x = kx[known], at[known]
        by = np.lexsort((kx, x))
        kx, x = kx[by], x[by]
        kn, near = sides[NEAR].ends()
        at = np.minimum(np.searchsorted(ub, near), len(ub) - 1)
        known = ub[at] == near
        kn, near = kn[known], at[known]
        near_at = np.searchsorted(kn, np.arange(base[1] + 1))
        sets: dict[bytes, int] = {b"": 0}
        of = np.zeros(len(ua), np.int64)
        cuts = np.searchsorted(x, np.arange(len(ua) + 1))
        for i in np.unique(x):
            of[i] = sets.setdefault(kx[cuts[i] : cuts[i + 1]].tobytes(), len(sets))
        members = [np.frombuffer(v, kx.dtype) for v in sets]
        place = np.argsort(of, kind="stable")
        ua, of = ua[place], of[place]
        rank = np.empty(len(place), np.int32)
        rank[place] = np.arange(len(place), dtype=np.int32)
        by = np.argsort(rank[a], kind="stable")
        a, ka = rank[a][by], ka[by]
        del by
        out = np.zeros(len(ub), bool)
        masked = 0
        itself = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
        itself = np.where(ub[itself] == ua, itself, -1)

        def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of pairs by i those that nothing leaves out."""
            nonlocal masked
            keep = np.ones(len(i), bool) if loops else j != itself[i]
            if len(sets) > 1:
                s = of[i]
                cuts = np.flatnonzero(np.diff(s, prepend=-1, append=-1))
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if s[lo]:
                        if masked != s[lo]:
                            for h in members[masked]:
                                out[near[near_at[h] : near_at[h + 1]]] = False
                            masked = s[lo]
                            for h in members[masked]:
                                out[near[near_at[h] : near_at[h + 1]]] = True
                        keep[lo:hi] &= ~out[j[lo:hi]]
            return (i, j) if keep.all() else (i[keep], j[keep])

        def rows(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j = kept(i, j)
            if not len(i):
                return
            cuts = np.flatnonzero(np.diff(i, prepend=-1))
            if counts:
                yield pa.record_batch({"a": pa.array(ua[i[cuts]]), "n": pa.array(np.diff(cuts, append=len(i)))})
                return
            cuts = np.union1d(cuts, np.arange(0, len(i), LIST))
            yield pa.record_batch({"a": pa.array(ua[i[cuts]]), "b": pa.ListArray.from_arrays(pa.array(np.append(cuts, len(i)).astype(np.int32)), pa.array(ub[j]))})

        lens = start[ka + 1] - start[ka]
        first = np.searchsorted(a, np.arange(len(ua) + 1))  # of each a
        upto = np.concatenate(([0], np.cumsum(lens)))[first]
        lo = 0
        while lo < len(ua):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
            e = slice(first[lo], first[hi])
            if hi == lo + 1 and upto[hi] - upto[lo] > PAIRS:  # one a of more pairs than go at once
                seen = np.zeros(len(ub), bool)
                for k in ka[e]:
                    seen[b[start[k] : start[k + 1]]] = True
                j = np.flatnonzero(seen)
                yield from rows(np.full(len(j), lo), j)
            else:
                small = (hi - lo) * len(ub) < 2**32
                kind = np.uint32 if small else np.int64
                key = np.repeat((a[e] - lo).astype(kind) * kind(len(ub)), lens[e])
                key += b[_rows_of(start[ka[e]], lens[e])].astype(kind)
                key.sort()
                key = key[np.flatnonzero(np.diff(key, prepend=key[:1] + kind(1)))] if len(key) else key
                i, j = np.divmod(key, kind(len(ub)))
                yield from rows(i.astype(np.int64) + lo, j.astype(np.int64))
            lo = hi

    return run


def two_steps(left: DataFrame, right: DataFrame, apart: DataFrame | None = None, near: DataFrame | None = None, counts: bool = False, loops: bool = True) -> DataFrame:
    """(a, b) as a row each, or (a, n), of distinct pairs out of left (a, m) and right (m, b); without loops none with
    b = a. With apart (a, h) and near (h, b), pairs that an h joins are left out. An a without pairs has no row."""
    spark = left.sparkSession
    given = [(left, "m", "a", LEFT), (right, "m", "b", RIGHT)] + ([(apart, "h", "a", APART), (near, "h", "b", NEAR)] if apart is not None else [])
    n_left, n_right = left.count(), right.count()
    rows, columns = max(1, -(-n_left // CELL)), max(1, -(-n_right // CELL))
    while rows * columns < spark.sparkContext.defaultParallelism:  # as many tasks as can run
        rows, columns = (rows, columns + 1) if n_left * (columns + 1) + n_right * rows <= n_left * columns + n_right * (rows + 1) else (rows + 1, columns)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_left + n_right) // CELL))
    all_rows = None
    for df, m, x, side in given:
        df = df.select(F.col(m).alias("m"), F.col(x).alias("x"), F.lit(side).cast("byte").alias("side"))
        all_rows = df if all_rows is None else all_rows.unionByName(df)
    blobs = "part int, blob binary"
    by_node = all_rows.mapInArrow(_spread(parts), blobs).repartitionById(parts, "part")
    in_cells = by_node.mapInArrow(_to_cells(rows, columns), blobs).repartitionById(rows * columns, "part")
    if counts:
        return in_cells.mapInArrow(_in_cell(True, loops), "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n"))
    return in_cells.mapInArrow(_in_cell(False, loops), "a bigint, b array<bigint>").select("a", F.explode("b").alias("b"))
