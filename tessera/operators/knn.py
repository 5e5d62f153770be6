"""Exact k nearest neighbours and hard-negative mining.

Metric partitioning.  A few corpus rows are pivots; every row belongs to the
cell of its nearest pivot and keeps its distance to it.  Cells are packed into
groups of bounded bytes (a large cell is split), queries into blocks in the order
of their own nearest pivots.  The triangle inequality bounds from below what any
row at pivot distances [low, high] can score against a query:

    |q - x| >= max(|q - p| - high, low - |q - p|)         l2 and cosine
    q.x     <= q.p + |q| high                             inner product

Round 1 sends every query to the group of its own cell, which gives an upper
bound of its k-th best.  Round 2 sends it to just those other groups whose bound
is still open.  Inside a group a cell is cut into rings of sorted pivot
distances; a block of queries first meets its nearest rings, then only those
that some query's bound leaves open.  Whatever is skipped cannot hold a result:
the answer is exact (ties by id), with pruning or without.

Round 2 runs by blocks of queries: the groups that a block asks for pass through
its task one after the other, and a query's best so far close its bound for the
next group.  So at most ``k`` rows per query leave each round, and a row of the
corpus travels once per block of some MB of query vectors, whatever ``k`` is.
Where nothing can be pruned (no structure, many dimensions), each query meets
every row once, in matrix products.  A corpus that is one group is broadcast to
the queries where they are.  Texts are joined only after the top-k (ids travel,
not strings).

With ``enough`` only so many neighbours of other labels are asked for: what lies
behind the last of them is not returned, so a rank among the ``k`` best is
still exact for all that is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.session import scratch_path

METRICS = ("l2", "ip", "cosine")
PIVOTS, SAMPLE = 256, 2048  # cells, and rows that they are chosen from
RING = 1024                 # rows of a cell that share a bound inside a group
STEP = 128                  # queries that go through a group together, at least
CHUNK = 1 << 20             # cells of a matrix product
RESULTS = 1 << 18           # results that leave a worker at a time
HELD = 1 << 23              # results of a block of queries that a task holds; more are handed on before the next group
LOOSE = 4e-6                # bounds are widened by this share of the lengths involved: above the rounding of distances
_OUT, _NAMES = "qid long, cid long, ord double, other boolean", ["qid", "cid", "ord", "other"]


# ---------------------------------------------------------------- bounds
def _rows(col) -> np.ndarray:
    """Matrix of a list column without nulls."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _distances(x: np.ndarray, pivots: np.ndarray, mid: np.ndarray) -> np.ndarray:
    """Euclidean distances, taken from ``mid``, so that a common offset costs no digits."""
    a, b = x - mid, pivots - mid
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)))


def lower_bounds(metric: str, q: np.ndarray, pivots: np.ndarray, mid: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By query and ring the least ``ord`` (smaller is better) that a row can
    have whose distance to the ring's pivot is in [low, high]."""
    if metric == "ip":
        size = np.linalg.norm(q, axis=1)[:, None]
        far = np.linalg.norm(pivots, axis=1) + np.linalg.norm(pivots - mid, axis=1) + high
        return -(q @ pivots.T + size * high + LOOSE * size * far)
    dist = _distances(q, pivots, mid)
    loose = LOOSE * (np.linalg.norm(q - mid, axis=1)[:, None] + np.linalg.norm(pivots - mid, axis=1) + high)
    gap = np.maximum(np.maximum(dist - high, low - dist) - loose, 0.0)
    return gap * gap if metric == "l2" else gap * gap / 2 - 1 - LOOSE


@dataclass
class Cells:
    """The cells of a corpus: pivot, least and greatest distance to it, rows,
    first group and number of groups.  One entry per pivot."""

    metric: str
    pivots: np.ndarray
    mid: np.ndarray  # distances are taken from here
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    rows: np.ndarray | None = None
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    @property
    def n_groups(self) -> int:
        return int((self.first + self.parts).max())

    def pack(self, rows_per_group: int) -> None:
        """Small cells share a group, large ones are split."""
        self.parts = np.maximum(1, -(-self.rows // rows_per_group))
        self.first, group, held = np.zeros(len(self.rows), dtype=np.int64), 0, 0
        for i, n in enumerate(self.rows):
            if held and held + n > rows_per_group:
                group, held = group + 1, 0
            self.first[i] = group
            if self.parts[i] > 1:
                group, held = group + int(self.parts[i]), 0
            else:
                held += n

    def open_groups(self, q: np.ndarray, home: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
        """Per query the groups, but for its home, that can hold a row with
        ``ord`` of at most ``most``."""
        near = lower_bounds(self.metric, q, self.pivots, self.mid, self.low, self.high) <= most[:, None]
        of_cell = [range(f, f + n) for f, n in zip(self.first.tolist(), self.parts.tolist())]
        out = []
        for i in range(len(q)):
            found = {g for c in np.flatnonzero(near[i]) for g in of_cell[c]}
            out.append(np.array(sorted(found - {int(home[i])}), dtype=np.int64))
        return out


# ---------------------------------------------------------------- one group
def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix whose rows are multiples of 8 long, few of it true."""
    words = np.flatnonzero(mask.view(np.uint64))
    i, j = np.nonzero(mask.reshape(-1, 8)[words])
    return np.divmod(words[i] * 8 + j, mask.shape[1])


def _runs(rings: list[slice], which: np.ndarray, rows: int) -> list[slice]:
    """The chosen rings, side by side ones as one slice of up to ``rows``."""
    out: list[slice] = []
    for r in np.sort(which):
        at = rings[r]
        if out and out[-1].stop == at.start and at.stop - out[-1].start <= rows:
            out[-1] = slice(out[-1].start, at.stop)
        else:
            out.append(at)
    return out


def _best(k: int, need: int, ids: np.ndarray, o: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first ``k`` by (ord, id), up to the ``need``-th of another label."""
    at = np.lexsort((ids, o))[:k]
    if need:
        far = np.flatnonzero(other[at])
        at = at[:far[need - 1] + 1] if len(far) >= need else at
    return ids[at], o[at], other[at]


def _others(labels: np.ndarray, own) -> np.ndarray:
    """Which labels differ from ``own``; 0, no label, differs from none."""
    return (labels != own) & (labels != 0) & (own != 0)


def block_topk(metric: str, k: int, group: Group, bounds: np.ndarray, q: np.ndarray, most: np.ndarray,
               seen: dict | None = None, labels: np.ndarray | None = None, need: int = 0) -> list[tuple[np.ndarray, ...]]:
    """Per query ``(ids, ords, others)`` of the best ``k`` rows of a group with
    ``ord`` of at most ``most`` (the bound known so far), up to the ``need``-th
    whose label is another than the query's (0: all).  ``bounds`` are the
    ``lower_bounds`` by query and ring; ``seen`` counts those pairs and the
    ones that were skipped.  Rows come up in matrix products of bounded size;
    only those within a query's bound are looked at, and the bound falls to the
    k-th best, or the ``need``-th of the others, whenever twice as many rows were
    met."""
    x, ids, rings = group.x, group.ids, group.rings
    mid, wide, top = group.products(metric)
    qc = q - mid
    sizes, size = np.array([r.stop - r.start for r in rings]), (qc * qc).sum(axis=1)
    slack = 8 * np.finfo(np.float64).eps * (x.shape[1] + 4) * (size + top)
    base = size if metric == "l2" else np.zeros(len(q))  # products lack the query's own length
    asked = np.hstack([-2.0 * qc, np.ones((len(q), 1))]) if metric == "l2" else -qc
    limit = most - base + slack
    rows, values = [[] for _ in q], [[] for _ in q]
    want = min(k, 2 * need) if need else k

    def meet(runs: list[slice], products: np.ndarray) -> None:
        place = np.concatenate([np.arange(r.start, r.stop) for r in runs])
        mask = np.zeros((len(q), -(-len(place) // 8) * 8), dtype=bool)
        np.less_equal(products, limit[:, None], out=mask[:, :len(place)])
        i, j = _true(mask)
        ends = np.searchsorted(i, np.arange(len(q) + 1))
        found, here = products[i, j], place[j]
        for n in np.flatnonzero(np.diff(ends)):
            rows[n].append(here[ends[n]:ends[n + 1]])
            values[n].append(found[ends[n]:ends[n + 1]])

    def tighten() -> None:
        for n in range(len(q)):
            if sum(map(len, values[n])) > want:
                v, at = np.concatenate(values[n]), np.concatenate(rows[n])
                far = v[_others(group.labels[at], labels[n])] if need else v[:0]
                for some, last in ((v, k), (far, need)):
                    if last and len(some) > last:
                        limit[n] = min(limit[n], np.partition(some, last - 1)[last - 1] + slack[n])
                rows[n], values[n] = [at[v <= limit[n]]], [v[v <= limit[n]]]

    nearest = np.argsort(bounds.min(axis=0), kind="stable")
    done = nearest[:np.searchsorted(np.cumsum(sizes[nearest]), max(4 * want, RING)) + 1]
    first = _runs(rings, done, len(x))
    products = np.hstack([asked @ wide[r].T for r in first])
    if products.shape[1] >= k:
        limit = np.minimum(limit, np.partition(products, k - 1, axis=1)[:, k - 1] + slack)
    if need and products.shape[1] >= need:
        other = _others(np.concatenate([group.labels[r] for r in first])[None, :], labels[:, None])
        limit = np.minimum(limit, np.partition(np.where(other, products, np.inf), need - 1, axis=1)[:, need - 1] + slack)
    meet(first, products)
    open_rings = np.setdiff1d(np.flatnonzero((bounds <= (limit + base)[:, None]).any(axis=0)), done)
    if seen is not None:
        seen["pairs"] += len(q) * len(rings)
        seen["skipped"] += len(q) * (len(rings) - len(done) - len(open_rings))
    met = at_last = products.shape[1]
    for run in _runs(rings, open_rings, max(RING, CHUNK // len(q))):
        meet([run], asked @ wide[run].T)
        met += run.stop - run.start
        if met >= 2 * at_last:
            tighten()
            at_last = met
    tighten()
    out = []
    for i in range(len(q)):
        at = np.concatenate([*rows[i], np.zeros(0, dtype=np.int64)]).astype(np.int64)
        o = ((x[at] - q[i]) ** 2).sum(axis=1) if metric == "l2" else -(x[at] @ q[i])
        keep = o <= most[i] + slack[i]
        at, o = at[keep], o[keep]
        out.append(_best(k, need, ids[at], o, _others(group.labels[at], labels[i]) if need else np.zeros(len(at), dtype=bool)))
    return out


class Group:
    """The rows of a group, cut into rings of their cells."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, dist: np.ndarray, labels: np.ndarray | None = None):
        by = np.lexsort((dist, cell))
        self._products = None
        self.labels = None if labels is None else labels[by]
        self.x, self.ids, cell, dist = x[by], ids[by], cell[by], dist[by]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.rings = [slice(a, min(a + RING, end)) for s, end in zip(starts, [*starts[1:], len(cell)]) for a in range(s, end, RING)]
        self.cell = np.array([cell[r.start] for r in self.rings])
        self.low, self.high = np.array([dist[r.start] for r in self.rings]), np.array([dist[r.stop - 1] for r in self.rings])

    def products(self, metric: str) -> tuple:
        """``mid``, the rows as a matrix product needs them (l2: from ``mid``,
        their squared lengths beside them) and the largest squared length; made
        once per task."""
        if self._products is None:
            mid = self.x.mean(axis=0) if metric == "l2" else 0.0  # distances do not change, digits are kept
            wide = self.x
            if metric == "l2":
                wide = np.empty((len(self.x), self.x.shape[1] + 1))
                np.subtract(self.x, mid, out=wide[:, :-1])
                wide[:, -1] = np.einsum("ij,ij->i", wide[:, :-1], wide[:, :-1])
            top = wide[:, -1].max() if metric == "l2" else np.einsum("ij,ij->i", wide, wide).max()
            self._products = mid, wide, top
        return self._products

    def answer(self, own: Cells, k: int, qid: np.ndarray, q: np.ndarray, most: np.ndarray, counts=None,
               cells: int = 1 << 22, labels: np.ndarray | None = None, need: int = 0) -> Iterator[list[np.ndarray]]:
        """``qid, cid, ord, other`` of the best of every query, by a bounded number
        of queries; near queries should stand side by side."""
        step, seen = max(1, min(max(STEP, cells // len(self.x)), RESULTS // k)), {"pairs": 0, "skipped": 0}
        for at in range(0, len(q), step):
            some = q[at:at + step]
            bounds = lower_bounds(own.metric, some, own.pivots[self.cell], own.mid, self.low, self.high)
            found = block_topk(own.metric, k, self, bounds, some, most[at:at + step], seen,
                               None if labels is None else labels[at:at + step], need)
            parts = [(np.full(len(c), qid[at + i]), c, *more) for i, (c, *more) in enumerate(found)]
            yield [np.concatenate(c) for c in zip(*parts)]
        if counts:
            counts[0].add(seen["pairs"])
            counts[1].add(seen["skipped"])


class _Block:
    """A block of queries, side by side by cell, and the best of each so far."""

    def __init__(self, own: Cells, k: int, need: int, rows: pa.Table, home: bool):
        rows = rows.sort_by([("cell", "ascending"), ("id", "ascending")])
        self.own, self.k, self.need = own, k, need
        self.qid, self.q, self.labels = rows["id"].to_numpy(), _rows(rows["vec"]), rows["label"].to_numpy()
        self.most = rows["far"].to_numpy().copy()
        at = rows["home"].to_numpy()
        groups = [np.array([g]) for g in at] if home else own.open_groups(self.q, at, self.most)
        self.asks = np.zeros((len(at), own.n_groups), dtype=bool)
        for i, g in enumerate(groups):
            self.asks[i, g] = True
        self.found: list = [None] * len(at)

    def meet(self, number: int, rows: pa.Table, counts=None) -> None:
        which = np.flatnonzero(self.asks[:, number])
        if not len(which):
            return
        group = Group(_rows(rows["vec"]), *(rows[c].to_numpy() for c in ("id", "cell", "far", "label")))
        for at, *new in group.answer(self.own, self.k, which, self.q[which], self.most[which], counts,
                                     labels=self.labels[which], need=self.need):
            cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:]):
                self._add(int(at[a]), *(x[a:b] for x in new))

    def _add(self, i: int, *new: np.ndarray) -> None:
        old = self.found[i]
        self.found[i] = new if old is None else _best(self.k, self.need, *(np.concatenate(x) for x in zip(old, new)))
        _, o, other = self.found[i]
        if len(o) >= self.k or self.need and other.sum() >= self.need:
            self.most[i] = min(self.most[i], o[-1])

    def held(self) -> int:
        return sum(len(x[0]) for x in self.found if x is not None)

    def results(self) -> Iterator[pa.RecordBatch]:
        """Hands on what was found; the bounds stay."""
        step = max(1, RESULTS // self.k)
        for at in range(0, len(self.qid), step):
            some = [(np.full(len(x[0]), self.qid[i]), *x) for i, x in enumerate(self.found[at:at + step], at) if x is not None]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*some)], _NAMES)
        self.found = [None] * len(self.qid)


def _block_topk(shared, k: int, need: int, home: bool, counts=None):
    """Rows sorted by task and group, the queries of a block before all groups
    (group -1) -> what the groups have for them.  One group is held at a time."""
    def run(batches):
        own: Cells = shared.value
        here, parts, block = None, [], None

        def close():
            nonlocal block
            rows = pa.Table.from_batches(parts)
            if here[1] < 0:
                block = _Block(own, k, need, rows, home)
            elif block is not None:
                block.meet(here[1], rows, counts)

        for b in batches:
            at, grp = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(grp) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                key = (int(at[lo]), int(grp[lo]))
                if here is not None and key != here:
                    close()
                    parts = []
                    if block is not None and (key[0] != here[0] or block.held() > HELD):
                        yield from block.results()
                        block = None if key[0] != here[0] else block
                here = key
                parts.append(b.slice(lo, hi - lo))
        if here is not None:
            close()
            if block is not None:
                yield from block.results()

    return run


def _whole_topk(shared, k: int, counts=None, need: int = 0):
    """Queries against a corpus that is a single group; a third column has
    their labels."""
    def run(batches):
        own, group = shared.value
        for b in batches:
            if b.num_rows:
                q, qid = _rows(b.column(1)), b.column(0).to_numpy()
                q = _unit(q) if own.metric == "cosine" else q
                by = np.lexsort((qid, _distances(q, own.pivots, own.mid).argmin(axis=1)))
                labels = b.column(2).to_numpy()[by] if need else None
                for out in group.answer(own, k, qid[by], q[by], np.full(len(q), np.inf), counts, labels=labels, need=need):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], _NAMES)

    return run


# ---------------------------------------------------------------- plan
def _label(col: str | None):
    """A label as a number, 0 for none; labels that differ may share one."""
    return F.when(F.col(col).isNotNull(), F.xxhash64(col)).otherwise(0).cast("bigint") if col else F.lit(0).cast("bigint")


def _element(df: DataFrame, vec: str, metric: str) -> str:
    """Vectors of floats travel as such."""
    return "float" if metric != "cosine" and df.schema[vec].dataType.simpleString() == "array<float>" else "double"


def _placed(df: DataFrame, id_col: str, vec_col: str, label: str | None, metric: str, pivots: np.ndarray, mid: np.ndarray) -> DataFrame:
    """``(id, vec, label, cell, dist)`` of the rows with a vector, stored."""
    shared = df.sparkSession.sparkContext.broadcast((pivots, mid))  # at most PIVOTS vectors
    kind = _element(df, vec_col, metric)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), _label(label).alias("label")).where("vec is not null")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b.column(1))
            x = _unit(x) if metric == "cosine" else x
            d = _distances(x, *shared.value)
            cell = d.argmin(axis=1)
            at = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel().astype(np.float32 if kind == 'float' else np.float64))), b.column(2), pa.array(cell),
                                              pa.array(d[np.arange(len(x)), cell])], ["id", "vec", "label", "cell", "dist"])

    path = scratch_path(df.sparkSession, "cells")
    rows.mapInArrow(run, f"id long, vec array<{kind}>, label long, cell long, dist double").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sample(corpus: DataFrame, c_id: str, c_vec: str, label: str | None) -> pa.Table:
    """``(cid, cvec, label)`` of the rows with the smallest hashes: all of a small table."""
    own = corpus.where(F.col(c_vec).isNotNull()).select(F.col(c_id).cast("bigint").alias("cid"), F.col(c_vec).cast("array<double>").alias("cvec"),
                                                        _label(label).alias("label"))
    return own.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toArrow()


def _blocks(cell_rows: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of the queries of a cell: about equal
    runs of cells, a large cell split."""
    rows = np.array([cell_rows.get(c, 0) for c in range(max(cell_rows, default=0) + 1)], dtype=np.int64)
    per = max(1, -(-int(rows.sum()) // n))
    before = np.cumsum(rows) - rows
    return np.minimum(before // per, n - 1), np.maximum(1, -(-rows // per))


def knn_topk(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2",
             q_id: str = "qid", q_vec: str = "qvec", c_id: str = "cid", c_vec: str = "cvec",
             buckets: int | None = None, query_blocks: int | None = None,
             group_bytes: int = 64 << 20, block_bytes: int = 16 << 20, counts=None,
             enough: tuple[str, str, int] | None = None) -> DataFrame:
    """``(qid, rank, cid, score)``: the exact ``k`` best corpus rows per query.

    ``metric``: ``l2`` (squared distance, ascending - the flat-index default),
    ``ip`` (inner product, descending) or ``cosine``.  A group holds about
    ``group_bytes`` of vectors, a block of queries about ``block_bytes``;
    ``buckets`` and ``query_blocks`` set their numbers instead.  ``counts``: two
    accumulators for the (query, ring) pairs met and those of them skipped.
    ``enough``: label columns of queries and corpus and a number; of the ``k``
    best of a query at least those up to that many of other labels come back,
    with their ranks.  Rows without a vector are left out."""
    if metric not in METRICS:
        raise ValueError(metric)
    spark = corpus.sparkSession
    q_label, c_label, need = enough or (None, None, 0)
    some = _sample(corpus, c_id, c_vec, c_label)
    if not some.num_rows:
        return spark.createDataFrame([], "qid long, rank int, cid long, score double")
    x = _unit(_rows(some["cvec"])) if metric == "cosine" else _rows(some["cvec"])
    pivots = np.unique(x[:max(1, min(PIVOTS, len(x) // 8))], axis=0)
    mid = pivots.mean(axis=0)
    if len(x) < SAMPLE and buckets is None:  # that was the whole corpus
        d = _distances(x, pivots, mid)
        cell = d.argmin(axis=1)
        whole = Group(x, some["cid"].to_numpy(), cell, d[np.arange(len(x)), cell], some["label"].to_numpy())
        return _ranked(_from_one_group(queries, q_id, q_vec, q_label, Cells(metric, pivots, mid), whole, k, counts, need), k, metric)
    c = _placed(corpus, c_id, c_vec, c_label, metric, pivots, mid)
    stats = c.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("cell").collect()
    n_rows, rows_per_group = sum(r["n"] for r in stats), group_bytes // (8 * pivots.shape[1])
    if n_rows <= rows_per_group and buckets is None:
        t = c.toArrow()  # at most group_bytes
        whole = Group(_rows(t["vec"]), *(t[n].to_numpy() for n in ("id", "cell", "dist", "label")))
        return _ranked(_from_one_group(queries, q_id, q_vec, q_label, Cells(metric, pivots, mid), whole, k, counts, need), k, metric)
    number = np.array([r["cell"] for r in stats])  # of the pivots with rows; at most PIVOTS
    own = Cells(metric, pivots[number], mid, *(np.array([r[f] for r in stats]) for f in ("low", "high", "n")))
    own.pack(max(1, -(-n_rows // buckets) if buckets else rows_per_group))
    renumber = {int(old): new for new, old in enumerate(number)}
    q = _placed(queries, q_id, q_vec, q_label, metric, own.pivots, mid)
    asked = {r["cell"]: r["n"] for r in q.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_queries, tasks = sum(asked.values()), 2 * spark.sparkContext.defaultParallelism
    if query_blocks is None:
        per_block = max(1, block_bytes // (8 * pivots.shape[1]))
        query_blocks = max(math.ceil(n_queries / per_block), min(math.ceil(n_queries / 64), math.ceil(tasks / own.n_groups)))
    query_blocks = max(1, query_blocks)
    lanes = min(own.n_groups, math.ceil(tasks / query_blocks))  # few blocks: a block's groups are dealt to several tasks
    first_block, n_blocks = _blocks(asked, query_blocks)

    def pick(values, col="cell"):
        table = F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<long>")  # folded to a constant
        return F.element_at(table, (F.col(col) + 1).cast("int"))

    def spread(key: str, first, parts):
        return pick(first) + F.pmod(F.xxhash64(key, F.lit(7)), pick(parts))

    if list(renumber) != list(range(len(pivots))):
        c = c.withColumn("cell", pick([renumber.get(i, 0) for i in range(len(pivots))]))
    c = c.withColumn("grp", spread("id", own.first, own.parts))
    q = q.withColumn("home", spread("id", own.first, own.parts))
    q = q.withColumn("block", F.least(spread("id", first_block, n_blocks), F.lit(query_blocks - 1)))
    shared = spark.sparkContext.broadcast(own)
    c_vec, q_vec = (F.col("vec").cast("array<double>" if _element(c, "vec", metric) != _element(q, "vec", metric) else x.schema["vec"].dataType) for x in (c, q))

    def meet(q: DataFrame, pairs: DataFrame, home: bool) -> DataFrame:
        """``pairs``: the ``(block, grp)`` that ask for each other."""
        pairs = pairs.distinct().select("block", F.col("grp").alias("_g"))
        task = lambda grp: (F.col("block") * lanes + F.pmod(F.col(grp), F.lit(lanes))).alias("task")
        there = c.join(pairs, F.col("grp") == F.col("_g")).select(
            task("grp"), "grp", "id", c_vec.alias("vec"), "label", "cell", F.col("dist").alias("far"), F.col("grp").alias("home"))
        where = task("home") if home else F.explode(F.sequence(F.col("block") * lanes, F.col("block") * lanes + (lanes - 1))).alias("task")
        ask = q.select(where, F.lit(-1).cast("bigint").alias("grp"), "id", q_vec.alias("vec"), "label", "cell", F.col("most").alias("far"), "home")
        rows = ask.unionByName(there).repartitionById(query_blocks * lanes, F.col("task").cast("int")).sortWithinPartitions("task", "grp")
        return rows.mapInArrow(_block_topk(shared, k, need, home, counts), _OUT)

    found = meet(q.withColumn("most", F.lit(float("inf"))), q.select("block", F.col("home").alias("grp")), True)
    if own.n_groups > 1:
        path = scratch_path(spark, "home")
        found.write.parquet(path)
        found = spark.read.parquet(path)
        worst = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("other").cast("long")).alias("m"), F.max("ord").alias("most"))
        full = (F.col("n") >= k) | (F.col("m") >= need) if need else F.col("n") >= k
        path = scratch_path(spark, "bounds")
        q.join(worst, q.id == worst.qid, "left").withColumn("most", F.when(full, F.col("most")).otherwise(float("inf"))).drop("n", "m", "qid").write.parquet(path)
        q = spark.read.parquet(path)
        found = found.unionByName(meet(q, _open(q, shared), False))
    return _ranked(found, k, metric)


def _ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("ord", "cid")
    score = F.col("ord") if metric == "l2" else -F.col("ord")
    return (found.select("qid", "cid", "ord").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "rank", "cid", score.alias("score")))


def _from_one_group(queries: DataFrame, q_id: str, q_vec: str, q_label: str | None, own: Cells, whole: Group, k: int, counts, need: int) -> DataFrame:
    """The corpus, of bounded bytes, goes to every task of the queries."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((own, whole))
    labels = [_label(q_label).alias("label")] if need else []
    q = queries.select(F.col(q_id).cast("bigint").alias("qid"), F.col(q_vec).cast("array<double>").alias("qvec"), *labels).where("qvec is not null")
    return q.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(_whole_topk(shared, k, counts, need), _OUT)


def _open(q: DataFrame, shared) -> DataFrame:
    """``(block, grp)`` of the further groups that bounds of the block's queries leave open."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            groups = shared.value.open_groups(_rows(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy())
            at = np.repeat(b.column(0).to_numpy(), list(map(len, groups)))
            if len(at):
                pairs = np.unique(np.stack([at, np.concatenate(groups)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["block", "grp"])

    return q.select("block", "vec", "home", "most").mapInArrow(run, "block long, grp long")


def rank_slice(ranked: DataFrame, skip: int, take: int | None, key: str = "qid",
               order=("rank",), out: str = "rank") -> DataFrame:
    """Ranks ``(skip, skip + take]`` after re-ranking by ``order`` within key
    (rows per key are bounded by k)."""
    w = Window.partitionBy(key).orderBy(*order)
    r = ranked.withColumn(out, F.row_number().over(w))
    cond = F.col(out) > skip
    if take is not None:
        cond = cond & (F.col(out) <= skip + take)
    return r.where(cond)


def hard_negatives(queries: DataFrame, corpus: DataFrame, k: int = 128, skip: int = 30,
                   take: int | None = None, metric: str = "l2", order: str = "nearest_first",
                   exclusion: str = "none", positives: DataFrame | None = None,
                   q_cluster: str | None = None, c_cluster: str | None = None,
                   **knn_kw) -> DataFrame:
    """``(qid, rank, cid)`` hard negatives.

    - ``order="nearest_first"`` drops the ``skip`` nearest (the intent: avoid
      false negatives); ``"farthest_first"`` sorts the k neighbours farthest
      first before dropping (the literal behaviour of a descending sort of
      distances).
    - ``exclusion``: ``none``; ``positive_ids`` (``positives(qid, cid)``
      removed before the skip); ``same_cluster`` (neighbours whose cluster
      equals the query's removed).
    """
    if (exclusion == "same_cluster" and order == "nearest_first" and take is not None  # no more are kept
            and queries.schema[q_cluster].dataType == corpus.schema[c_cluster].dataType):
        knn_kw = {**knn_kw, "enough": (q_cluster, c_cluster, skip + take)}
    top = knn_topk(queries, corpus, k, metric, **knn_kw)
    if exclusion == "positive_ids":
        top = top.join(positives.select("qid", "cid"), ["qid", "cid"], "left_anti")
    elif exclusion == "same_cluster":
        qc = queries.select(F.col(knn_kw.get("q_id", "qid")).cast("bigint").alias("qid"),
                            F.col(q_cluster).alias("_qc"))
        cc = corpus.select(F.col(knn_kw.get("c_id", "cid")).cast("bigint").alias("cid"),
                           F.col(c_cluster).alias("_cc"))
        top = top.join(qc, "qid").join(cc, "cid").where(F.col("_qc") != F.col("_cc")).drop("_qc", "_cc")
    elif exclusion != "none":
        raise ValueError(exclusion)
    top = top.withColumnRenamed("rank", "_r0")
    o = F.col("_r0").desc() if order == "farthest_first" else F.col("_r0")
    return rank_slice(top, skip, take, "qid", [o]).drop("_r0")


#: Entries of the lists of a block of queries, and bits of the filter of the ids that are asked for.
LISTED, FILTER = 1 << 23, 1 << 23


def _packed(wanted):
    """``(cid, text)`` of the ids that the filter lets pass, texts compressed."""
    def run(batches):
        import pandas as pd

        codec, bits = pa.Codec("zstd"), wanted.value
        for b in batches:
            ids = b.column(0).to_numpy()
            at = np.flatnonzero(bits[pd.util.hash_array(ids).astype(np.uint64) % np.uint64(FILTER)])
            for s in range(0, len(at), 1024):
                some = at[s:s + 1024]
                texts = [None if t is None else t.encode() for t in b.column(1).take(pa.array(some)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                                                  pa.array([None if t is None else codec.compress(t, asbytes=True) for t in texts], pa.binary())],
                                                 ["cid", "size", "packed"])

    return run


def _asked_bits(lists: DataFrame) -> np.ndarray:
    """A filter of bounded size: which hashes of ids are in any list."""
    def run(batches):
        import pandas as pd

        seen = np.zeros(FILTER, dtype=bool)
        for b in batches:
            seen[pd.util.hash_array(b.column(0).flatten().to_numpy()).astype(np.uint64) % np.uint64(FILTER)] = True
        at = np.flatnonzero(seen).astype(np.int32)
        for s in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[s:s + (1 << 16)])], ["bit"])

    bits = np.zeros(FILTER, dtype=bool)
    bits[lists.select("cids").mapInArrow(run, "bit int").distinct().toArrow()["bit"].to_numpy()] = True  # FILTER numbers at most
    return bits


def _lists_of_texts(batches):
    """A block's texts, stored in a file of the task, and its lists of ids ->
    ``(qid, negative)``, some MB at a time."""
    import mmap
    import tempfile

    asked, places, end = [], {}, 1
    with tempfile.TemporaryFile() as store:
        store.write(b"\0")  # an empty file cannot be mapped
        for b in batches:
            listed = b.column(3).is_valid()
            asked.append(b.filter(listed).select(["qid", "ranks", "cids"]))
            texts = b.filter(pc.invert(listed))
            for cid, size, packed in zip(*(texts.column(i).to_pylist() for i in (4, 5, 6))):
                held = 0 if packed is None else len(packed)
                places.setdefault(cid, []).append((end, end + held, size))
                store.write(packed or b"")
                end += held
        store.flush()
        with mmap.mmap(store.fileno(), 0, access=mmap.ACCESS_READ) as texts:
            yield from _filled(asked, places, texts)


def _filled(asked: list[pa.RecordBatch], places: dict, texts) -> Iterator[pa.RecordBatch]:
    codec, ids, flat, ends, held = pa.Codec("zstd"), [], [], [0], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))], ["qid", "negative"])

    for b in asked:
        for i in range(b.num_rows):
            ranks, cids = (b.column(c)[i].values.to_numpy() for c in (1, 2))
            found = [(r, c, at) for r, c in zip(ranks.tolist(), cids.tolist()) for at in places.get(c, ())]
            row = [None if size is None else codec.decompress(texts[a:z], size, asbytes=True) for _, _, (a, z, size) in found]
            if any(x[0] == y[0] for x, y in zip(found, found[1:])):  # of a rank by text, nulls first
                by = sorted(range(len(row)), key=lambda j: (found[j][0], row[j] is not None, row[j] or b""))
                row = [row[j] for j in by]
            if row:
                ids.append(b.column(0)[i].as_py())
                flat += row
                ends.append(len(flat))
                held += sum(len(t or b"") for t in row)
            if held > 4 << 20:
                yield batch()
                ids, flat, ends, held = [], [], [0], 0
    if ids:
        yield batch()


def attach_negative_texts(neg: DataFrame, corpus_text: DataFrame, c_id: str = "cid",
                          text: str = "text") -> DataFrame:
    """``(qid, negative array<string>)`` in rank order, stripped; texts joined
    by id after the top-k.

    A text goes once, compressed, to each block of queries that asks for it, not
    once to each query; a block's task keeps them in a file of its own and reads
    the lists off it."""
    spark = neg.sparkSession
    lists = neg.where("cid is not null").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), F.col("cid").cast("bigint").alias("cid")))).alias("_n"))
    path = scratch_path(spark, "lists")
    lists.select("qid", F.col("_n.rank").alias("ranks"), F.col("_n.cid").alias("cids")).write.parquet(path)
    lists = spark.read.parquet(path)
    n_rows, entries = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("cids")), F.lit(0))).first()
    n = max(1, -(-entries // LISTED), min(n_rows, spark.sparkContext.defaultParallelism))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int"))
    wanted = spark.sparkContext.broadcast(_asked_bits(lists))
    t = corpus_text.select(F.col(c_id).cast("bigint").alias("cid"), strip(text).alias("_t")).where("cid is not null")
    t = t.mapInArrow(_packed(wanted), "cid long, size long, packed binary")
    sent = lists.select("block", F.explode("cids").alias("cid")).distinct().join(t, "cid")
    none = lambda kind: F.lit(None).cast(kind)
    ask = lists.select("block", "qid", "ranks", "cids", none("bigint").alias("cid"), none("bigint").alias("size"), none("binary").alias("packed"))
    sent = sent.select("block", none("bigint").alias("qid"), none("array<bigint>").alias("ranks"), none("array<bigint>").alias("cids"), "cid", "size", "packed")
    return ask.unionByName(sent).repartitionById(n, "block").mapInArrow(_lists_of_texts, "qid long, negative array<string>")
