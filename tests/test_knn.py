"""Exact k-NN with metric pruning against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn as K


def frames(spark, corpus, queries):
    c = spark.createDataFrame([(int(i), v if v is None else [float(x) for x in v]) for i, v in corpus], "cid long, cvec array<double>")
    q = spark.createDataFrame([(int(i), v if v is None else [float(x) for x in v]) for i, v in queries], "qid long, qvec array<double>")
    return q, c


def brute(corpus, queries, k, metric):
    ids = np.array([i for i, v in corpus if v is not None])
    X = np.array([v for _, v in corpus if v is not None], dtype=float)
    if metric == "cosine":
        X = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)
    out = {}
    for i, v in queries:
        if v is not None:
            v = np.asarray(v, dtype=float)
            v = v / max(np.linalg.norm(v), 1e-300) if metric == "cosine" else v
            o = ((X - v) ** 2).sum(axis=1) if metric == "l2" else -np.array([x @ v for x in X])
            out[i] = (ids, o)
    return out


def check(spark, corpus, queries, k, metric, **kw):
    got = {}
    for r in K.knn_topk(*frames(spark, corpus, queries), k, metric, **kw).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.rank, r.cid, r.score))
    want = brute(corpus, queries, k, metric)
    assert set(got) == set(want)
    for i, (ids, o) in want.items():
        best = np.lexsort((ids, o))[:k]
        assert [r for r, _, _ in got[i]] == list(range(1, len(best) + 1))
        scores = np.array([s for _, _, s in got[i]])
        assert np.allclose(scores if metric == "l2" else -scores, o[best], rtol=1e-9, atol=1e-12)
        place = {c: j for j, c in enumerate(ids)}
        # same rows, but for those whose scores the summation order cannot tell apart
        assert np.allclose(o[[place[c] for _, c, _ in got[i]]], o[best], rtol=1e-12, atol=1e-12)


def clustered(n, d, centres, seed, spread=0.05, offset=0.0):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, d)) * 3
    return (at[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * spread + offset).tolist()


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_pruned_equals_brute_force_and_skips(spark, metric):
    """Clustered vectors, an offset of 10,000 and several groups; every vector is a query."""
    for offset in (0.0, 10_000.0):
        rows = list(enumerate(clustered(3000, 8, 40, 1, offset=offset)))
        sc = spark.sparkContext
        counts = sc.accumulator(0), sc.accumulator(0)
        check(spark, rows, rows[::7], 6, metric, buckets=9, query_blocks=4, counts=counts)
        if metric == "l2":  # of 256 cells, most lie in groups that a query is not sent to
            assert 0 < counts[0].value < 429 * 256 / 4
    whole = sc.accumulator(0), sc.accumulator(0)
    rows = list(enumerate(clustered(6000, 8, 300, 1)))  # one group, stored first
    K.knn_topk(*frames(spark, rows, rows[:300]), 6, metric, counts=whole).count()
    assert whole[1].value > 0 or metric == "ip"


def test_groups_beyond_the_bound_are_not_sent(spark):
    x = np.array(clustered(2000, 6, 20, 3))
    pivots = x[::100]
    d = K._distances(x, pivots, pivots.mean(axis=0))
    cell = d.argmin(axis=1)
    low, high = (np.array([f(d[cell == i, i]) for i in range(len(pivots))]) for f in (np.min, np.max))
    own = K.Cells("l2", pivots, pivots.mean(axis=0), low, high, np.bincount(cell, minlength=len(pivots)))
    own.pack(150)
    assert own.n_groups > 5
    q = x[:200]
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    most = np.sort(true, axis=1)[:, 4]
    sent = own.open_groups(q, np.full(200, -1), most)
    assert sum(map(len, sent)) < 200 * own.n_groups / 2
    groups = [set(range(f, f + n)) for f, n in zip(own.first, own.parts)]
    for i in range(200):  # no row within the bound lies outside
        assert all(groups[c] <= set(sent[i]) for c in set(cell[true[i] <= most[i]]))


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_bounds_hold(metric):
    rng = np.random.default_rng(5)
    for scale, offset in ((1.0, 0.0), (1e-6, 50.0), (1.0, 10_000.0)):
        x, q = (rng.normal(size=(n, 12)) * scale + offset for n in (400, 60))
        if metric == "cosine":
            x, q = K._unit(x), K._unit(q)
        pivots = x[:10]
        mid = pivots.mean(axis=0)
        d = K._distances(x, pivots, mid)
        cell = d.argmin(axis=1)
        low, high = (np.array([f(d[cell == i, i]) for i in range(10)]) for f in (np.min, np.max))
        b = K.lower_bounds(metric, q, pivots, mid, low, high)
        o = ((q[:, None] - x[None]) ** 2).sum(axis=2) if metric == "l2" else -(q @ x.T)
        assert (b[:, cell] <= o + 1e-12 * np.abs(o)).all()


def test_heavy_ties_and_a_vector_that_fills_a_third(spark):
    rng = np.random.default_rng(6)
    hot = [1.0, 2.0, 0.0]
    rows = [(i, hot if i % 3 == 0 else rng.integers(0, 3, 3).tolist()) for i in range(900)]
    for metric in ("l2", "ip"):
        check(spark, rows, rows[:60] + [(5000, hot)], 20, metric, buckets=6, query_blocks=3)
    got = K.knn_topk(*frames(spark, rows, [(1, hot)]), 5, buckets=6).orderBy("rank").collect()
    assert [r.cid for r in got] == sorted(i for i, v in rows if [float(x) for x in v] == hot)[:5]  # ties go by id


def test_cases(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    check(spark, rows, [(1, [0.2, 0.1]), (2, None), (3, [0.0, 0.0])], 10, "l2")
    check(spark, rows, [(1, [0.2, 0.1]), (3, [0.0, 0.0])], 2, "cosine")
    assert K.knn_topk(*frames(spark, [], [(1, [1.0])]), 3).count() == 0
    assert K.knn_topk(*frames(spark, rows, []), 3).count() == 0
    assert K.knn_topk(*frames(spark, [(1, None)], [(1, [1.0])]), 3).count() == 0


def test_results_leave_a_worker_in_bounded_batches(monkeypatch):
    """One batch of 2,000 queries of 100 neighbours each; few queries at a time, the same rows."""
    from types import SimpleNamespace

    monkeypatch.setattr(K, "RESULTS", 20_000)
    monkeypatch.setattr(K, "CHUNK", 1 << 12)
    x = np.array(clustered(3000, 6, 30, 8))
    pivots = x[:50]
    mid = pivots.mean(axis=0)
    d = K._distances(x, pivots, mid)
    cell = d.argmin(axis=1)
    group = K.Group(x, np.arange(3000), cell, d[np.arange(3000), cell])
    q = x[:2000]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(list(q))], ["qid", "qvec"])
    out = list(K._whole_topk(SimpleNamespace(value=(K.Cells("l2", pivots, mid), group)), 100)([batch]))
    assert max(b.num_rows for b in out) <= 20_000
    got = {}
    for b in out:
        for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got.setdefault(i, []).append(c)
    for i in range(0, 2000, 37):
        true = ((x - q[i]) ** 2).sum(axis=1)
        assert got[i] == np.lexsort((np.arange(3000), true))[:100].tolist()
    assert sorted(got) == list(range(2000))


def test_few_true_cells_are_found():
    rng = np.random.default_rng(9)
    for share in (0.0, 0.01, 0.5, 1.0):
        mask = rng.random((7, 40)) < share
        assert [a.tolist() for a in K._true(mask)] == [a.tolist() for a in np.nonzero(mask)]


@pytest.mark.parametrize("buckets", [None, 5])
def test_enough_of_other_labels_end_a_list(spark, buckets):
    """Few rows leave the search; the negatives are those of the whole lists."""
    rng = np.random.default_rng(12)
    x = np.array(clustered(2500, 6, 25, 4, spread=1.0))
    labels = [None if i % 50 == 0 else int(v) for i, v in enumerate(rng.integers(0, 3, len(x)))]
    rows = [(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, labels))]
    corpus = spark.createDataFrame([(i, v, c) for i, v, c in rows], "cid long, cvec array<double>, cluster long")
    asked = rows[:150] + rows[30:40]  # ten ids twice
    queries = spark.createDataFrame(asked, "qid long, qvec array<double>, cluster long")
    labelled = queries.where("cluster is not null")
    sent = K.knn_topk(labelled, corpus, 800, buckets=buckets, query_blocks=buckets and 3, enough=("cluster", "cluster", 20))
    per = {r.qid: r.n for r in sent.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(n for i, n in per.items() if not 30 <= i < 40) < 400 and min(per.values()) >= 20
    got = {}
    for k in (800, 25):  # of 25, fewer than 20 are of another label
        for r in K.hard_negatives(queries, corpus, k, 5, 15, exclusion="same_cluster", q_cluster="cluster", c_cluster="cluster",
                                  buckets=buckets, query_blocks=buckets and 3).orderBy("qid", "rank").collect():
            got.setdefault((k, r.qid), []).append((r.rank, r.cid))
        for i in range(150):
            if 30 <= i < 40:
                continue
            best = np.lexsort((np.arange(len(x)), ((x - x[i]) ** 2).sum(axis=1)))[:k]
            left = [int(j) for j in best if None not in (labels[i], labels[j]) and labels[i] != labels[j]][5:20]
            assert got.get((k, i), []) == [(6 + n, j) for n, j in enumerate(left)]


def test_rows_of_the_corpus_travel_once_per_block_of_queries(spark):
    """Blocks are cut by the bytes of the queries, not by those of their results."""
    rows = list(enumerate(clustered(2400, 4, 10, 2)))
    q, c = frames(spark, rows, rows[:1200])
    seen = []
    kind, plain = type(q), type(q).mapInArrow

    def noted(self, func, schema, *a, **b):
        if func.__qualname__.startswith("_block_topk"):
            seen.append(self)
        return plain(self, func, schema, *a, **b)

    kind.mapInArrow = noted
    try:
        top = K.knn_topk(q, c, 1000, buckets=4, block_bytes=1200 * 32)
    finally:
        kind.mapInArrow = plain
    assert top.count() == 1200 * 1000
    assert len(seen) == 2
    for sent in seen:
        assert sent.where("grp >= 0").count() <= len(rows) * 2 * spark.sparkContext.defaultParallelism
    few = frames(spark, rows, rows[:50])[0]  # one block: its groups go to several tasks, each once
    seen.clear()
    kind.mapInArrow = noted
    try:
        top = K.knn_topk(few, c, 5, buckets=4)
    finally:
        kind.mapInArrow = plain
    assert top.count() == 50 * 5
    assert seen[1].where("grp >= 0").count() <= len(rows) and seen[1].select("task").distinct().count() >= 4


def test_negative_texts_go_once_to_a_block(spark, monkeypatch):
    """As joined and sorted: null, empty, padded and missing texts, an id with two, ids without a list."""
    monkeypatch.setattr(K, "LISTED", 50)
    texts = [(i, None if i % 7 == 0 else f" \n text é {i} " * (i % 5)) for i in range(60)] + [(3, " other\t"), (3, None), (None, "x")]
    neg = [(q, r, (q * 7 + r * 3) % 64) for q in range(40) for r in range(31, 31 + q % 9)] + [(100, 31, 900), (None, 31, 5), (5, 99, None)]
    n = spark.createDataFrame(neg, "qid long, rank int, cid long")
    t = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.qid: r.negative for r in K.attach_negative_texts(n, t, "doc_id", "text").collect()}
    want = {}
    for q, r, c in neg:
        want.setdefault(q, []).extend((r, t is not None, t and t.strip() or "", t) for i, t in texts if i is not None and i == c)
    assert got == {q: [None if t is None else t.strip() for _, _, _, t in sorted(x, key=lambda y: y[:3])] for q, x in want.items() if x}
