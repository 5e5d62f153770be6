import numpy as np
import pytest

from tessera.llm import importance
from .conftest import SF


def test_kth_largest(spark):
    rnd = np.random.default_rng(3)
    for values in ([5], [0, 0, 0, -1], rnd.integers(-2**63, 2**63 - 1, 500).tolist(), rnd.integers(-3, 3, 200).tolist()):
        df = spark.createDataFrame([(int(v),) for v in values], "x long")
        down = sorted(values, reverse=True)
        for k in {1, len(values) // 2 or 1, len(values)}:
            assert importance.kth_largest(df, "x", k) == (down[k - 1], sum(v > down[k - 1] for v in values))


def test_sortable_keeps_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1.0, -0.0, 0.0, 1e-300, 3.0, np.inf])
    assert (np.diff(importance._sortable(x)) >= 0).all()


def test_weights_and_draw(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    s = importance.Settings(keep=0.5)
    got = importance.resample(docs, labels, settings=s).toPandas()
    assert len(got) == docs.count() and got.kept.sum() == -(-len(got) // 2)
    assert got[got.kept].gumbel_key.min() >= got[~got.kept].gumbel_key.max()
    # the models, counted plainly
    d, y = docs.toPandas(), labels.toPandas()
    good = set(y[y.quality == 1].doc_id)
    c = np.zeros((2, 1 << importance.BUCKET_BITS))
    for i, t in zip(d.doc_id, d.text):
        _, b = importance._grams([(t or "").encode()])
        np.add.at(c[0], b, 1)
        if i in good:
            np.add.at(c[1], b, 1)
    p = (c + 1) / (c.sum(axis=1, keepdims=True) + c.shape[1])
    ratio = np.log(p[1] / p[0])
    want = {}
    for i, t in zip(d.doc_id, d.text):
        _, b = importance._grams([(t or "").encode()])
        want[i] = ratio[b].sum() * min(1, s.span / max(len(b), 1))
    assert all(w == pytest.approx(want[i]) for i, w in zip(got.doc_id, got.log_weight))


def test_clean_documents_outweigh_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = importance.resample(docs, labels).join(labels, "doc_id").toPandas()
    assert x[x.quality == 1].kept.mean() > 0.95 and x[x.quality == 0].kept.mean() < 0.1


def test_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "word"), (3, "x " * 100000), (3, "x " * 100000), (4, "###")]
    for labels in ([], [(1, None), (None, 1)], [(3, 1), (4, 0), (4, 1)]):
        df = importance.resample(docs_of(rows, extra=["id", "noise", "n", "kept"]), spark.createDataFrame(labels, "doc_id long, quality int"))
        got = df.collect()
        assert len(got) == 6 and sum(r.kept for r in got) == 6  # ceil(0.85 * 6)
    assert importance.resample(docs_of([]), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
