import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from .conftest import SF

SF_MID = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    x = toxicity.judge(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = x.predicted == x.toxic
    assert hit.mean() > 0.95
    assert x[x.toxic == 1].predicted.mean() > 0.8 and x[x.toxic == 0].predicted.mean() < 0.02


def test_machine_equals_formula():
    rnd = np.random.default_rng(1)
    number = np.full(1 << toxicity.BUCKET_BITS, -1)
    texts = [b"alpha beta gamma", b"beta", b"", b"alpha alpha delta!"]
    for i, (_, b) in enumerate(sorted({(0, int(b)) for b in toxicity._doc_buckets(texts)[1]})):
        number[b] = i
    n = number.max() + 1
    m = toxicity.Machine(number, 0.3, rnd.normal(size=n), rnd.normal(size=(n, 3)))
    doc, bucket = toxicity._doc_buckets(texts)
    for d, s in enumerate(m.score(texts)):
        f = [number[b] for b in bucket[doc == d]]
        z = 0.3 + sum(m.linear[i] for i in f) + sum(m.factors[i] @ m.factors[j] for k, i in enumerate(f) for j in f[k + 1:])
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_learns_a_pair_that_no_weight_shows(spark, docs_of):
    """Toxic if both or neither... of two words: no additive weights can tell."""
    rows, y = [], []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        rows.append((i, f"filler {'insult' if a else 'praise'} {'group' if b else 'object'} w{i % 7}"))
        y.append((i, int(a != b)))
    labels = spark.createDataFrame(y, "doc_id long, toxic int")
    s = toxicity.Settings(least_g=-1.0, rounds=400, step=0.1, decay=0.0)
    out = toxicity.judge(docs_of(rows), labels, s).join(labels, "doc_id")
    assert out.where("predicted = toxic").count() > 0.9 * 400


def test_cases(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "word"), (3, "x " * 100000), (3, "x " * 100000), (4, "y")], extra=["score", "id", "label"])
    for labels in ([], [(1, 0), (3, None), (None, 1)], [(1, 0), (2, 1), (3, 1), (3, 0), (4, 0), (99, 1)]):
        got = toxicity.judge(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.judge(docs_of([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.judge(docs, y).collect()} for y in (labels, other))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
