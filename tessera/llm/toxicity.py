"""Toxicity score: a factorization machine over hashed terms.

Terms are lower-cased words and word beginnings, hashed into ``2^BUCKET_BITS``
buckets.  Over the labelled documents the buckets are counted by label, and the
``n_terms`` that tell most about it (G-test) become the features; the machine
learns a weight for each and, through ``factors`` latent numbers per feature,
one for every pair of them that meet in a document.  ``pyspark.ml`` fits it on
the cluster; every whole text is then scored by the fitted numbers.

It is fitted on at most about ``max_rows`` labelled documents, chosen by a
hash of their ids; there are no other bounds.

Defined cases: a null or empty text has no terms and gets the score of the
intercept; labelled ids without a document, null ids and null labels teach
nothing; an id labelled twice counts as toxic if one label says so; without
labels of both kinds every score is the share of toxic labels (0 if there are
none); repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import text_slices, utf8
from tessera.llm.wordhash import LETTERS, U, hash_words
from tessera.session import scratch_path

BUCKET_BITS = 18
PREFIX = 4


@dataclass(frozen=True)
class Settings:
    n_terms: int = 2048
    least_g: float = 10.0
    factors: int = 4
    rounds: int = 80
    step: float = 0.05
    decay: float = 0.001
    max_rows: int = 200_000
    folds: int = 5
    held_out_fold: int = 0
    seed: int = 17


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _doc_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every distinct bucket of every text."""
    w = hash_words(texts, lower=True, kinds=LETTERS, prefix=PREFIX)
    begun = np.flatnonzero(w.hashes[1])
    doc = np.concatenate([w.doc, w.doc[begun]])
    h = np.concatenate([w.hashes[0], w.hashes[1][begun]]) >> U(64 - BUCKET_BITS)
    both = np.unique(doc.astype(np.int64) << BUCKET_BITS | h.astype(np.int64))
    return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


def _counts(batches):
    """Documents by bucket and label in a task."""
    total = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    for b in text_slices(batches):
        label = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
        doc, bucket = _doc_buckets(utf8(b.column(0)))
        for y in (0, 1):
            total[y] += np.bincount(bucket[label[doc] == y], minlength=total.shape[1])
    at = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "n0", "n1"])


def _feature_rows(features):
    def run(batches):
        number = features.value
        for b in text_slices(batches):
            doc, bucket = _doc_buckets(utf8(b.column(0)))
            f = number[bucket]
            doc, f = doc[f >= 0], f[f >= 0]
            ends = np.cumsum(np.bincount(doc, minlength=b.num_rows))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, pa.array(f.astype(str).tolist(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(1), terms], ["label", "terms"])

    return run


@dataclass
class Machine:
    """The fitted numbers; bounded by the parameters."""

    number: np.ndarray  # bucket -> feature or -1
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, bucket = _doc_buckets(texts)
        f = self.number[bucket]
        doc, f = doc[f >= 0], f[f >= 0]
        n = len(texts)
        z = self.intercept + np.bincount(doc, weights=self.linear[f], minlength=n)
        for v in self.factors.T:
            z += 0.5 * (np.bincount(doc, weights=v[f], minlength=n) ** 2 - np.bincount(doc, weights=v[f] ** 2, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _constant(share: float) -> Machine:
    odds = np.log(share / (1 - share)) if 0 < share < 1 else (500.0 if share else -500.0)
    return Machine(np.full(1 << BUCKET_BITS, -1), float(odds), np.zeros(1), np.zeros((1, 1)))


def _training_labels(labels: DataFrame, id_col: str, label_col: str, s: Settings) -> DataFrame:
    y = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
         .groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("label")))
    y = y.where(fold("id", s.folds) != s.held_out_fold)
    n = y.count()
    if n > s.max_rows:
        part = 1 << 20
        y = y.where(F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(part)) < int(0.98 * part * s.max_rows / n))
    return y


def _g_test(n0: Column, n1: Column, all0: int, all1: int) -> Column:
    """Twice the log-likelihood ratio of term and label."""
    n = all0 + all1

    def part(x: Column, row: Column, col: int) -> Column:
        return F.when(x > 0, x * F.log(x * n / (row * col))).otherwise(0.0)

    has, lacks = n0 + n1, F.lit(n) - n0 - n1
    return 2 * (part(n0, has, all0) + part(n1, has, all1) + part(all0 - n0, lacks, all0) + part(all1 - n1, lacks, all1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", settings: Settings = Settings()) -> Machine:
    s, spark = settings, docs.sparkSession
    y = _training_labels(labels, id_col, label_col, s)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = known.join(F.broadcast(y), "id").select("text", "label")  # at most max_rows labels
    n = {r["label"]: r["n"] for r in known.select("id").join(F.broadcast(y), "id").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return _constant(n1 / max(n0 + n1, 1))
    counts = rows.mapInArrow(_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    g = _g_test(F.col("n0").cast("double"), F.col("n1").cast("double"), n0, n1)
    top = counts.withColumn("g", g).where(F.col("g") >= s.least_g).orderBy(F.desc("g"), "bucket").limit(s.n_terms)
    buckets = [r["bucket"] for r in top.select("bucket").collect()]
    if not buckets:
        return _constant(n1 / (n0 + n1))
    number = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    number[buckets] = np.arange(len(buckets))
    path = scratch_path(spark, "toxicity")
    rows.mapInArrow(_feature_rows(spark.sparkContext.broadcast(number)), "label int, terms array<string>").write.parquet(path)
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(buckets))], "terms", "features")
    vectors.setBinary(True)
    data = vectors.transform(spark.read.parquet(path)).select("features", F.col("label").cast("double").alias("label"))
    model = FMClassifier(factorSize=s.factors, maxIter=s.rounds, stepSize=s.step, regParam=s.decay, seed=s.seed).fit(data)
    return Machine(number, float(model.intercept), model.linear.toArray(), model.factors.toArray())


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(utf8(b.column(1))))], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    out = score(docs, fit(docs, labels, settings=settings))
    held = fold("doc_id", settings.folds) == settings.held_out_fold
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
