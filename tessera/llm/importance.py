"""Quality selection by importance resampling.

Two generative models over hashed 1-grams and 2-grams of words and runs of
marks, one of the target (documents labelled good) and one of the raw text (all
documents), give each document a log weight: the sum over its n-grams of the
log ratio of the two.  The n-grams of a long text are far from independent, so
a text of more than ``span`` of them counts as that many of its mean.  Adding Gumbel noise and taking the ``keep`` largest sums draws that many
documents without replacement in proportion to their weights.

The raw counts cover every document.  The target is at most about
``max_target`` labelled documents, chosen by a hash of their ids.  The cut of
the top-k is found by radix selection: four counts over 16 bits of the sort
key each, so no sort and no limit passes through one task.

Defined cases: a null or empty text has no n-grams and weight 0; null ids and
labels are no target; an id counts as good if its smallest label is; without a
target all weights are 0, and the draw is uniform; equal sums go by id; rows
that repeat id and text get equal sums, and any of them fill the last places;
an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import text_slices, utf8
from tessera.llm.wordhash import MARKS, U, hash_words, ngrams
from tessera.session import scratch_path

BUCKET_BITS = 14


@dataclass(frozen=True)
class Settings:
    keep: float = 0.85
    span: int = 100
    smoothing: float = 1.0
    max_target: int = 200_000
    seed: int = 17


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbours."""
    w = hash_words(texts, kinds=MARKS)
    h = w.hashes[0]
    pair = np.flatnonzero(w.doc[:-1] == w.doc[1:])
    doc = np.concatenate([w.doc, w.doc[pair]])
    return doc, (np.concatenate([h, ngrams(h, 2)[pair] if len(h) > 1 else h[:0]]) >> U(64 - BUCKET_BITS)).astype(np.int64)


def _counts(batches):
    total = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    for b in text_slices(batches):
        target = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=bool)
        doc, bucket = _grams(utf8(b.column(0)))
        total[0] += np.bincount(bucket, minlength=total.shape[1])
        total[1] += np.bincount(bucket[target[doc]], minlength=total.shape[1])
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "raw", "target"])


def _target_ids(labels: DataFrame, id_col: str, label_col: str, s: Settings) -> DataFrame:
    good = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
            .groupBy("id").agg(F.min("y").alias("y")).where("y > 0").select("id"))
    n = good.count()
    if n > s.max_target:
        part = 1 << 20
        good = good.where(F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(part)) < int(0.98 * part * s.max_target / n))
    return good


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "quality", settings: Settings = Settings()) -> np.ndarray:
    """Log ratio of the two models for every bucket."""
    good = _target_ids(labels, id_col, label_col, settings).withColumn("target", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(good), "id", "left")
    rows = rows.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = np.zeros((2, 1 << BUCKET_BITS))
    found = rows.mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    for r in found.collect():  # one row per bucket
        counts[:, r["bucket"]] = r["raw"], r["target"]
    if not counts[1].any():
        return np.zeros(1 << BUCKET_BITS)
    p = (counts + settings.smoothing) / (counts.sum(axis=1, keepdims=True) + settings.smoothing * counts.shape[1])
    return np.log(p[1]) - np.log(p[0])


def _sortable(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """``(id, n_grams, log_weight, gumbel_key, rank_key)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    noise = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(s.seed))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), noise.alias("noise"))

    def run(batches):
        for b in text_slices(batches):
            texts = utf8(b.column(1))
            doc, bucket = _grams(texts)
            n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
            weight = np.bincount(doc, weights=shared.value[bucket], minlength=len(texts)) * np.minimum(1, s.span / np.maximum(n, 1))
            u = ((b.column(2).to_numpy().view(np.uint64) >> U(12)).astype(np.float64) + 0.5) / 2.0 ** 52
            key = weight - np.log(-np.log(u))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, (n, weight, key, _sortable(key)))],
                ["id", "n_grams", "log_weight", "gumbel_key", "rank_key"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_grams long, log_weight double, gumbel_key double, rank_key long")


def kth_largest(rows: DataFrame, col: str, k: int) -> tuple[int, int]:
    """The k-th largest long of a column and how many rows are larger."""
    larger, prefix = 0, 0
    for shift in (48, 32, 16, 0):
        here = rows if shift == 48 else rows.where(F.shiftright(F.col(col), shift + 16) == prefix)
        digit = F.shiftright(F.col(col), shift)
        digits = here.groupBy((digit if shift == 48 else digit.bitwiseAND(F.lit(0xFFFF))).alias("digit")).count().collect()
        for d, n in sorted(((r["digit"], r["count"]) for r in digits), reverse=True):  # 65,536 at most
            if larger + n >= k:
                prefix = d if shift == 48 else prefix << 16 | d
                break
            larger += n
    return prefix, larger


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", settings: Settings = Settings()) -> DataFrame:
    """``(id_col, n_grams, log_weight, gumbel_key, kept)`` of every row; of n
    rows ``ceil(keep * n)`` are kept."""
    ratios = log_ratios(docs, labels, id_col, text_col, label_col, settings)
    spark = docs.sparkSession
    path = scratch_path(spark, "weights")
    weigh(docs, ratios, id_col, text_col, settings).write.parquet(path)
    rows = spark.read.parquet(path)
    n = rows.count()
    k = -int(-n * settings.keep // 1)
    cut, larger = kth_largest(rows, "rank_key", k) if k else ((1 << 63) - 1, 0)
    on = rows.where(F.col("rank_key") == cut).withColumn(
        "kept", F.row_number().over(Window.partitionBy("rank_key").orderBy("id")) <= k - larger)
    off = rows.where(F.col("rank_key") != cut).withColumn("kept", F.col("rank_key") > cut)
    return off.unionByName(on).select(F.col("id").alias(id_col), "n_grams", "log_weight", "gumbel_key", "kept")
