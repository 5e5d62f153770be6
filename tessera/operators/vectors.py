"""Embedding-side operators: encoder input formatting, encoding through a
pluggable encoder (Arrow batches), token pooling, normalisation, pair
cosine (V1-V7)."""

from __future__ import annotations

import functools
import hashlib
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as vx
from tessera.operators.dedup import spread


# ---------------------------------------------------------------- V2
def format_encoder_input(text, instruction: str = "", title=None):
    """``"{instruction} {text}"``; with a title column the text is
    ``title + " " + text`` when the title is non-empty."""
    t = F.col(text) if isinstance(text, str) else text
    if title is not None:
        tt = F.col(title) if isinstance(title, str) else title
        t = F.when(F.coalesce(tt, F.lit("")) != "", F.concat_ws(" ", tt, t)).otherwise(t)
    if instruction:
        t = F.concat(F.lit(instruction + " "), t)
    return t


# ---------------------------------------------------------------- V1
class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic test encoder of the protocol: word pieces hashed into
    ``dim`` buckets (md5), counts L2-normalised unless asked otherwise.  A real
    encoder implements the same ``encode``; :func:`hashing_embedding` is the
    same as column expressions."""

    def __init__(self, dim: int = 64, normalize: bool = True):
        self.dim = dim
        self.normalize = normalize

    def encode(self, texts):
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.split(r"\W+", (t or "").lower()):
                if w:
                    out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1.0
        if not self.normalize:
            return out
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1.0, n)


def hashing_embedding(df: DataFrame, key: str, text_col: str, dim: int = 64, out: str = "embedding",
                      normalize: bool = True) -> DataFrame:
    """``(key, out array<double>)``: word pieces hashed into ``dim`` buckets
    (md5), counts L2-normalised unless asked otherwise.  Words are counted per key and bucket, mostly
    before the shuffle; rows of one key count together."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    x = spread(df.select(key, text_col)).select(key, F.explode_outer(words).alias("_w"))
    bucket = (F.conv(F.substring(F.md5(F.col("_w").cast("binary")), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    n = x.groupBy(key, bucket.alias("_b")).agg(F.count("_w").cast("double").alias("_n"))
    counts = n.groupBy(key).agg(F.map_from_entries(F.collect_list(
        F.when(F.col("_b").isNotNull(), F.struct("_b", "_n")))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    # a one-row generator keeps the vector from being built per use
    return counts.select(key, F.explode(F.array(dense)).alias("_v")).select(
        key, (vx.l2_normalize("_v") if normalize else F.col("_v")).alias(out))


@functools.lru_cache(maxsize=4)
def _encoder(factory) -> Encoder:
    """The encoder of a factory, kept for the life of the worker process: an
    importable factory is the same object in all its tasks."""
    return factory()


def encode_texts(df: DataFrame, text_col: str, encoder_factory=HashingEncoder, out: str = "embedding",
                 batch_rows: int = 512) -> DataFrame:
    """Append ``out: array<float>`` computed batch-wise over Arrow.

    The encoder is built once per worker process.  The rows of an Arrow batch
    go through it sorted by length, ``batch_rows`` at a time, so that a batch
    pads little, and come out in their order; all columns stay as they are.  A
    null text is an empty one."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])
    at = df.columns.index(text_col)

    def run(batches):
        enc = _encoder(encoder_factory)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            if not texts:
                continue
            order = np.argsort([len(t) for t in texts], kind="stable")
            vecs = np.empty((len(texts), enc.dim), dtype=np.float32)
            for s in range(0, len(texts), batch_rows):
                own = order[s:s + batch_rows]
                vecs[own] = enc.encode([texts[i] for i in own])
            flat = pa.array(vecs.ravel())
            offsets = pa.array(np.arange(0, vecs.size + 1, enc.dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat)], [*b.schema.names, out])
    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- V3-V5
def _exploded(tokens: DataFrame, doc: str, pos: str, mask: str, vec: str) -> DataFrame:
    return tokens.select(doc, pos, mask, F.posexplode(vx.as_double(vec)).alias("dim", "x"))


def _collect_vector(df: DataFrame, doc: str, val: str) -> DataFrame:
    return df.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("dim", val))).alias("_v")).select(
        doc, F.col(f"_v.{val}").alias("embedding"))


def pool_mean(tokens: DataFrame, doc="doc", pos="pos", mask="mask", vec="embedding") -> DataFrame:
    """Masked mean per document; a (doc, dim) grouped average (partial agg)."""
    e = _exploded(tokens, doc, pos, mask, vec).where(F.col(mask) == 1)
    return _collect_vector(e.groupBy(doc, "dim").agg(F.avg("x").alias("v")), doc, "v")


def pool_weighted_mean(tokens: DataFrame, doc="doc", pos="pos", mask="mask", vec="embedding") -> DataFrame:
    """Weights = mask * running count of unmasked tokens (1, 2, 3 ...)."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("_w", F.col(mask) * F.sum(mask).over(w))
    e = t.select(doc, "_w", F.posexplode(vx.as_double(vec)).alias("dim", "x"))
    g = e.groupBy(doc, "dim").agg((F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("v"))
    return _collect_vector(g, doc, "v")


def pool_last_token(tokens: DataFrame, doc="doc", pos="pos", mask="mask", vec="embedding") -> DataFrame:
    """Vector at the last position whose mask is 1."""
    return tokens.where(F.col(mask) == 1).groupBy(doc).agg(
        F.max_by(vx.as_double(vec), F.col(pos)).alias("embedding"))


def pool_first_token(tokens: DataFrame, doc="doc", pos="pos", mask="mask", vec="embedding") -> DataFrame:
    """Vector at position 0 (the first token), regardless of the mask."""
    return tokens.groupBy(doc).agg(F.min_by(vx.as_double(vec), F.col(pos)).alias("embedding"))


# ---------------------------------------------------------------- V6, V7
def l2_normalize(df: DataFrame, vec: str = "embedding", out: str | None = None) -> DataFrame:
    return df.withColumn(out or vec, vx.l2_normalize(vec))


def cosine_pairs(df: DataFrame, a: str, b: str, out: str = "cosine") -> DataFrame:
    """Cosine of two vector columns of the same row (pairs given)."""
    return df.withColumn(out, vx.cosine(a, b))

