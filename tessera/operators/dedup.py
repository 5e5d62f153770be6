"""Near-duplicate removal: word pieces -> n-gram shingles -> MinHash signature
-> LSH bands -> star edges -> connected components -> keep the root.

Scale notes
- Exact copies are collapsed first (grouped by an md5 of the column, a
  partial aggregation): only one signature per distinct text is computed and
  a hot duplicate group never sits in one task.
- Grams are hashed and signed per row over Arrow batches (numpy, no per-row
  Python loop over permutations), which leave the worker a few MB at a time; a
  JVM higher-order-function path exists for small ``num_perm``.
- Buckets are found by a grouped ``min``/``count`` (partial aggregation), not
  by materialising all pairs in a bucket; each member gets one edge to the
  bucket minimum (a star), so a bucket of a million rows gives a million
  edges, not 10^12.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.operators.components import connected_components
from tessera.session import scratch_path

PRIME = 2147483647  # 2^31 - 1: a*h + b < 2^59 fits a signed 64-bit integer

# ---- fixed values: modulus and largest value of a signature per hash width;
# 28 is this library's own width, which SQL computes in 64-bit integers too
HASH_WIDTHS = {
    16: ((1 << 16) - 15, (1 << 16) - 1),
    28: (PRIME, PRIME),
    32: ((1 << 32) - 5, (1 << 32) - 1),
    64: ((1 << 61) - 1, (1 << 32) - 1),
}
HASH_FUNCS = ("md5", "sha1", "xxh3")


# ---------------------------------------------------------------- parameters
def _integrate(f, lo: float, hi: float, n: int = 2001) -> float:
    if hi <= lo:
        return 0.0
    x = np.linspace(lo, hi, n)
    y = f(x)
    return float(np.sum((y[1:] + y[:-1]) * 0.5 * np.diff(x)))


@functools.lru_cache(maxsize=64)
def lsh_params(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5):
    """Bands ``B`` and rows ``R`` (B*R <= num_perm) minimising the weighted
    area of false positives (below the threshold) and false negatives (above)."""
    best, opt = float("inf"), (1, 1)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = _integrate(lambda s: 1 - (1 - s ** r) ** b, 0.0, threshold)
            fn = _integrate(lambda s: (1 - s ** r) ** b, threshold, 1.0)
            err = fp * fp_weight + fn * fn_weight
            if err < best:
                best, opt = err, (b, r)
    return opt


def permutations(num_perm: int, seed: int = 42, bits: int = 28):
    """Universal-hash parameters ``(a_i, b_i)``, a in [1, p), b in [0, p),
    from the first 8 hex digits (16 at 64 bits) of md5 of ``seed:a:i`` /
    ``seed:b:i`` (same values in SQL)."""
    prime, digits = HASH_WIDTHS[bits][0], 16 if bits == 64 else 8

    def h(tag, i):
        return int(hashlib.md5(f"{seed}:{tag}:{i}".encode()).hexdigest()[:digits], 16)
    a = np.array([1 + h("a", i) % (prime - 1) for i in range(num_perm)], dtype=np.uint64)
    b = np.array([h("b", i) % prime for i in range(num_perm)], dtype=np.uint64)
    return a, b


def _affine_mod61(a: np.ndarray, h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a*h + b) mod 2^61 - 1 for a, b < 2^61 and h < 2^32 in unsigned 64-bit
    words: 2^61 counts as 1, so high parts are added back to the low ones."""
    p, low32, low29 = np.uint64((1 << 61) - 1), np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
    w29, w32, w61 = np.uint64(29), np.uint64(32), np.uint64(61)
    high = (a >> w32) * h                                # < 2^61, worth 2^32 each
    x = (high >> w29) + ((high & low29) << w32)          # high * 2^32 mod p, < 2^61 + 2^32
    y = (a & low32) * h                                  # < 2^64
    x = x + (y & p) + (y >> w61) + b                     # < 2^63
    x = (x & p) + (x >> w61)
    return np.where(x >= p, x - p, x)


# ---- primes below a power of two: 2^k counts as c, so high bits are folded
# onto the low ones (as often as named) in place of a division
FOLDS = {16: (16, 15, 2), 28: (31, 1, 1), 32: (32, 5, 2)}


def _affine(a: np.ndarray, h: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """((a*h + b) mod prime) cut to the width of a signature; broadcasts."""
    if bits == 64:
        return _affine_mod61(a, h, b) & np.uint64(HASH_WIDTHS[64][1])
    k, c, times = FOLDS[bits]
    x = a * h
    x += b
    for _ in range(times):
        high = x >> np.uint64(k)
        if c > 1:
            high *= np.uint64(c)
        x &= np.uint64((1 << k) - 1)
        x += high
    return np.minimum(x, x - np.uint64(HASH_WIDTHS[bits][0]))  # below the prime the difference wraps round


@dataclass(frozen=True)
class MinHashConfig:
    ngram: int = 5
    min_length: int = 5
    num_perm: int = 250
    threshold: float = 0.7
    bands: int | None = None
    rows: int | None = None
    seed: int = 42
    hash_func: str = "md5"
    hash_bits: int = 28

    def __post_init__(self):
        if self.hash_func not in HASH_FUNCS or self.hash_bits not in HASH_WIDTHS:
            raise ValueError(f"{self.hash_func}, {self.hash_bits} bits")
        if self.hash_bits == 28 and self.hash_func != "md5":
            raise ValueError("28-bit hashes are of md5")

    def band_rows(self):
        if self.bands and self.rows:
            return self.bands, self.rows
        return lsh_params(self.threshold, self.num_perm)


REFERENCE_CALLER = MinHashConfig(ngram=5, min_length=5, num_perm=1000, threshold=0.8)


# ---------------------------------------------------------------- shingles
@F.pandas_udf(T.ArrayType(T.LongType()))
def _xxh3_low32(shingles: pd.Series) -> pd.Series:
    import xxhash

    low = (1 << 32) - 1
    return pd.Series([None if x is None else [xxhash.xxh3_64_intdigest(s.encode()) & low for s in x] for x in shingles])


def shingle_hashes(pieces, ngram: int = 5, min_length: int = 5, func: str = "md5", bits: int = 28) -> Column:
    """array<bigint>: hash of every distinct word n-gram of a piece-array
    column (project the pieces first: the lambda reads them once per window).
    ``bits`` 16 and 32 give hashes of that size, 64 hashes of 32 bits (its
    modulus is larger), 28 the first 7 hex digits of md5.  md5 and sha1 are
    column expressions; xxh3 (the low bits of its 64) is an Arrow UDF."""
    sh = tx.word_ngrams(pieces, ngram, min_length)
    if bits == 28:
        return F.transform(sh, lambda s: tx.hash28(s))
    if func == "xxh3":
        hs = _xxh3_low32(sh)
        return F.transform(hs, lambda h: h.bitwiseAND(0xFFFF)) if bits == 16 else hs
    return F.transform(sh, lambda s: tx.shingle_hash(s, func, min(bits, 32)))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a DataFrame over all cores when it has fewer partitions
    than the cluster has task slots (one small file = one task).  At scale the
    input already has many splits and this is a no-op."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * slots) if df.rdd.getNumPartitions() < slots else df


# ---------------------------------------------------------------- signatures
CELLS = 1 << 15      # cells (hashes x permutations) at a time: they stay in a core's cache
FEW = 32             # rows of fewer hashes are computed in full
TILE = 1 << 17       # cells (permutations x hashes) at a time
SIDE = 1 << 12       # hashes of several rows side by side
PIECE = 1 << 10      # a longer row is cut
HASHED = 1 << 16     # grams of a text at a time
TEXT_BYTES = 2 << 20 # texts are hashed by so many bytes at a time
OUT_BYTES = 8 << 20  # signatures leave a Python worker in batches of so many bytes


def _signature_block(hashes: list[np.ndarray], a: np.ndarray, b: np.ndarray, bits: int = 28,
                     budget: int = 12_000) -> list:
    """Row-wise min of (a*h + b) mod p over the hashes of each row, by a few
    hashes at a time: ~``budget`` cells, which stay in a core's cache."""
    step = max(1, budget // len(a))
    ar, br = a[None, :], b[None, :]
    out = []
    for h in hashes:
        least = np.full(len(a), HASH_WIDTHS[bits][1], dtype=a.dtype)
        for s in range(0, h.size, step):
            np.minimum(least, _affine(ar, h[s:s + step, None], br, bits).min(axis=0), out=least)
        out.append(least)
    return out


class ScaledSigner:
    """Signatures of hashes of up to 32 bits in 64-bit words: 2^64 / prime times
    as large, (a*h + b) mod prime is A*h + B modulo 2^64, as whole numbers wrap
    round.  A and B are rounded down and B then raised by 2^bits, so a word is
    too large by more than 0 and at most 2^bits < 2^64 / prime: words are in the
    order of the values, and the smallest divided by the scale is the minimum."""

    def __init__(self, num_perm: int, seed: int, bits: int):
        self.prime, self.most = HASH_WIDTHS[bits]
        a, b = permutations(num_perm, seed, bits)
        self.a = np.array([(int(x) << 64) // self.prime for x in a], dtype=np.uint64)
        self.b = np.array([((int(x) << 64) // self.prime) + (1 << bits) for x in b], dtype=np.uint64)

    def sign(self, rows: list[np.ndarray]) -> np.ndarray:
        """One signature per array of hashes."""
        least = np.full((len(rows), len(self.a)), np.iinfo(np.uint64).max, dtype=np.uint64)
        step = max(1, CELLS // len(self.a))
        cells = np.empty((step, len(self.a)), dtype=np.uint64)
        for out, h in zip(least, rows):
            for s in range(0, h.size, step):
                x = cells[:len(h[s:s + step])]
                np.multiply(h[s:s + step, None], self.a, out=x)
                x += self.b
                np.minimum(out, x.min(axis=0), out=out)
        prime, low, w = np.uint64(self.prime), np.uint64(0xFFFFFFFF), np.uint64(32)
        values = ((least >> w) * prime + (((least & low) * prime) >> w)) >> w  # least * prime / 2^64
        values[[h.size == 0 for h in rows]] = self.most
        return values


class Signer:
    """Signatures of 32 bits of values below 2^61 - 1 by way of 32-bit words.  The
    low 32 bits come from one matrix product of whole numbers below 2^53: 2^52
    is added, so the low word of a double is the sum modulo 2^32.  They are too
    large by at most ``error``.  The smallest names the hash of the minimum if no
    other is within ``error`` and none can have wrapped round (all are above
    ``error``); its value is then computed in full.  The other permutations are
    computed in full for all hashes: the result is exact."""

    def __init__(self, num_perm: int, seed: int, bits: int):
        self.a, self.b = permutations(num_perm, seed, bits)
        self.bits, self.shifts, self.error = bits, range(0, 32, 16), 4  # hashes are split into parts of 16 bits
        a, b = [int(x) for x in self.a], [int(x) for x in self.b]
        word = lambda values: np.array([x % (1 << 32) for x in values], dtype=np.float64)
        # 2^61 counts as 1: what a*h has above it, a*h / 2^61, is added to the low bits
        columns = [*(word(x << k for x in a) for k in self.shifts), word(x + 3 for x in b) + 2.0 ** 52, np.array([x / 2 ** 61 for x in a])]
        self.factors = np.stack([*columns, np.ones(num_perm)], axis=1)

    def sign(self, rows: list[np.ndarray]) -> np.ndarray:
        """One signature per array of hashes."""
        out = np.full((len(rows), len(self.a)), HASH_WIDTHS[self.bits][1], dtype=np.uint64)
        short = [i for i, h in enumerate(rows) if h.size < FEW]
        if short:
            out[short] = _signature_block([rows[i] for i in short], self.a, self.b, self.bits)
        pieces = sorted(((h[s:s + PIECE], i) for i, h in enumerate(rows) if h.size >= FEW for s in range(0, h.size, PIECE)), key=lambda x: -x[0].size)
        while pieces:
            size = pieces[0][0].size
            some, pieces = pieces[:max(1, SIDE // size)], pieces[max(1, SIDE // size):]
            h = np.stack([np.pad(x, (0, size - x.size), "edge") for x, _ in some])
            for (_, i), least in zip(some, self._least(np.sort(h, axis=1))):
                np.minimum(out[i], least, out=out[i])
        return out

    def _least(self, h: np.ndarray) -> np.ndarray:
        """Of rows of ascending hashes the signatures."""
        again = np.zeros(h.shape, dtype=bool)
        again[:, 1:] = h[:, 1:] == h[:, :-1]
        mask = np.uint64((1 << self.shifts.step) - 1)
        x = np.stack([*((h >> np.uint64(k)) & mask for k in self.shifts), np.ones_like(h), h, np.zeros_like(h)]).astype(np.float64)
        x[:, again] = 0
        x[-1, again] = 2.0 ** 52 + 0xFFFFFFFF  # a repeated hash is never the smallest
        x = x.reshape(len(x), -1)
        n, d = len(self.a), len(h)
        first, unsure = np.empty((n, d), dtype=np.int64), np.empty((n, d), dtype=bool)
        step = max(1, TILE // h.size)
        wide, words = np.empty((step, h.size)), np.empty((step, h.size), dtype=np.uint32)
        for s in range(0, n, step):
            f = self.factors[s:s + step]
            np.matmul(f, x, out=wide[:len(f)])
            np.copyto(words, wide.view("<u4")[:, ::2])
            t = words[:len(f)].reshape(-1, h.shape[1])
            at, best = np.arange(len(t)), t.argmin(axis=1)
            least = t[at, best]
            t[at, best] = 0xFFFFFFFF
            unsure[s:s + step] = ((t.min(axis=1) - least <= self.error) | (least <= self.error)).reshape(-1, d)
            first[s:s + step] = best.reshape(-1, d)
        out = _affine(self.a[:, None], h[np.arange(d), first], self.b[:, None], self.bits)
        i, j = np.nonzero(unsure)
        step = max(1, TILE // h.shape[1])
        for s in range(0, i.size, step):
            p, q = i[s:s + step], j[s:s + step]
            out[p, q] = _affine(self.a[p, None], h[q], self.b[p, None], self.bits).min(axis=1)
        return out.T


def _hashes(lists: pa.ListArray) -> list[np.ndarray]:
    """A null list is an empty one."""
    values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b if v else a] for a, b, v in zip(ends, ends[1:], there)]


def _signed(num_perm: int, seed: int, bits: int):
    """Batches whose last column holds hashes -> the same with signatures there,
    a bounded number of rows at a time."""
    step = max(1, OUT_BYTES // (8 * num_perm))

    def run(batches):
        signer = (Signer if bits == 64 else ScaledSigner)(num_perm, seed, bits)
        for b in batches:
            for s in range(0, b.num_rows, step):
                some = b.slice(s, step)
                x = signer.sign(_hashes(some.column(some.num_columns - 1))).view(np.int64)
                at = pa.array(np.arange(0, x.size + 1, num_perm, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.ListArray.from_arrays(at, pa.array(x.ravel()))],
                                                 [*some.schema.names[:-1], "signature"])
    return run


def _text_hashes(text: bytes, ngram: int, func: str, bits: int) -> np.ndarray:
    """Hashes of the word n-grams (fewer words: one gram) of words parted by
    single blanks: each gram is a part of the text as it stands."""
    at = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    starts, ends = np.append(0, at + 1), np.append(at, len(text))
    starts, ends = starts[:max(1, starts.size - ngram + 1)], ends[min(ngram, ends.size) - 1:]
    parts = []
    for s in range(0, starts.size, HASHED):
        grams = [text[i:j] for i, j in zip(starts[s:s + HASHED].tolist(), ends[s:s + HASHED].tolist())]
        if func == "xxh3":
            import xxhash

            parts.append(np.array([xxhash.xxh3_64_intdigest(g) for g in grams], dtype=np.uint64) & np.uint64((1 << min(bits, 32)) - 1))
        else:
            of = getattr(hashlib, func)
            words = np.frombuffer(b"".join([of(g).digest() for g in grams]), dtype=">u4")
            parts.append(words[::len(words) // len(grams)].astype(np.uint64) >> np.uint64(32 - min(bits, 32)))
    return np.unique(np.concatenate(parts))


def _hashed(cfg: MinHashConfig):
    """Batches whose last column holds texts, words parted by single blanks -> of
    the rows with enough words the same with hashes there, a few MB at a time."""
    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(ends // TEXT_BYTES)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                kept, lists = [], []
                for i, x in enumerate(texts.slice(s, e - s)):
                    text = x.as_py()
                    if cfg.min_length > 0 and (text is None or text.count(" ") + 1 < cfg.min_length):
                        continue
                    kept.append(i)
                    lists.append(_text_hashes(text.encode(), cfg.ngram, cfg.hash_func, cfg.hash_bits) if text is not None else np.zeros(0, np.uint64))
                if kept:
                    some = b.slice(s, e - s).take(pa.array(kept, pa.int64()))
                    at = pa.array(np.cumsum([0] + [x.size for x in lists]), pa.int32())
                    flat = pa.array(np.concatenate(lists).view(np.int64))
                    yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.ListArray.from_arrays(at, flat)], b.schema.names)
    return run


def signature_expr(hashes: Column, num_perm: int, seed: int = 42) -> Column:
    """JVM-only signature (higher-order functions) of 28-bit hashes; for small ``num_perm``."""
    a, b = permutations(num_perm, seed)
    cols = []
    for i in range(num_perm):
        ai, bi = int(a[i]), int(b[i])
        v = F.array_min(F.transform(hashes, lambda h: F.pmod(h * F.lit(ai) + F.lit(bi), F.lit(PRIME))))
        cols.append(F.coalesce(v, F.lit(PRIME).cast("bigint")))
    return F.array(*cols)


def minhash_signature(df: DataFrame, id_col: str, text_col: str, cfg: MinHashConfig,
                      method: str = "auto", keep=()) -> DataFrame:
    """``(id, *keep, signature array<bigint>)`` for rows passing the piece-count filter.

    The pieces are found in the JVM and reach a worker as one string, parted by
    blanks; there each gram is a part of it, so no grams are built or shipped."""
    d = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("signature"))
    if method == "expr":
        if cfg.hash_bits != 28:
            raise ValueError("expressions hold 28-bit hashes only")
        d = spread(d.select("id", *keep, tx.word_pieces("signature").alias("w")))
        if cfg.min_length > 0:
            d = d.where(F.size("w") >= cfg.min_length)
        hs = shingle_hashes("w", cfg.ngram, cfg.min_length, cfg.hash_func, cfg.hash_bits)
        return d.select("id", *keep, signature_expr(hs, cfg.num_perm, cfg.seed).alias("signature"))
    d = spread(d).withColumn("signature", tx.spaced_pieces("signature"))
    schema = T.StructType([*d.schema.fields[:-1], T.StructField("signature", T.ArrayType(T.LongType()))])
    hashed, signed = _hashed(cfg), _signed(cfg.num_perm, cfg.seed, cfg.hash_bits)
    return d.mapInArrow(lambda batches: signed(hashed(batches)), schema)


# ---------------------------------------------------------------- LSH
def lsh_bands(sigs: DataFrame, bands: int, rows: int, within=()) -> DataFrame:
    """``(id, band, k1, k2)``: the band's R values, and the columns ``within``
    which two rows can meet, hashed to 128 bits."""
    keyed = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda bi: F.struct(
            bi.alias("band"),
            F.xxhash64(F.slice("signature", bi * rows + 1, rows), *within).alias("k1"),
            F.xxhash64(F.lit("lsh"), F.slice("signature", bi * rows + 1, rows), *within).alias("k2")))
    return sigs.select("id", F.inline(keyed))


def lsh_star_edges(bands: DataFrame) -> DataFrame:
    """For every bucket with more than one member: edge (member, bucket min).
    Grouped min/count (partially aggregated), then a join back; self edges
    dropped, duplicates removed.  The band rows are checkpointed, so the
    signatures before them are computed once."""
    bands = bands.checkpoint(eager=True)
    buckets = (bands.groupBy("band", "k1", "k2")
               .agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > 1).drop("n"))
    return (bands.join(buckets, ["band", "k1", "k2"])
            .where(F.col("id") != F.col("root"))
            .select(F.col("id").alias("src"), F.col("root").alias("dst")).distinct())


# ---------------------------------------------------------------- pipeline
@dataclass
class NearDupResult:
    clusters: DataFrame      # (id, cluster) for every row passing the filter
    edges: DataFrame         # (src, dst) star edges incl. exact-copy links
    n_bands: int


def near_dup_clusters(df: DataFrame, id_col: str, text_col: str, cfg: MinHashConfig = REFERENCE_CALLER,
                      method: str = "auto", within=()) -> NearDupResult:
    """Clusters of the rows that pass the piece-count filter; rows that differ
    in a column of ``within`` (a language, say) are never copies."""
    bands_n, rows_n = cfg.band_rows()
    within = list(within)
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *within)
    if cfg.min_length > 0:
        d = d.where(tx.n_word_pieces("text") >= cfg.min_length)
    d = d.withColumn("_th", F.md5(F.col("text")))
    # exact copies: one representative (smallest id) per distinct text
    reps = d.groupBy("_th", *within).agg(F.min("id").alias("rep"))
    copy_edges = (d.join(reps, ["_th", *within]).where(F.col("id") != F.col("rep"))
                  .select(F.col("id").alias("src"), F.col("rep").alias("dst")))
    rep_rows = d.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "text", *within)
    sigs = minhash_signature(rep_rows, "id", "text", cfg, method, within)
    stars = lsh_star_edges(lsh_bands(sigs, bands_n, rows_n, within))
    edges = stars.unionByName(copy_edges)
    edges = edges.checkpoint(eager=True)
    comp = connected_components(edges, "src", "dst")
    clusters = (d.select("id").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
                .select("id", F.coalesce("component", "id").alias("cluster")))
    return NearDupResult(clusters, edges, bands_n)


# ---------------------------------------------------------------- exact similarity join
MIX = np.uint64(0x9E3779B97F4A7C15)
SAMPLE = 20_000   # about so many texts are counted for the order of the shingles
RANKED = 200_000  # the commonest of their shingles get a rank; the order decides costs, not results


def _grams(words: np.ndarray, ngram: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word n-grams of a sequence of word hashes
    (fewer than ``ngram`` words: one gram), ascending."""
    w = words.astype(np.int64).view(np.uint64)
    n = max(1, w.size - ngram + 1)
    h = w[:n].copy()
    for i in range(1, min(ngram, w.size)):
        h = h * MIX + w[i:i + n]
    return np.unique(h.view(np.int64))


def _gram_rows(ngram: int, threshold: float | None = None, ranked=None):
    """Of ``(id, word hashes)`` the ``(id, n, grams)``; with a threshold only the
    prefix of the grams, rare ones first, that similar texts must share."""
    def run(batches):
        hashes, ranks = ranked.value if ranked is not None else (np.zeros(0, np.int64),) * 2
        for b in batches:
            lists, sizes = [], []
            for w in b.column(1):
                g = _grams(w.values.to_numpy(), ngram)
                sizes.append(g.size)
                if threshold is not None:
                    rank = np.zeros(g.size, dtype=np.int64)
                    if hashes.size:
                        at = np.minimum(np.searchsorted(hashes, g), hashes.size - 1)
                        rank = np.where(hashes[at] == g, ranks[at], 0)
                    g = g[np.lexsort((g, rank))][:g.size - math.ceil(threshold * g.size - 1e-9) + 1]
                lists.append(g)
            offsets = np.cumsum([0] + [g.size for g in lists]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["id", "n", "grams"])
    return run


def _word_hashes(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.transform(tx.word_pieces("text"), lambda w: F.xxhash64(w)).alias("w"))


def _gram_table(words: DataFrame, cfg: MinHashConfig, threshold: float | None = None, ranked=None) -> DataFrame:
    kind = words.schema["id"].dataType.simpleString()
    return words.mapInArrow(_gram_rows(cfg.ngram, threshold, ranked), f"id {kind}, n int, grams array<long>")


def _ranked_grams(words: DataFrame, cfg: MinHashConfig):
    """``(hashes, ranks)`` of the commonest grams of a sample of texts, for a
    global order; any order gives the same pairs."""
    share = 1 << 20
    part = F.pmod(F.xxhash64("id", F.lit(cfg.seed)), F.lit(share)) < int(share * min(1.0, SAMPLE / max(words.count(), 1)))
    seen = _gram_table(words.where(part), cfg).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    top = seen.where("c > 1").orderBy(F.desc("c"), "g").limit(RANKED).toPandas()
    hashes = top["g"].to_numpy(dtype=np.int64)
    by = np.argsort(hashes)
    return hashes[by], (len(hashes) - np.arange(len(hashes), dtype=np.int64))[by]


def _parities(ngram: int):
    """Of ``(id, word hashes)`` the ``(id, n, bits)``: the parity of the number of
    grams per place, in as many places (a power of two, 64 or more) as grams."""
    def run(batches):
        for b in batches:
            sizes, lists = [], []
            for w in b.column(1):
                g = _grams(w.values.to_numpy(), ngram).view(np.uint64)
                places = 1 << max(6, int(g.size - 1).bit_length())
                odd = np.bincount((g & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
                sizes.append(g.size)
                lists.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
            offsets = np.cumsum([0] + [x.size for x in lists]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["id", "n", "bits"])
    return run


def _at_least_apart() -> Column:
    """So many grams at least are in one only of two texts: each changes one
    parity.  The longer bits are folded onto the shorter; two texts of very
    unlike length are not compared (0)."""
    def differing(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

    def folded(a, size):
        return F.zip_with(F.slice(a, 1, size), F.slice(a, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    a, b = F.col("a"), F.col("b")
    i, j = F.size(a), F.size(b)
    return (F.when(i == j, differing(a, b)).when(i == 2 * j, differing(folded(a, j), b))
            .when(j == 2 * i, differing(a, folded(b, i))).otherwise(0))


def _not_far(pairs: DataFrame, words: DataFrame, cfg: MinHashConfig, threshold: float) -> DataFrame:
    """The pairs less those that parities of their grams show to be less
    similar than ``threshold``: a few bytes a pair in place of all grams."""
    kind = words.schema["id"].dataType.simpleString()
    p = words.mapInArrow(_parities(cfg.ngram), f"id {kind}, n int, bits array<long>")
    j = (pairs.join(p.select(F.col("id").alias("src"), F.col("n").alias("na"), F.col("bits").alias("a")), "src")
         .join(p.select(F.col("id").alias("dst"), F.col("n").alias("nb"), F.col("bits").alias("b")), "dst"))
    most = (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb"))
    alike = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    return j.where(alike & (_at_least_apart() <= most + 1e-9)).select("src", "dst")


def _similar(pairs: DataFrame, words: DataFrame, cfg: MinHashConfig, threshold: float) -> DataFrame:
    """The ``(src, dst)`` whose texts have a Jaccard similarity of at least
    ``threshold`` over their distinct grams."""
    near = stored(_not_far(pairs, _used(pairs, words), cfg, threshold), "near")
    g = _gram_table(_used(near, words), cfg)
    j = (near.join(g.select(F.col("id").alias("src"), F.col("grams").alias("a")), "src")
         .join(g.select(F.col("id").alias("dst"), F.col("grams").alias("b")), "dst"))
    common = F.size(F.array_intersect("a", "b"))
    return j.where(common >= threshold * (F.size("a") + F.size("b") - common)).select("src", "dst")


def _used(pairs: DataFrame, words: DataFrame) -> DataFrame:
    return words.join(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")


def stored(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def similar_clusters(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8,
                     cfg: MinHashConfig = REFERENCE_CALLER) -> DataFrame:
    """``(id, cluster)`` of every row passing the filter: connected components of
    all pairs of texts with a Jaccard similarity of at least ``threshold`` over
    their distinct word n-grams (compared by 64-bit hashes).

    Texts that similar share a gram of their prefixes, the rarest grams, so an
    equality join on those finds every pair.  First each bucket's members meet
    its smallest id only; then those pairs of a bucket that are still in
    different components meet, so a bucket of near-copies is not squared.  Pairs
    meet by parities of their grams first; only those that these cannot tell
    apart get the grams.
    """
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    d = d.where(tx.n_word_pieces("text") >= max(cfg.min_length, 1)).withColumn("_th", F.md5(F.col("text")))
    reps = d.groupBy("_th").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    copies = stored(d.select("id", "_th").join(reps, "_th").where("id <> rep"), "copies")
    rows = spread(d.join(copies, ["_th", "id"], "left_anti").select("id", "text"))
    words = stored(_word_hashes(rows), "words")  # read about ten times

    ranked = df.sparkSession.sparkContext.broadcast(_ranked_grams(words, cfg))
    keys = _gram_table(words, cfg, threshold, ranked).select("id", "n", F.posexplode("grams").alias("at", "key"))
    roots = (keys.groupBy("key").agg(F.min(F.struct("id", "n", "at")).alias("root"), F.count(F.lit(1)).alias("c"))
             .where("c > 1").drop("c"))
    shared = stored(keys.join(roots, "key"), "prefixes")

    def may(n, at, m, bt):
        """By length, and by what is left after the first common gram."""
        most = F.least(n - at, m - bt)
        return (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (most >= threshold / (1 + threshold) * (n + m) - 1e-9)

    c = F.col
    stars = (shared.where((c("id") != c("root.id")) & may(c("n"), c("at"), c("root.n"), c("root.at")))
             .select(c("id").alias("src"), c("root.id").alias("dst")).distinct())
    links = stored(_similar(stored(stars, "stars"), words, cfg, threshold), "links")

    comp = connected_components(links, "src", "dst").select(c("node").alias("id"), "component")
    placed = shared.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("key"))
    open_rows = stored(placed.join(mixed, "key", "left_semi").where(c("id") != c("root.id")).drop("root"), "open")
    a, b = open_rows.alias("a"), open_rows.alias("b")
    rest = (a.join(b, c("a.key") == c("b.key"))
            .where((c("a.id") > c("b.id")) & (c("a.component") != c("b.component")) & may(c("a.n"), c("a.at"), c("b.n"), c("b.at")))
            .select(c("a.id").alias("src"), c("b.id").alias("dst")).distinct())
    more = _similar(stored(rest, "rest"), words, cfg, threshold)

    edges = links.unionByName(more).unionByName(copies.select(c("id").alias("src"), c("rep").alias("dst")))
    comp = connected_components(edges, "src", "dst")
    return (d.select("id").join(comp.select(c("node").alias("id"), "component"), "id", "left")
            .select("id", F.coalesce("component", "id").alias("cluster")))


def dedup(df: DataFrame, id_col: str, text_col: str, cfg: MinHashConfig = REFERENCE_CALLER,
          method: str = "auto", within=()) -> DataFrame:
    """Rows that pass the piece-count filter and are their cluster's root."""
    res = near_dup_clusters(df, id_col, text_col, cfg, method, within)
    drop = res.clusters.where(F.col("id") != F.col("cluster")).select(F.col("id").alias(id_col))
    keep_ids = res.clusters.select(F.col("id").alias(id_col))
    return df.join(keep_ids, id_col, "left_semi").join(drop, id_col, "left_anti")


def dedup_columns(df: DataFrame, id_col: str, columns, cfg: MinHashConfig = REFERENCE_CALLER,
                  method: str = "auto", within=()) -> DataFrame:
    """Sequential dedup over several columns, in the given order; each pass
    removes whole rows."""
    out = df
    for c in columns:
        out = dedup(out, id_col, c, cfg, method, within).checkpoint(eager=True)
    return out


def dedup_report(df: DataFrame, id_col: str, text_col: str, cfg: MinHashConfig = REFERENCE_CALLER,
                 method: str = "auto") -> DataFrame:
    res = near_dup_clusters(df, id_col, text_col, cfg, method)
    c = res.clusters
    return c.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.sum((F.col("id") == F.col("cluster")).cast("long")).alias("n_after"),
        F.countDistinct("cluster").alias("n_clusters"),
    ).select("n_before", "n_after", "n_clusters", F.lit(res.n_bands).cast("bigint").alias("n_bands"),
             F.lit(res.edges.distinct().count()).alias("n_edges"))
