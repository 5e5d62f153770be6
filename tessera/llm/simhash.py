"""SimHash near-duplicates by deletion-variant signatures.

The fingerprint is cut into ``max_bits // 2 + 1`` segments: of two fingerprints
that differ in at most ``max_bits`` bits, one segment differs in at most one.
Each distinct fingerprint is indexed under every segment with one bit struck
out (64 variants in all), equal variants meet by an equality join, and every
candidate pair is verified by its bit distance.

Only the variant that strikes a segment's first bit also compares pairs equal
in that bit; the others ask for a difference in the struck bit, so a pair is
not met again in every variant.  A crowded variant (more than ``crowd``
fingerprints) would emit all its pairs; its fingerprints take another road
with the same links: each emits itself and its 64 one-bit neighbours, and
those that share a point are within two bits of each other.  A point has at
most 65 such fingerprints, so no group grows, and each is linked to the
smallest of its group only.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; fewer words than a shingle form one
shingle; rows that repeat an id are rows of their own; a null id takes the
component of its fingerprint (null if no row there has an id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.rows import keyed_text, text_slices, utf8
from tessera.operators.components import connected_components

BITS = 64
SEED = 42


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """SimHash of a UTF-8 text: bit *i* is 1 if it is set in over half of the
    shingle hashes.  ``bytes.lower`` and ``bytes.split`` know ASCII only, as
    the definition asks."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    n = len(words) - shingle_words + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        size = min(65536, n - at)
        hashes = np.fromiter((xxh64_intdigest(next(shingles), SEED) for _ in range(size)), dtype="<u8", count=size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches):
        for b in text_slices(batches):
            fps = [fingerprint(t, shingle_words) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["id", "fp"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def _variants(fps: DataFrame, segments: int) -> DataFrame:
    """``(bit, part, first, on, fp)``: the segment of ``bit`` without that bit."""
    width = -(-BITS // segments)
    rows = []
    for i in range(BITS):
        lo = i // width * width
        mask = ((1 << min(width, BITS - lo)) - 1) << lo & ~(1 << i)
        rows.append((mask ^ (1 << 63)) - (1 << 63))  # as a signed long
    masks = F.array(*[F.lit(m).cast("long") for m in rows])
    x = fps.select("fp", F.posexplode(masks).alias("bit", "mask"))
    return x.select("bit", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp",
                    (F.col("bit") % width == 0).alias("first"),
                    F.expr("shiftrightunsigned(fp, bit) & 1").alias("on"))


def links(fps: DataFrame, max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """``(src, dst)``: pairs of distinct fingerprints within ``max_bits`` that
    connect all that are linked.  ``fps`` has one row per fingerprint."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    none = fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).where(F.lit(False))
    if max_bits == 0:
        return none
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.repartition(parts, F.xxhash64("fp"))  # 64 rows come of each, so not in a few tasks
    index = _variants(dealt, max_bits // 2 + 1)
    sizes = (index.groupBy("bit", "part", "first")
             .agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("lo"), F.max("on").alias("hi"))
             .where((F.col("n") > 1) & (F.col("first") | (F.col("lo") < F.col("hi"))))
             .select("bit", "part", "n"))
    # Spark sizes an exploded table as if it had its rows before; by hint neither side is ever broadcast
    met = index.join(sizes.hint("merge"), ["bit", "part"]).checkpoint()
    few = met.where(F.col("n") <= crowd)
    other = few.select("bit", "part", F.col("fp").alias("fp2"), F.col("on").alias("on2"))
    pairs = (few.join(other, ["bit", "part"])
             .where((F.col("fp") < F.col("fp2")) & (F.col("first") | (F.col("on") != F.col("on2"))))
             .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits)
             .select(F.col("fp").alias("src"), F.col("fp2").alias("dst")))
    if max_bits == 1:  # one segment: a variant holds two fingerprints at most
        return pairs
    near = F.array(F.col("fp"), *[F.expr(f"fp ^ shiftleft(1L, {i})") for i in range(BITS)])
    points = met.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(near).alias("point"))
    groups = points.groupBy("point").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = (groups.select(F.array_min("all").alias("src"), F.explode("all").alias("dst"))
             .where(F.col("src") != F.col("dst")))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` of every row: the fingerprint as
    16 hex digits, and the smallest id reachable over links of at most
    ``max_bits`` differing bits, the row's own included."""
    rows = fingerprints(docs, id_col, text_col, shingle_words).checkpoint()
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    comps = connected_components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(comps, nodes.fp == comps.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
