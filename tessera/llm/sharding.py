"""Sharding through fixed virtual slots.

Every record hashes into one of ``n_slots`` slots by its id, for good; rows
that repeat an id hash by the id and their rank among its rows, so an id that
fills a third of the table is spread over all slots.  A versioned map says which shard holds each slot.  The first map is filled from
the bytes per slot, largest slot first into the lightest shard; later versions
edit the one before, moving only the slots that a new shard or a drifted size
asks for.  A map has one row per slot, a fixed number, so it may be broadcast
and worked on in the driver; records are only joined to it.

The law of the shards is ``bytes``: sizes near equal (apart by about one slot).

Defined cases: a null text has no bytes and the CRC of the empty text; a null
id hashes by the text; rows that repeat an id (or a text without id) are ranked
by size and CRC, equal rows in any order, and each has its own place; ties go to the lower shard; an empty table gives no rows and a map
that deals the slots out evenly.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import rank_in_group

N_SLOTS = 1 << 13
ROW_BYTES = 16
LAW = "bytes"


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]``; ``version`` counts the edits."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def save(self, spark: SparkSession, path: str) -> str:
        """One table per version: ``path/version=N``."""
        at = f"{path.rstrip('/')}/version={self.version}"
        rows = [(i, s, self.n_shards) for i, s in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "virtual_slot int, shard int, n_shards int").coalesce(1).write.parquet(at)
        return at

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> "SlotMap":
        """The newest version unless one is named."""
        rows = spark.read.parquet(path)
        version = version if version is not None else rows.agg(F.max("version")).first()[0]
        rows = rows.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def slot_key(id_col: str, text_col: str) -> Column:
    """64-bit hash of the id, or of the text where there is none."""
    by_id = F.xxhash64(F.col(id_col).cast("string"))
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(by_id)


def with_slots(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``virtual_slot`` from ``slot_key`` (dropped): the first row of a key has
    the key's slot, the others that of (key, rank by size and CRC).  Only rows
    of repeated keys are sorted, by ranges that also split equal rows."""
    def slot(key):
        return F.pmod(key, F.lit(n_slots)).cast("int").alias("virtual_slot")

    others = [F.col(c) for c in rows.columns if c != "slot_key"]
    repeated = rows.groupBy("slot_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("slot_key").checkpoint()
    if repeated.isEmpty():
        return rows.select(*others, slot(F.col("slot_key")))
    single = rows.join(repeated, "slot_key", "left_anti").select(*others, slot(F.col("slot_key")))
    several = rows.join(repeated, "slot_key", "left_semi").withColumn("slot_row", F.monotonically_increasing_id())
    ranked = rank_in_group(several, ["slot_key"], ["size", "text_crc32", "slot_row"], out="slot_rank")
    salted = F.when(F.col("slot_rank") == 1, F.col("slot_key")).otherwise(F.xxhash64("slot_key", "slot_rank"))
    return single.unionByName(ranked.select(*others, slot(salted)))


def record_bytes(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long")


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes per slot; ``records`` has ``virtual_slot`` and ``size``."""
    out = [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect():
        out[r["virtual_slot"]] = r["size"]
    return out


def first_map(sizes: list[int], n_shards: int) -> SlotMap:
    heap = [(0, 0, s) for s in range(n_shards)]  # bytes, slots, shard
    shard_of = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, n, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (size + sizes[slot], n + 1, shard))
    return SlotMap(1, n_shards, tuple(shard_of))


def _edit(old: SlotMap, n_shards: int, shard_of: list[int]) -> SlotMap:
    return SlotMap(old.version + 1, n_shards, tuple(shard_of))


def grow(old: SlotMap, sizes: list[int]) -> SlotMap:
    """The next version with one more shard, which takes slots from the
    heaviest shards until it has its share; no slot moves elsewhere."""
    new, shard_of = old.n_shards, list(old.shard_of)
    load = [0] * (new + 1)
    slots: list[list[int]] = [[] for _ in range(new)]
    for slot, s in enumerate(shard_of):
        load[s] += sizes[slot]
        slots[s].append(slot)
    for own in slots:
        own.sort(key=lambda i: (sizes[i], i))
    share = sum(sizes) / (new + 1)
    while True:
        rich = max(range(new), key=lambda s: (load[s], -s))
        own = [i for i in slots[rich] if load[new] + sizes[i] <= share or sizes[i] == 0]
        if not own or not sizes[own[-1]] or load[rich] <= load[new]:
            return _edit(old, new + 1, shard_of)
        slot = own[-1]
        slots[rich].remove(slot)
        shard_of[slot] = new
        load[rich] -= sizes[slot]
        load[new] += sizes[slot]


def rebalance(old: SlotMap, sizes: list[int], tolerance: float = 0.01) -> SlotMap:
    """The next version after sizes have changed: slots move from the heaviest
    to the lightest shard while that narrows the gap and the gap is over
    ``tolerance`` of the mean."""
    shard_of = list(old.shard_of)
    load = [0] * old.n_shards
    for slot, s in enumerate(shard_of):
        load[s] += sizes[slot]
    mean = sum(sizes) / old.n_shards
    for _ in sizes:
        rich, poor = max(range(old.n_shards), key=load.__getitem__), min(range(old.n_shards), key=load.__getitem__)
        gap = load[rich] - load[poor]
        fits = [i for i, s in enumerate(shard_of) if s == rich and 0 < sizes[i] < gap]
        if gap <= tolerance * mean or not fits:
            break
        slot = min(fits, key=lambda i: (abs(gap - 2 * sizes[i]), i))
        shard_of[slot] = poor
        load[rich] -= sizes[slot]
        load[poor] += sizes[slot]
    return _edit(old, old.n_shards, shard_of)


def map_table(spark: SparkSession, m: SlotMap) -> DataFrame:
    shards = F.array(*[F.lit(s) for s in m.shard_of])
    return spark.range(1).select(F.posexplode(shards).alias("virtual_slot", "shard"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [record_bytes(text_col).alias("size"),
            F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")).alias("text_crc32"),
            slot_key(id_col, text_col).alias("slot_key")]


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """``(id_col, size, text_crc32, virtual_slot)`` of every row."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = d.select("id", *_keyed(d, "id", "text")).checkpoint()
    return with_slots(keyed, n_slots).withColumnRenamed("id", id_col)


def assign(recs: DataFrame, m: SlotMap, id_col: str = "doc_id") -> DataFrame:
    """Adds ``shard`` and ``slot``, the row's place in its shard (gapless from
    0): rows in front of its virtual slot in that shard, and its place in the
    virtual slot.  A window holds one virtual slot, a small fixed share of all
    rows."""
    spark = recs.sparkSession
    rows = recs.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    table = map_table(spark, m).join(rows, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("virtual_slot").orderBy(id_col, "size", "text_crc32")
    return (recs.withColumn("place", F.row_number().over(own) - 1)
            .join(F.broadcast(table), "virtual_slot")  # one row per slot
            .withColumn("slot", (F.col("ahead") + F.col("place")).cast("long")).drop("place", "ahead"))


def write_shards(docs: DataFrame, m: SlotMap, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of ``docs`` as ``path/shard=N``; a task writes a few
    virtual slots, not a shard."""
    d = docs.select(F.struct(*[c for c in docs.columns if c != "shard"]).alias("doc"), F.col(id_col).alias("id"),
                    F.col(text_col).alias("text"))
    slots = with_slots(d.select("doc", *_keyed(d, "id", "text")), len(m.shard_of))
    shard = F.element_at(F.array(*[F.lit(s) for s in m.shard_of]), F.col("virtual_slot") + 1)
    (slots.select("doc", shard.alias("shard"), (F.col("virtual_slot") % 16).alias("lane")).repartition("shard", "lane")
     .select("doc.*", "shard").write.partitionBy("shard").parquet(path))


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """``records`` with ``law``, ``shard``, ``slot`` and ``map_version``;
    ``map_path`` also stores the map there."""
    recs = records(docs, id_col, text_col, n_slots).checkpoint()
    m = first_map(slot_bytes(recs, n_slots), n_shards)
    if map_path:
        m.save(docs.sparkSession, map_path)
    return assign(recs, m, id_col).withColumns({"law": F.lit(LAW), "map_version": F.lit(m.version)})
