"""Batch planning (W11-W13): every batch comes from one dataset (and, for
the cluster planner, rows are laid out cluster by cluster); short tails of
all datasets are pooled in a permuted dataset order, re-cut, the last short
pooled batch dropped; batches are then shuffled.  A pure function of
``(seed, epoch)``.

Ranks inside a dataset come from a range-partitioned sort (a dataset may be
a third of all rows); the tail table and its offsets have one row per
dataset; the batch order is a global rank over batch keys (range sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.order import order_key
from tessera.operators.ranking import dense_index, rank_in_group


def plan_batches(rows: DataFrame, batch_size: int, seed: int = 777, epoch: int = 0,
                 dataset: str = "dataset", key: str = "row_id", cluster: str | None = None,
                 drop_last: bool = False) -> DataFrame:
    """``(batch_order, pos_in_batch, dataset, key)`` for every planned row."""
    B = int(batch_size)
    s = f"{seed}:{epoch}"
    base = rows.select(dataset, key, *([cluster] if cluster else []))
    base = base.withColumn("_ok", order_key(s, "row", dataset, key))
    order = ([cluster] if cluster else []) + ["_ok", key]
    r = rank_in_group(base, [dataset], order, out="_rn", size_col="_n")
    r = r.withColumn("_full", F.floor(F.col("_n") / B).cast("bigint"))
    in_full = F.col("_rn") <= F.col("_full") * B
    full = r.where(in_full).select(
        dataset, key,
        F.concat_ws(":", F.lit("d"), F.col(dataset), F.floor((F.col("_rn") - 1) / B).cast("bigint")).alias("_bkey"),
        ((F.col("_rn") - 1) % B).alias("pos_in_batch"))
    parts = [full]
    if not drop_last:
        tail = r.where(~in_full).withColumn("_t", F.col("_rn") - F.col("_full") * B - 1)
        tl = tail.groupBy(dataset).agg(F.count(F.lit(1)).alias("_tn"))
        # one row per dataset: a plain window is bounded by the dataset count
        w = Window.orderBy(order_key(s, "tail", dataset), dataset).rowsBetween(Window.unboundedPreceding, -1)
        toff = tl.select(dataset, F.coalesce(F.sum("_tn").over(w), F.lit(0)).alias("_off"),
                         F.sum("_tn").over(Window.partitionBy()).alias("_tt"))
        t = tail.join(toff, dataset).withColumn("_p", F.col("_off") + F.col("_t"))
        t = t.where(F.floor(F.col("_p") / B) < F.floor(F.col("_tt") / B))
        parts.append(t.select(
            dataset, key,
            F.concat_ws(":", F.lit("m"), F.floor(F.col("_p") / B).cast("bigint")).alias("_bkey"),
            (F.col("_p") % B).alias("pos_in_batch")))
    planned = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    batches = planned.select("_bkey").distinct().withColumn("_bo", order_key(s, "batch", "_bkey"))
    bord = dense_index(batches, ["_bo", "_bkey"], out="batch_order").drop("_bo")
    return planned.join(bord, "_bkey").select(
        "batch_order", F.col("pos_in_batch").cast("bigint").alias("pos_in_batch"), dataset, key)


def assign_replica(plan: DataFrame, batch_size: int, world_size: int) -> DataFrame:
    """Row i of the flat plan goes to rank ``i mod R``; the flat length must be
    divisible by R (counted only if R does not divide the batch size)."""
    if batch_size % world_size:  # every planned batch is full, so the flat length is a multiple of it
        n = plan.count()
        if n % world_size:
            raise ValueError(f"plan of {n} rows is not divisible by {world_size} replicas")
    gp = F.col("batch_order") * F.lit(batch_size) + F.col("pos_in_batch")
    return plan.withColumn("global_pos", gp).withColumn("replica", F.pmod(gp, F.lit(world_size)))


def in_batch_pairs(examples: DataFrame, batch: str, key: str, mode: str = "cross") -> DataFrame:
    """``(batch, a_key, a_slot, b_key, b_slot, kind)``: the pairs a contrastive
    loss compares.  The items of an example are its query (slot 0), positives
    and negatives; query and positives share a label, each negative has its
    own, so a pair of two items of one label is a ``positive``, any other a
    ``negative``.  ``cross`` pairs all items of a batch (bounded by the batch
    size), ``local`` only those of one example."""
    if mode not in ("cross", "local"):
        raise ValueError(mode)
    one = lambda c, own: F.transform(c, lambda _: F.lit(own))
    items = F.concat(F.array(F.lit(False)), one("positive", False), one("negative", True))
    x = examples.select(batch, F.col(key).alias("k"), F.posexplode(items).alias("slot", "own"))
    a = x.select(batch, F.col("k").alias("a_key"), F.col("slot").alias("a_slot"), F.col("own").alias("_a"))
    b = x.select(batch, F.col("k").alias("b_key"), F.col("slot").alias("b_slot"), F.col("own").alias("_b"))
    j = a.join(b.withColumnRenamed(batch, "_batch"), [a[batch] == F.col("_batch"), *([F.col("a_key") == F.col("b_key")] if mode == "local" else [])])
    same = (F.col("a_key") == F.col("b_key"))
    return j.where(~(same & (F.col("a_slot") == F.col("b_slot")))).select(
        batch, "a_key", "a_slot", "b_key", "b_slot",
        F.when(same & ~F.col("_a") & ~F.col("_b"), "positive").otherwise("negative").alias("kind"))


def hard_pair_mining(df: DataFrame, batch: str, key: str, label: str, vec: str, epsilon: float = 0.25) -> DataFrame:
    """Multi-similarity mining inside each batch (cosine similarity): keep a
    negative (a, n) when sim(a, n) + eps > the anchor's least similar
    positive, a positive (a, p) when sim(a, p) - eps < the anchor's most
    similar negative.  One ``applyInPandas`` call per batch (bounded by the
    batch size) computes the similarity matrix; only mined pairs leave it."""
    import numpy as np
    import pandas as pd

    out_schema = f"{batch} long, anchor long, other long, kind string, sim double"

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        X = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
        X = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)
        S = X @ X.T
        ids = pdf[key].to_numpy(dtype=np.int64)
        lab = pdf[label].to_numpy()
        same = lab[:, None] == lab[None, :]
        eye = np.eye(len(ids), dtype=bool)
        pos = same & ~eye
        neg = ~same
        min_pos = np.where(pos, S, np.inf).min(axis=1)
        max_neg = np.where(neg, S, -np.inf).max(axis=1)
        keep_neg = neg & (S + epsilon > min_pos[:, None])
        keep_pos = pos & (S - epsilon < max_neg[:, None])
        rows = []
        for kind, m in (("negative", keep_neg), ("positive", keep_pos)):
            a, o = np.nonzero(m)
            rows.append(pd.DataFrame({batch: int(pdf[batch].iloc[0]), "anchor": ids[a], "other": ids[o],
                                      "kind": kind, "sim": S[a, o]}))
        return pd.concat(rows, ignore_index=True)

    return df.select(batch, key, label, vec).groupBy(batch).applyInPandas(mine, out_schema)
