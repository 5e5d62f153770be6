"""Reproducible sampling (W1-W10, W13-W16): every random choice is an md5
order key of (seed, tag, key), so results do not depend on partitioning,
retries or the executor count, and each has an exact SQL twin.

Ranks inside groups and over the whole table come from range-partitioned
sorts (``ranking``); a hot group or the whole table never sits in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.order import order_key
from tessera.operators.ranking import dense_index, rank_in_group, running_sum


def rank_in_group_random(df: DataFrame, group: str, key: str, seed: int = 0, out: str = "rn") -> DataFrame:
    """1-based rank inside ``group`` in md5 order of (seed, key)."""
    d = df.withColumn("_ok", order_key(seed, "rank", key))
    return rank_in_group(d, [group], ["_ok", key], out=out).drop("_ok")


def cap_group(ranked: DataFrame, cap: int = 3000, rn: str = "rn") -> DataFrame:
    return ranked.where(F.col(rn) <= cap)


def chunk_group(ranked: DataFrame, size: int = 32, rn: str = "rn", out: str = "chunk") -> DataFrame:
    return ranked.withColumn(out, F.floor((F.col(rn) - 1) / size).cast("bigint"))


def sample_per_group(chunks: DataFrame, group: str, unit: str = "chunk", n: int = 16, seed: int = 0) -> DataFrame:
    """``n`` distinct units per group without replacement (md5 order), ranked by
    a range-partitioned sort: a group's units may be many."""
    u = chunks.select(group, unit).distinct().withColumn("_ok", order_key(seed, "chunk", group, unit))
    return rank_in_group(u, [group], ["_ok", unit], out="_k").where(F.col("_k") <= n).select(group, unit)


def sample_n_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all when fewer) in md5 order of (seed, key).  The keys
    are uniform, so the first ``n`` lie below about n / N of their range: only
    keys below a bound a little above that are ranked, and rows are joined to
    the ``n`` keys found."""
    keys = df.select(key).withColumn("_ok", order_key(seed, "sample", key))
    total = keys.count()
    part = min(1.0, (n + 6 * math.sqrt(n) + 20) / max(total, 1))
    while True:
        low = keys if part >= 1 else keys.where(F.col("_ok") < format(int(part * 2 ** 32), "08x"))
        if part >= 1 or low.count() >= n:
            break
        part = min(1.0, 2 * part)
    first = dense_index(low, ["_ok", key], out="_i").where(F.col("_i") < n)
    return df.join(first.select(key), key, "left_semi")


def stratified_cluster_sample(df: DataFrame, n: int, key: str = "row_id", cluster: str = "cluster",
                              seed: int = 0) -> DataFrame:
    """If more than ``n`` rows: ``ceil(n / #clusters)`` random rows per cluster,
    topped up with random unselected rows until ``n`` (never cut back)."""
    total = df.count()
    if total <= n:
        return df
    n_clusters = df.select(cluster).distinct().count()
    quota = math.ceil(n / n_clusters)
    r = rank_in_group_random(df, cluster, key, seed, out="_rc")
    r = r.withColumn("_sel", F.col("_rc") <= quota).checkpoint(eager=True)
    chosen = r.where("_sel").count()
    picked = r.where("_sel").drop("_rc", "_sel")
    need = n - chosen
    if need <= 0:
        return picked
    rest = r.where(~F.col("_sel")).drop("_rc", "_sel")
    top = sample_n_rows(rest, need, key, seed)
    return picked.unionByName(top)


def cluster_index(df: DataFrame, cluster: str = "cluster", key: str = "row_id") -> DataFrame:
    """cluster -> sorted row ids, in long form ``(cluster, pos, row_id)``."""
    return rank_in_group(df.select(cluster, key), [cluster], [key], out="pos")


def sample_array(arr, k: int, seed, row_key, tag: str = "elem"):
    """<= k elements without replacement, order = md5(seed, tag, row, index)."""
    keyed = F.transform(arr, lambda x, i: F.struct(order_key(seed, tag, row_key, i).alias("k"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["x"])


def batch_min_truncate(df: DataFrame, batch: str, cols=("positive", "negative"), k: int = 1,
                       seed: int = 0, row_key: str = "row_id") -> DataFrame:
    """Sample ``k`` of each list, then cut every list of a batch to the batch
    minimum (window over one batch: bounded by the batch size)."""
    out = df
    w = Window.partitionBy(batch)
    for c in cols:
        out = out.withColumn(c, sample_array(F.col(c), k, seed, row_key, tag=c))
        out = out.withColumn(c, F.slice(F.col(c), 1, F.min(F.size(c)).over(w)))
    return out


def batch_flag_all(df: DataFrame, batch: str, flag: str, out: str = "batch_flag") -> DataFrame:
    return df.withColumn(out, F.bool_and(F.coalesce(F.col(flag), F.lit(True))).over(Window.partitionBy(batch)))


def resolve_batch_size(global_batch: int, world_size: int) -> int:
    """Global batch rounded down to a multiple of the world size, >= 1 per worker."""
    per = max(1, global_batch // max(1, world_size))
    return per * max(1, world_size)


def global_row_ids(df: DataFrame, dataset: str = "dataset", key: str = "row_id",
                   order=None, out: str = "global_id") -> DataFrame:
    """Unique id over concatenated datasets: 0-based local index (by
    ``key``) + sum of the sizes of the datasets before it (``order``, a
    column list; default dataset name).  The size table has one row per
    dataset."""
    r = rank_in_group(df, [dataset], [key], out="_local")
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(*(order or [dataset])).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(dataset, "_off")
    return r.join(offs, dataset).withColumn(out, F.col("_off") + F.col("_local") - 1).drop("_off", "_local")


def rows_of_global_ids(ids: DataFrame, sizes: DataFrame, id_col: str = "global_id", dataset: str = "dataset",
                       size: str = "n", order=None, few: int = 4096) -> DataFrame:
    """Global ids back to rows: ``ids`` with ``dataset`` and ``local_row``.

    ``sizes`` has a row per dataset, in the order of ``global_row_ids``; empty
    datasets hold no id.  Negative ids count from the end, and an id out of
    range is an error when it is read.  Up to ``few`` datasets are a sorted
    array of offsets that each batch of ids is searched in; more are merged with
    the ids in ranges of both."""
    named = sizes.select(F.col(dataset).alias("_ds"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [dataset])], F.col(size).alias("_n"))
    keys = [c for c in named.columns if c.startswith("_o")]
    if len(head := named.orderBy(*keys).limit(few + 1).collect()) <= few:
        return _searched(ids, head, id_col, dataset, sizes.schema[dataset].dataType)
    offsets = running_sum(named, keys, ["_n"]).select("_ds", "_pos", (F.col("cum__n") - F.col("_n")).alias("_off"), "cum__n")
    total = offsets.agg(F.max("cum__n")).first()[0]
    asked = ids.withColumn("_at", _in_range(id_col, total))
    given = [F.col(c).alias(f"_i{i}") for i, c in enumerate(ids.columns)]
    marks = offsets.select(F.col("_off").alias("_at"), F.lit(0).alias("_asked"), F.col("_pos").alias("_tie"), F.struct("_pos", "_off", "_ds").alias("_mark"))
    both = marks.unionByName(asked.select("_at", F.lit(1).alias("_asked"), F.monotonically_increasing_id().alias("_tie"), *given), allowMissingColumns=True)
    by = ["_at", "_asked", "_tie"]  # the last one spreads an id that is asked for often
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    s = both.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).checkpoint()
    ends = {r["_pid"]: r["m"] for r in s.where("_mark is not null").groupBy("_pid").agg(F.max("_mark").alias("m")).collect()}  # a row per partition
    carried, so_far = [], (None, None, None)
    for p in range(n):
        carried.append((p, *so_far))
        so_far = ends.get(p, so_far)
    kind = marks.schema["_mark"].dataType
    ahead = ids.sparkSession.createDataFrame(carried, T.StructType([T.StructField("_pid", T.LongType()), *[T.StructField(f"_c{f.name}", f.dataType) for f in kind.fields]]))
    w = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)  # a range of the sort
    j = s.withColumn("_own", F.last("_mark", ignorenulls=True).over(w)).where("_asked = 1").join(F.broadcast(ahead), "_pid")
    return j.select(*[F.col(f"_i{i}").alias(c) for i, c in enumerate(ids.columns)], F.coalesce("_own._ds", "_c_ds").alias(dataset),
                    (F.col("_at") - F.coalesce("_own._off", "_c_off")).alias("local_row"))


def _in_range(id_col: str, total: int):
    at = F.when(F.col(id_col) < 0, F.col(id_col) + total).otherwise(F.col(id_col))
    return F.when(at.between(0, total - 1) | at.isNull(), at).otherwise(F.raise_error(F.concat(F.lit("no row has the global id "), F.col(id_col).cast("string"))))


def _searched(ids: DataFrame, datasets: list, id_col: str, dataset: str, kind) -> DataFrame:
    names, ends = [r["_ds"] for r in datasets], np.cumsum([r["_n"] for r in datasets], dtype=np.int64)
    starts = ends - [r["_n"] for r in datasets]

    @F.pandas_udf(T.StructType([T.StructField("d", kind), T.StructField("r", T.LongType())]))
    def find(at: pd.Series) -> pd.DataFrame:
        known = at.notna().to_numpy()
        x = at.fillna(0).to_numpy(dtype=np.int64)
        i = np.minimum(np.searchsorted(ends, x, side="right"), len(ends) - 1)
        return pd.DataFrame({"d": [names[j] if k else None for j, k in zip(i, known)], "r": pd.Series(x - starts[i], dtype="Int64").mask(~known)})

    found = ids.withColumn("_at", _in_range(id_col, int(ends[-1]) if len(ends) else 0)).withColumn("_f", find("_at"))
    return found.select(*ids.columns, F.col("_f.d").alias(dataset), F.col("_f.r").alias("local_row"))


def training_view(examples: DataFrame, registry: DataFrame, k_pos: int = 1, k_neg: int = 1, seed: int = 0,
                  dataset: str = "dataset", key: str = "row_id") -> DataFrame:
    """Example + instruction + cross-batch flag (default true) + sampled
    positives/negatives.  The registry has one row per dataset."""
    j = examples.join(registry, dataset, "left")
    return j.select(
        dataset, key, "query",
        sample_array(F.col("positive"), k_pos, seed, key, "pos").alias("positive"),
        sample_array(F.col("negative"), k_neg, seed, key, "neg").alias("negative"),
        F.coalesce(F.col("instruction"), F.lit("")).alias("instruction"),
        F.coalesce(F.col("enable_cross_batch_negative_sampling"), F.lit(True)).alias("cross_batch"))
