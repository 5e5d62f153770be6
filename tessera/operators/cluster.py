"""k-means clustering of embeddings and nearest-centroid assignment."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as vx


def effective_k(n_rows: int, k: int, min_per_cluster: int = 20) -> int:
    """Shrink k to ``n // 20`` when there are fewer than 20 rows per cluster."""
    if n_rows < min_per_cluster * k:
        return max(1, n_rows // min_per_cluster)
    return k


def kmeans_clusters(df: DataFrame, vec: str = "embedding", k: int = 1024, max_iter: int = 200,
                    seed: int = 7, normalize: bool = True, id_col: str | None = None):
    """Fit ``pyspark.ml`` k-means (k-means||, fixed seed) on (normalised)
    vectors; returns ``(assigned DataFrame with 'cluster', centroids list)``."""
    d = df.withColumn("_v", vx.l2_normalize(vec) if normalize else vx.as_double(vec))
    n = d.count()
    kk = effective_k(n, k)
    if kk == 1:  # fewer than 40 rows; Spark's k-means asks for two clusters
        mean = centroids_by_label(d.select("_v", F.lit(0).alias("_one")), "_v", "_one").first()
        return d.drop("_v").withColumn("cluster", F.lit(0)), [list(mean["centroid"])] if mean else []
    feats = d.withColumn("_f", array_to_vector("_v"))
    model = KMeans(k=kk, maxIter=max_iter, seed=seed, featuresCol="_f", predictionCol="cluster").fit(feats)
    out = model.transform(feats).drop("_f", "_v")
    return out, [c.tolist() for c in model.clusterCenters()]


def kmeans_report(df: DataFrame, id_col: str, vec: str = "embedding", k: int = 1024, max_iter: int = 200, seed: int = 7) -> DataFrame:
    """One row that says whether a fit can be trusted: rows, the shrunk k, rows
    without a cluster, clusters that are no fitted centre, and rows whose
    centre is not a nearest one (by distance, so that ties count as right)."""
    v = df.select(F.col(id_col).alias("id"), vx.l2_normalize(vec).alias("v"))
    out, centres = kmeans_clusters(v, "v", k, max_iter, seed, normalize=False)
    spark = df.sparkSession
    made = spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cid long, centroid array<double>")
    own = out.select("id", "v", F.col("cluster").cast("long").alias("mine")).checkpoint()
    near = assign_nearest_centroid(own, made, "v", out="best")
    gap = vx.sq_distance("v", "centroid") - F.col("best_dist")
    judged = near.join(made, F.col("mine") == F.col("cid"), "left")
    return judged.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("mine").isNull().cast("long")).alias("n_unassigned"),
                      F.sum(F.col("cid").isNull().cast("long")).alias("n_unknown"),
                      F.sum((gap > 1e-9).cast("long")).alias("n_not_nearest")).withColumn(
        "k", F.when(F.col("n_rows") < 20 * k, F.greatest(F.lit(1), F.floor(F.col("n_rows") / 20))).otherwise(k).cast("long")).withColumn(
        "k_fits", F.lit(len(centres)) <= F.col("k"))


def centroids_by_label(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Exact per-label mean vectors (the test centroids): (label, dim) grouped mean."""
    e = df.select(F.col(label).alias("cid"), F.posexplode(vx.as_double(vec)).alias("dim", "x"))
    g = e.groupBy("cid", "dim").agg(F.avg("x").alias("v"))
    return g.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("_c")).select(
        "cid", F.col("_c.v").alias("centroid"))


def _nearest(shared, vec: str, out: str, cells: int):
    """Per row the nearest centroid of one block, if nearer than what the row
    has already (or as near, with a smaller id)."""
    def run(it):
        cid, cm = shared.value
        cn = (cm * cm).sum(axis=1)
        for pdf in it:
            best, dist = (pdf[c].to_numpy(copy=True) for c in (out, out + "_dist"))
            step = max(1, cells // max(len(cid), 1))
            for s in range(0, len(pdf), step):
                X = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec].iloc[s:s + step]])
                D = (X * X).sum(axis=1)[:, None] + cn[None, :] - 2.0 * (X @ cm.T)
                slack = 1e-14 * (X.shape[1] + 4) * ((X * X).sum(axis=1) + cn.max())
                for i, row in enumerate(D):  # rank what roundings cannot tell apart directly
                    near = np.flatnonzero(row <= row.min() + slack[i])
                    exact = ((X[i] - cm[near]) ** 2).sum(axis=1)
                    j = int(np.argmin(exact))  # first minimum = smallest id (ids sorted)
                    if (exact[j], cid[near[j]]) < (dist[s + i], best[s + i]):
                        best[s + i], dist[s + i] = cid[near[j]], exact[j]
            yield pdf.assign(**{out: best, out + "_dist": dist})
    return run


def assign_nearest_centroid(df: DataFrame, centroids: DataFrame, vec: str = "embedding",
                            block_bytes: int = 64 << 20, out: str = "cluster") -> DataFrame:
    """Nearest centroid (squared L2; ties -> smallest centroid id).  The
    centroid table is split into blocks of about ``block_bytes`` by count and
    dimension; each comes through Arrow and is shipped as a broadcast variable
    to one Arrow pass over the vectors, which carry their best so far.  No
    vector x centroid join is materialised."""
    size = centroids.agg(F.sum(8 * (F.size("centroid").cast("long") + 1))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.LongType()),
                                              T.StructField(out + "_dist", T.DoubleType())])
    d = df.withColumns({out: F.lit(2 ** 63 - 1), out + "_dist": F.lit(float("inf"))})
    for b in range(n):
        rows = centroids.where(F.pmod(F.xxhash64("cid"), F.lit(n)) == b).select(
            F.col("cid").cast("long"), F.col("centroid").cast("array<double>")).orderBy("cid").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        flat = rows.column("centroid").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        shared = df.sparkSession.sparkContext.broadcast(
            (rows.column("cid").to_numpy(), flat.reshape(rows.num_rows, -1)))
        d = d.mapInPandas(_nearest(shared, vec, out, 1 << 22), schema)
    return d
