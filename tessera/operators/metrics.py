"""Evaluation metrics over tables (M1-M6): retrieval, reranking, STS
correlation, pair classification, clustering V-measure, linear probe.

Per-query metrics only use windows over one query's ranked list (bounded by
k or the candidate count); dataset-wide rankings (Spearman, average
precision) use range-partitioned global positions, never a single-task
window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import running_sum


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _idcg(m):
    return F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0),
                       lambda acc, i: acc + F.when(i <= m, 1.0 / F.log2(i + 1)).otherwise(0.0))


def retrieval_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query: nDCG@k, MRR@k, MAP@k, recall@k, precision@k with binary
    relevance; ``run(qid, rank, cid)``, ``qrels(qid, cid)``.  Average precision
    is over all relevant ids, also those beyond the cut.  Queries without
    judged ids are not scored; judged queries missing from the run score 0."""
    rel = qrels.select("qid", "cid").distinct().withColumn("rel", F.lit(1))
    r = run.where(F.col("rank") <= k).join(rel, ["qid", "cid"], "left").fillna(0, ["rel"])
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("cum", F.sum("rel").over(w))
    per = r.groupBy("qid").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))).alias("rr"),
        F.sum(F.when(F.col("rel") == 1, F.col("cum") / F.col("rank")).otherwise(0.0)).alias("ap_num"),
        F.sum("rel").alias("hits"))
    nrel = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    j = nrel.join(per, "qid", "left").fillna(0.0, ["dcg", "ap_num"]).fillna(0, ["hits"])
    m = F.least(F.col("n_rel"), F.lit(k))
    return j.select(
        "qid",
        _safe_div(F.col("dcg"), _idcg(m)).alias("ndcg"),
        F.coalesce(F.col("rr"), F.lit(0.0)).alias("mrr"),
        _safe_div(F.col("ap_num"), F.col("n_rel").cast("double")).alias("map"),
        _safe_div(F.col("hits").cast("double"), F.col("n_rel").cast("double")).alias("recall"),
        (F.col("hits") / F.lit(float(k))).alias("precision"))


def mean_over_queries(per_query: DataFrame, key: str = "qid") -> DataFrame:
    """One row: the mean of every metric and the number of queries."""
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c != key], F.count(F.lit(1)).alias("n_queries"))


def reranking_metrics(candidates: DataFrame) -> DataFrame:
    """``candidates(qid, cid, score, rel)`` -> per query MAP and MRR over the
    candidate list ranked by score (desc), ties by id."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid")
    r = candidates.withColumn("rank", F.row_number().over(w))
    wc = w.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("cum", F.sum("rel").over(wc))
    return r.groupBy("qid").agg(
        _safe_div(F.sum(F.when(F.col("rel") == 1, F.col("cum") / F.col("rank")).otherwise(0.0)),
                  F.sum("rel").cast("double")).alias("map"),
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``(value, out)``: 1-based rank of every distinct value, ties sharing the
    average: counts per value, then running counts over the distinct values."""
    by = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    r = running_sum(by, [value], ["_n"])
    return r.select(value, (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(out))


def sts_correlation(pairs: DataFrame, score: str, gold: str, id_col: str = "id") -> DataFrame:
    """Pearson and Spearman (average ranks for ties) of a score against gold."""
    base = pairs.select(F.col(score).alias("_s"), F.col(gold).cast("double").alias("_g")).checkpoint(eager=True)
    j = base.join(average_ranks(base, "_s", "_rs"), "_s").join(average_ranks(base, "_g", "_rg"), "_g")
    return j.agg(F.corr("_s", "_g").alias("pearson"), F.corr("_rs", "_rg").alias("spearman"),
                 F.count(F.lit(1)).alias("n_pairs"))


def pair_average_precision(pairs: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision of ``score`` as a duplicate detector and the best
    accuracy over thresholds between distinct scores.  Pairs of equal score
    enter together, so their order does not matter: AP is the sum over the
    distinct scores of the recall they add times the precision down to them."""
    base = pairs.select(F.col(score).alias("_s"), F.col(label).cast("long").alias("_y"))
    by = base.groupBy((-F.col("_s")).alias("_ms")).agg(F.sum("_y").alias("_y"), F.sum(1 - F.col("_y")).alias("_neg"))
    by = by.checkpoint(eager=True)
    r = running_sum(by, ["_ms"], ["_y", "_neg"])
    tot = by.agg(F.sum(F.col("_y") + F.col("_neg")).alias("n"), F.sum("_y").alias("p")).collect()[0]
    n, p = tot["n"] or 0, tot["p"] or 0
    seen = F.col("cum__y") + F.col("cum__neg")
    ap = F.sum(F.col("_y") * F.col("cum__y") / seen) / F.lit(max(p, 1))
    acc = F.max(F.when(seen < n, (F.col("cum__y") + F.lit(n - p) - F.col("cum__neg")) / F.lit(float(max(n, 1)))))
    return r.agg(F.coalesce(ap, F.lit(0.0)).alias("average_precision"), F.coalesce(acc, F.lit(0.0)).alias("best_accuracy"),
                 F.lit(n).cast("bigint").alias("n_pairs"))


def v_measure(assign: DataFrame, truth: str, pred: str) -> DataFrame:
    """Homogeneity, completeness and V-measure (natural log) from the
    contingency table (grouped count, partial aggregation)."""
    ct = assign.groupBy(truth, pred).agg(F.count(F.lit(1)).cast("double").alias("n"))
    nc = ct.groupBy(truth).agg(F.sum("n").alias("nc"))
    nk = ct.groupBy(pred).agg(F.sum("n").alias("nk"))
    j = ct.join(nc, truth).join(nk, pred)
    # sum_c n_c log n_c = sum_{c,k} n_ck log n_c (and likewise for k): one pass
    row = j.agg(
        F.sum("n").alias("N"),
        F.sum(F.col("n") * F.log(F.col("n") / F.col("nk"))).alias("a_ck"),
        F.sum(F.col("n") * F.log(F.col("n") / F.col("nc"))).alias("a_kc"),
        F.sum(F.col("n") * F.log(F.col("nc"))).alias("x"),
        F.sum(F.col("n") * F.log(F.col("nk"))).alias("y"))
    N = F.col("N")
    H_C = F.log(N) - F.col("x") / N
    H_K = F.log(N) - F.col("y") / N
    H_CK = -F.col("a_ck") / N
    H_KC = -F.col("a_kc") / N
    h = F.when(H_C <= 1e-15, F.lit(1.0)).otherwise(1 - H_CK / H_C)
    c = F.when(H_K <= 1e-15, F.lit(1.0)).otherwise(1 - H_KC / H_K)
    out = row.select(h.alias("homogeneity"), c.alias("completeness"))
    return out.select("homogeneity", "completeness",
                      F.when(F.col("homogeneity") + F.col("completeness") == 0, F.lit(0.0))
                      .otherwise(2 * F.col("homogeneity") * F.col("completeness")
                                 / (F.col("homogeneity") + F.col("completeness"))).alias("v_measure"))


def classification_scores(pred: DataFrame, truth: str = "y", guess: str = "prediction") -> DataFrame:
    """Accuracy and macro-F1 (over the classes seen on either side) from a
    grouped confusion table."""
    conf = pred.groupBy(F.col(truth).alias("y"), F.col(guess).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    tp = conf.where(F.col("y") == F.col("prediction")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    act = conf.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("na"))
    prd = conf.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("np"))
    per = act.join(prd, "c", "outer").join(tp, "c", "left").fillna(0)
    return per.agg(
        _safe_div(F.sum("tp").cast("double"), F.sum("na").cast("double")).alias("accuracy"),
        F.avg(_safe_div(2.0 * F.col("tp"), (F.col("na") + F.col("np")).cast("double"))).alias("macro_f1"))


def probe_predictions(train: DataFrame, test: DataFrame, vec: str, label: str, max_iter: int = 100) -> DataFrame:
    """``(y, prediction)`` of the test rows by a multinomial logistic
    regression on the vectors of the training rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    tr = train.select(array_to_vector(vec).alias("f"), F.col(label).cast("double").alias("y"))
    te = test.select(array_to_vector(vec).alias("f"), F.col(label).cast("double").alias("y"))
    model = LogisticRegression(featuresCol="f", labelCol="y", maxIter=max_iter).fit(tr)
    return model.transform(te).select("y", "prediction")


def probe_accuracy(train: DataFrame, test: DataFrame, vec: str, label: str, max_iter: int = 100) -> DataFrame:
    """Linear probe: test accuracy and macro-F1."""
    return classification_scores(probe_predictions(train, test, vec, label, max_iter))
