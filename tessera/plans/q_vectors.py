"""Registered queries: vectors, k-NN, hard negatives, clustering, metrics
(V1-V13, T1, T2, M1-M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as vx
from tessera.operators import cluster as C
from tessera.operators import knn as K
from tessera.operators import metrics as M
from tessera.operators import vectors as V
from tessera.operators.dedup import spread
from tessera.plans.catalog import register, r6
from tessera.sources import tables as T

INSTR = "Retrieve semantically similar text."
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"
SQD = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
NORM = "sqrt(list_sum(list_transform({a}, lambda x: x::double * x::double)))"
COS = f"({DOT.format(a='{a}', b='{b}')} / ({NORM.format(a='{a}')} * {NORM.format(a='{b}')}))"


def _long(df, key, vec="embedding"):
    return df.select(key, F.posexplode(vec).alias("dim", "value")).select(
        key, F.col("dim").cast("bigint").alias("dim"), r6("value"))


def _qvecs(spark, d):
    q = T.fx_vec_queries(spark, d)
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding")
    return q.join(e, "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"),
                                      "cluster", "positive_ids")


def _corpus(spark, d):
    return T.fx_vectors(spark, d).select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cvec"), "cluster")


QV_SQL = "qv as (select v.vec_id as qid, v.cluster, v.positive_ids, e.embedding as qvec from fx_vec_queries v join embeddings e on e.vec_id = v.vec_id)"


def _pairs_sql(metric: str) -> str:
    s = SQD if metric == "l2" else DOT
    o = "d" if metric == "l2" else "-d"
    return (QV_SQL + f""",
pr as (select qv.qid, c.vec_id as cid, c.cluster as ccl, qv.cluster as qcl, qv.positive_ids, {s.format(a='qv.qvec', b='c.embedding')} as d
       from qv, fx_vectors c),
rk as (select *, row_number() over (partition by qid order by {o}, cid) as rank from pr)""")


@register("encode_texts", f"""
with c as (select _id, case when coalesce(title, '') <> '' then title || ' ' || text else text end as t from fx_corpus),
p as (select _id, unnest(list_filter(regexp_split_to_array(lower('passage: ' || t), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) as w from c),
b as (select _id, ('0x' || substr(md5(w), 1, 8))::UBIGINT::BIGINT % 64 as dim, count(*) as n from p group by all),
n as (select _id, sqrt(sum(n * n)) as nn from b group by _id)
select _id, dim, round(n / nn, 6) as value from b join n using (_id)
""")
def encode_texts(spark, d):
    c = T.fx_corpus(spark, d).select("_id", V.format_encoder_input("text", "passage:", title="title").alias("t"))
    e = V.hashing_embedding(c, "_id", "t", 64).select("_id", F.posexplode("embedding").alias("dim", "value"))
    return e.where("value <> 0").select("_id", F.col("dim").cast("bigint").alias("dim"), r6("value"))


def word_count_encoder():
    return V.HashingEncoder(64, normalize=False)


@register("encode_texts_batched", f"""
with c as (select _id, case when coalesce(title, '') <> '' then title || ' ' || text else text end as t from fx_corpus),
p as (select _id, unnest(list_filter(regexp_split_to_array(lower('passage: ' || t), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) as w from c)
select _id, ('0x' || substr(md5(w), 1, 8))::UBIGINT::BIGINT % 64 as dim, cast(count(*) as double) as value from p group by all
""")
def encode_texts_batched(spark, d):
    """The encoder protocol: whole texts in Arrow batches through an encoder built once per worker."""
    c = spread(T.fx_corpus(spark, d).select("_id", V.format_encoder_input("text", "passage:", title="title").alias("t")))
    e = V.encode_texts(c, "t", word_count_encoder).select("_id", F.posexplode("embedding").alias("dim", "value"))
    return e.where("value <> 0").select("_id", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("double").alias("value"))


@register("format_encoder_input", f"""
select _id, '{INSTR} ' || case when coalesce(title, '') <> '' then title || ' ' || text else text end as input from fx_corpus
""")
def format_encoder_input(spark, d):
    c = T.fx_corpus(spark, d)
    return c.select("_id", V.format_encoder_input("text", INSTR, title="title").alias("input"))


_TOK = "(select doc, pos, mask, unnest(range(len(embedding))) as dim, unnest(embedding)::double as x from fx_token_vectors)"


@register("pool_mean", f"""
select doc, cast(dim as bigint) as dim, round(avg(x), 6) as value from {_TOK} where mask = 1 group by doc, dim
""")
def pool_mean(spark, d):
    return _long(V.pool_mean(T.fx_token_vectors(spark, d)), "doc")


@register("pool_weighted_mean", f"""
with t as (select doc, pos, embedding, mask * sum(mask) over (partition by doc order by pos rows between unbounded preceding and current row) as w
           from fx_token_vectors),
x as (select doc, w, unnest(range(len(embedding))) as dim, unnest(embedding)::double as x from t)
select doc, cast(dim as bigint) as dim, round(sum(x * w) / sum(w), 6) as value from x group by doc, dim
""")
def pool_weighted_mean(spark, d):
    return _long(V.pool_weighted_mean(T.fx_token_vectors(spark, d)), "doc")


@register("pool_last_token", f"""
with l as (select doc, arg_max(embedding, pos) as e from fx_token_vectors where mask = 1 group by doc)
select doc, cast(unnest(range(len(e))) as bigint) as dim, round(unnest(e)::double, 6) as value from l
""")
def pool_last_token(spark, d):
    return _long(V.pool_last_token(T.fx_token_vectors(spark, d)), "doc")


@register("pool_first_token", f"""
with l as (select doc, arg_min(embedding, pos) as e from fx_token_vectors group by doc)
select doc, cast(unnest(range(len(e))) as bigint) as dim, round(unnest(e)::double, 6) as value from l
""")
def pool_first_token(spark, d):
    return _long(V.pool_first_token(T.fx_token_vectors(spark, d)), "doc")


@register("l2_normalize", f"""
with n as (select vec_id, embedding, {NORM.format(a='embedding')} as nn from fx_vectors)
select vec_id, cast(unnest(range(len(embedding))) as bigint) as dim, round(unnest(embedding)::double / nn, 6) as value from n
""")
def l2_normalize(spark, d):
    return _long(V.l2_normalize(T.fx_vectors(spark, d), "embedding"), "vec_id")


@register("cosine_pairs", f"select id, round({COS.format(a='e1', b='e2')}, 6) as cosine from fx_sts")
def cosine_pairs(spark, d):
    return V.cosine_pairs(T.fx_sts(spark, d), "e1", "e2").select("id", r6("cosine"))


@register("knn_topk", "with " + _pairs_sql("l2") + """
select qid, cast(rank as int) as rank, cid, round(d, 6) as score from rk where rank <= 10
""")
def knn_topk(spark, d):
    t = K.knn_topk(_qvecs(spark, d), _corpus(spark, d), 10, "l2")
    return t.select("qid", "rank", "cid", r6("score"))


@register("topk_per_key", "with " + _pairs_sql("ip") + """
select qid, cast(rank as int) as rank, cid, round(d, 6) as score from rk where rank <= 5
""")
def topk_per_key(spark, d):
    t = K.knn_topk(_qvecs(spark, d), _corpus(spark, d), 5, "ip")
    return t.select("qid", "rank", "cid", r6("score"))


@register("rank_slice", "with " + _pairs_sql("l2") + """
select qid, cast(rank - 5 as int) as rank, cid from rk where rank > 5 and rank <= 15
""")
def rank_slice(spark, d):
    t = K.knn_topk(_qvecs(spark, d), _corpus(spark, d), 15, "l2").withColumnRenamed("rank", "_r")
    s = K.rank_slice(t, 5, 10, "qid", ["_r"])
    return s.select("qid", (F.col("rank") - 5).cast("int").alias("rank"), "cid")


@register("hard_negatives", "with " + _pairs_sql("l2") + """
select qid, cast(rank - 30 as int) as rank, cid from rk where rank > 30 and rank <= 128
""")
def hard_negatives(spark, d):
    n = K.hard_negatives(_qvecs(spark, d), _corpus(spark, d), k=128, skip=30, metric="l2")
    return n.select("qid", (F.col("rank") - 30).cast("int").alias("rank"), "cid")


@register("hard_negatives_excl_positives", "with " + _pairs_sql("l2") + """,
t as (select * from rk where rank <= 128 and not list_contains(positive_ids, cid)),
r2 as (select qid, cid, row_number() over (partition by qid order by rank) as rr from t)
select qid, cast(rr - 30 as int) as rank, cid from r2 where rr > 30
""")
def hard_negatives_excl_positives(spark, d):
    q = _qvecs(spark, d)
    pos = q.select("qid", F.explode("positive_ids").alias("cid"))
    n = K.hard_negatives(q, _corpus(spark, d), k=128, skip=30, metric="l2", exclusion="positive_ids", positives=pos)
    return n.select("qid", (F.col("rank") - 30).cast("int").alias("rank"), "cid")


@register("hard_negatives_excl_cluster", "with " + _pairs_sql("l2") + """,
t as (select * from rk where rank <= 2048 and ccl <> qcl),
r2 as (select qid, cid, row_number() over (partition by qid order by rank) as rr from t)
select qid, cast(rr - 20 as int) as rank, cid from r2 where rr > 20 and rr <= 140
""")
def hard_negatives_excl_cluster(spark, d):
    n = K.hard_negatives(_qvecs(spark, d), _corpus(spark, d), k=2048, skip=20, take=120, metric="l2",
                         exclusion="same_cluster", q_cluster="cluster", c_cluster="cluster")
    return n.select("qid", (F.col("rank") - 20).cast("int").alias("rank"), "cid")


@register("kmeans_clusters")
def kmeans_clusters(spark, d):
    out, _ = C.kmeans_clusters(T.fx_vectors(spark, d).select("vec_id", "embedding"), "embedding", k=1024, max_iter=200, seed=7)
    return out.select("vec_id", F.col("cluster").cast("bigint").alias("cluster"))


@register("kmeans_report", """
select count(*) as n_rows, cast(0 as bigint) as n_unassigned, cast(0 as bigint) as n_unknown, cast(0 as bigint) as n_not_nearest,
       cast(case when count(*) < 20 * 1024 then greatest(1, count(*) // 20) else 1024 end as bigint) as k, true as k_fits
from fx_vectors
""")
def kmeans_report(spark, d):
    """The fit of kmeans_clusters, judged row by row."""
    return C.kmeans_report(T.fx_vectors(spark, d), "vec_id")


_CENT_SQL = """
cx as (select cluster as cid, unnest(range(len(embedding))) as dim, unnest(embedding)::double as x from fx_vectors),
cent as (select cid, list(v order by dim) as centroid from (select cid, dim, avg(x) as v from cx group by cid, dim) group by cid),
dd as (select f.vec_id, f.cluster as truth, c.cid, """ + SQD.format(a="f.embedding", b="c.centroid") + """ as d from fx_vectors f, cent c),
asg as (select vec_id, truth, arg_min(cid, struct_pack(d := d, c := cid)) as pred, min(d) as dist from dd group by vec_id, truth)"""


@register("assign_nearest_centroid", "with " + _CENT_SQL + """
select vec_id, cast(pred as bigint) as cluster, round(dist, 6) as dist from asg
""")
def assign_nearest_centroid(spark, d):
    v = T.fx_vectors(spark, d)
    cents = C.centroids_by_label(v, "embedding", "cluster")
    a = C.assign_nearest_centroid(v.select("vec_id", "embedding"), cents, "embedding")
    return a.select("vec_id", F.col("cluster").cast("bigint").alias("cluster"), r6("cluster_dist", "dist"))


_RETRIEVAL_SQL = "with " + _pairs_sql("l2") + """,
rel as (select distinct qid, unnest(positive_ids) as cid from qv),
r as (select rk.qid, rk.rank, rk.cid, case when rel.cid is null then 0 else 1 end as rel from rk left join rel using (qid, cid) where rk.rank <= 10),
c as (select *, sum(rel) over (partition by qid order by rank rows between unbounded preceding and current row) as cum from r),
per as (select qid, sum(rel / log2(rank + 1)) as dcg, max(case when rel = 1 then 1.0 / rank end) as rr,
               sum(case when rel = 1 then cum / rank else 0 end) as ap_num, sum(rel) as hits from c group by qid),
nr as (select qid, count(*) as n_rel from rel group by qid)
select nr.qid,
  round(case when coalesce(dcg, 0) = 0 then 0 else dcg / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))) end, 6) as ndcg,
  round(coalesce(rr, 0), 6) as mrr,
  round(coalesce(ap_num, 0) / n_rel, 6) as map,
  round(coalesce(hits, 0)::double / n_rel, 6) as recall,
  round(coalesce(hits, 0) / 10.0, 6) as precision
from nr left join per using (qid)
"""

@register("retrieval_metrics", _RETRIEVAL_SQL)
def retrieval_metrics(spark, d):
    q = _qvecs(spark, d)
    run = K.knn_topk(q, _corpus(spark, d), 10, "l2")
    rel = q.select("qid", F.explode("positive_ids").alias("cid"))
    m = M.retrieval_metrics(run, rel, 10)
    return m.select("qid", *[r6(c) for c in ("ndcg", "mrr", "map", "recall", "precision")])


@register("retrieval_metrics_mean", "select " + ", ".join(f"round(avg({c}), 5) as {c}" for c in ("ndcg", "mrr", "map", "recall", "precision"))
          + f", count(*) as n_queries from ({_RETRIEVAL_SQL.replace(', 6) as', ', 12) as')})")
def retrieval_metrics_mean(spark, d):
    q = _qvecs(spark, d)
    m = M.mean_over_queries(M.retrieval_metrics(K.knn_topk(q, _corpus(spark, d), 10, "l2"),
                                                q.select("qid", F.explode("positive_ids").alias("cid")), 10))
    return m.select(*[F.round(c, 5).alias(c) for c in ("ndcg", "mrr", "map", "recall", "precision")], "n_queries")


@register("reranking_metrics", "with " + _pairs_sql("l2") + """,
rel as (select distinct qid, unnest(positive_ids) as cid from qv),
cand as (select qid, cid from rk where rank <= 20 union select qid, cid from rel),
sc as (select cand.qid, cand.cid, """ + COS.format(a="qv.qvec", b="e.embedding") + """ as score,
              case when rel.cid is null then 0 else 1 end as rel
       from cand join qv using (qid) join embeddings e on e.vec_id = cand.cid left join rel using (qid, cid)),
r as (select *, row_number() over (partition by qid order by score desc, cid) as rank from sc),
c as (select *, sum(rel) over (partition by qid order by rank rows between unbounded preceding and current row) as cum from r)
select qid, round(case when sum(rel) = 0 then 0 else sum(case when rel = 1 then cum / rank else 0 end) / sum(rel) end, 6) as map,
       round(coalesce(max(case when rel = 1 then 1.0 / rank end), 0), 6) as mrr
from c group by qid
""")
def reranking_metrics(spark, d):
    q = _qvecs(spark, d)
    top = K.knn_topk(q, _corpus(spark, d), 20, "l2").select("qid", "cid")
    rel = q.select("qid", F.explode("positive_ids").alias("cid")).distinct().withColumn("rel", F.lit(1))
    cand = top.union(rel.select("qid", "cid")).distinct()
    e = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cvec"))
    sc = (cand.join(q.select("qid", "qvec"), "qid").join(e, "cid").join(rel, ["qid", "cid"], "left")
          .select("qid", "cid", vx.cosine("qvec", "cvec").alias("score"), F.coalesce("rel", F.lit(0)).alias("rel")))
    return M.reranking_metrics(sc).select("qid", r6("map"), r6("mrr"))


@register("sts_correlation", f"""
with s as (select id, {COS.format(a='e1', b='e2')} as s, gold as g from fx_sts),
rs as (select id, s, row_number() over (order by s, id) as ri from s),
ars as (select s, avg(ri) as a from rs group by s),
rg as (select id, g, row_number() over (order by g, id) as ri from s),
arg as (select g, avg(ri) as a from rg group by g)
select round(corr(s.s, s.g), 6) as pearson, round(corr(ars.a, arg.a), 6) as spearman, count(*) as n_pairs
from s join ars on ars.s = s.s join arg on arg.g = s.g
""")
def sts_correlation(spark, d):
    p = V.cosine_pairs(T.fx_sts(spark, d), "e1", "e2")
    return M.sts_correlation(p, "cosine", "gold").select(r6("pearson"), r6("spearman"), "n_pairs")


@register("pair_average_precision", f"""
with s as (select {COS.format(a='e1', b='e2')} as s, case when gold >= 3 then 1 else 0 end as y from fx_sts),
g as (select s, sum(y) as y, count(*) as n from s group by s),
r as (select *, sum(n) over w as cn, sum(y) over w as cy from g window w as (order by s desc rows between unbounded preceding and current row)),
t as (select count(*) as n, sum(y) as p from s)
select round(sum(r.y * cy / cn) / max(t.p), 6) as average_precision,
       round(max(case when cn < t.n then (cy + (t.n - t.p) - (cn - cy)) / t.n end), 6) as best_accuracy,
       max(t.n) as n_pairs
from r, t
""")
def pair_average_precision(spark, d):
    p = V.cosine_pairs(T.fx_sts(spark, d), "e1", "e2").withColumn("y", (F.col("gold") >= 3).cast("int"))
    return M.pair_average_precision(p, "cosine", "y").select(r6("average_precision"), r6("best_accuracy"), "n_pairs")


@register("clustering_v_measure", "with " + _CENT_SQL + """,
ct as (select truth, pred, count(*)::double as n from asg group by truth, pred),
nc as (select truth, sum(n) as nc from ct group by truth),
nk as (select pred, sum(n) as nk from ct group by pred),
j as (select ct.n, nc.nc, nk.nk from ct join nc using (truth) join nk using (pred)),
a as (select sum(n) as big_n, sum(n * ln(n / nk)) as a_ck, sum(n * ln(n / nc)) as a_kc, sum(n * ln(nc)) as x, sum(n * ln(nk)) as y from j),
hc as (select case when ln(big_n) - x / big_n <= 1e-15 then 1.0 else 1 - (-a_ck / big_n) / (ln(big_n) - x / big_n) end as h,
              case when ln(big_n) - y / big_n <= 1e-15 then 1.0 else 1 - (-a_kc / big_n) / (ln(big_n) - y / big_n) end as c from a)
select round(h, 6) as homogeneity, round(c, 6) as completeness, round(case when h + c = 0 then 0 else 2 * h * c / (h + c) end, 6) as v_measure from hc
""")
def clustering_v_measure(spark, d):
    v = T.fx_vectors(spark, d)
    a = C.assign_nearest_centroid(v, C.centroids_by_label(v, "embedding", "cluster"), "embedding", out="pred")
    m = M.v_measure(a, "cluster", "pred")
    return m.select(r6("homogeneity"), r6("completeness"), r6("v_measure"))


@register("probe_accuracy")
def probe_accuracy(spark, d):
    v = T.fx_vectors(spark, d)
    key = F.substring(F.md5(F.concat_ws(":", F.lit("0"), F.lit("probe"), F.col("vec_id").cast("string"))), 1, 1)
    train = v.where(key < "c")
    test = v.where(key >= "c")
    return M.probe_accuracy(train, test, "embedding", "cluster").select(r6("accuracy"), r6("macro_f1"))


@register("classification_scores", "with " + _CENT_SQL + """,
cls as (select distinct truth as c from asg union select distinct pred from asg),
per as (select c, (select count(*) from asg where truth = c and pred = c) as tp, (select count(*) from asg where truth = c) as na,
               (select count(*) from asg where pred = c) as np from cls)
select round((select count(*) from asg where truth = pred) / (select count(*) from asg), 6) as accuracy,
       round(avg(2.0 * tp / (na + np)), 6) as macro_f1 from per
""")
def classification_scores(spark, d):
    """The probe's figures for the nearest-centroid classifier."""
    v = T.fx_vectors(spark, d)
    a = C.assign_nearest_centroid(v, C.centroids_by_label(v, "embedding", "cluster"), "embedding", out="pred")
    return M.classification_scores(a, "cluster", "pred").select(r6("accuracy"), r6("macro_f1"))
