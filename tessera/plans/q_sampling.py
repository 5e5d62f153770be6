"""Registered queries: sampling and batch planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import batching as BT
from tessera.operators import sampling as S
from tessera.plans.catalog import joined, register
from tessera.sources import tables as T

MD5 = "md5(concat_ws(':', {parts}))"
B = 32          # global batch of the registered plans (reference default)
SEED = 777      # reference default seed


def _ranked(spark, d):
    g = T.fx_grouped(spark, d).select("category", "doc_id")
    return S.rank_in_group_random(g, "category", "doc_id", seed=0)


RANK_SQL = "select category, doc_id, row_number() over (partition by category order by md5(concat_ws(':', '0', 'rank', cast(doc_id as varchar))), doc_id) as rn from fx_grouped"


@register("rank_in_group", f"select category, doc_id, cast(rn as bigint) as rn from ({RANK_SQL})")
def rank_in_group(spark, d):
    return _ranked(spark, d).select("category", "doc_id", "rn")


@register("cap_group", f"select category, doc_id from ({RANK_SQL}) where rn <= 3000")
def cap_group(spark, d):
    return S.cap_group(_ranked(spark, d), 3000).select("category", "doc_id")


@register("chunk_group", f"select category, doc_id, cast((rn - 1) // 32 as bigint) as chunk from ({RANK_SQL})")
def chunk_group(spark, d):
    return S.chunk_group(_ranked(spark, d), 32).select("category", "doc_id", "chunk")


@register("sample_per_group", f"""
with c as (select distinct category, cast((rn - 1) // 32 as bigint) as chunk from ({RANK_SQL})),
k as (select *, row_number() over (partition by category order by md5(concat_ws(':', '0', 'chunk', category, cast(chunk as varchar))), chunk) as kk from c)
select category, chunk from k where kk <= 16
""")
def sample_per_group(spark, d):
    c = S.chunk_group(_ranked(spark, d), 32)
    return S.sample_per_group(c, "category", "chunk", 16, seed=0)


@register("sample_n_rows", """
select doc_id from documents order by md5(concat_ws(':', '0', 'sample', cast(doc_id as varchar))), doc_id limit 500
""")
def sample_n_rows(spark, d):
    return S.sample_n_rows(T.table(spark, d, "documents").select("doc_id"), 500, "doc_id", seed=0)


@register("stratified_cluster_sample", """
with r as (select row_id, cluster, row_number() over (partition by cluster order by md5(concat_ws(':', '0', 'rank', cast(row_id as varchar))), row_id) as rc from fx_examples),
q as (select cast(ceil(300.0 / count(distinct cluster)) as bigint) as quota, count(*) as total from fx_examples),
sel as (select row_id from r, q where rc <= quota),
need as (select 300 - count(*) as n from sel),
rest as (select row_id, row_number() over (order by md5(concat_ws(':', '0', 'sample', cast(row_id as varchar))), row_id) as g
         from fx_examples where row_id not in (select row_id from sel))
select row_id from sel union all select row_id from rest, need where g <= need.n
""")
def stratified_cluster_sample(spark, d):
    e = T.fx_examples(spark, d).select("row_id", "cluster")
    return S.stratified_cluster_sample(e, 300, "row_id", "cluster", seed=0).select("row_id")


@register("cluster_index", """
select cluster, cast(row_number() over (partition by cluster order by row_id) as bigint) as pos, row_id from fx_examples
""")
def cluster_index(spark, d):
    return S.cluster_index(T.fx_examples(spark, d), "cluster", "row_id").select("cluster", "pos", "row_id")


_SAMPLE_ARR = ("list_transform(list_sort(list_transform({arr}, lambda x, i: {{'k': md5(concat_ws(':', '0', '{tag}', cast(row_id as varchar), cast(i - 1 as varchar))), 'x': x}}))[1:{k}], lambda s: s.x)")


@register("sample_array", f"""
select row_id, array_to_string({_SAMPLE_ARR.format(arr='positive', tag='pos', k=2)}, chr(31)) as positive,
       array_to_string({_SAMPLE_ARR.format(arr='negative', tag='neg', k=3)}, chr(31)) as negative
from fx_examples
""")
def sample_array(spark, d):
    e = T.fx_examples(spark, d)
    return e.select("row_id", joined(S.sample_array(F.col("positive"), 2, 0, "row_id", "pos"), "positive"),
                    joined(S.sample_array(F.col("negative"), 3, 0, "row_id", "neg"), "negative"))


def _plan_sql(cluster: bool, drop_last: bool = False) -> str:
    s = f"{SEED}:0"
    order = ("cluster, " if cluster else "") + f"md5(concat_ws(':', '{s}', 'row', dataset, cast(row_id as varchar))), row_id"
    tail = "" if drop_last else f"""
tl as (select dataset, count(*) as tn from f where rn > fl * {B} group by dataset),
toff as (select dataset, coalesce(sum(tn) over (order by md5(concat_ws(':', '{s}', 'tail', dataset)), dataset rows between unbounded preceding and 1 preceding), 0) as off,
                sum(tn) over () as tt from tl),"""
    mixed = "" if drop_last else f"""
union all
select f.dataset, f.row_id, concat_ws(':', 'm', cast((toff.off + rn - fl * {B} - 1) // {B} as varchar)) as bkey, (toff.off + rn - fl * {B} - 1) % {B} as pos
from f join toff using (dataset) where rn > fl * {B} and (toff.off + rn - fl * {B} - 1) // {B} < toff.tt // {B}"""
    return f"""
with r as (select dataset, row_id, cluster, row_number() over (partition by dataset order by {order}) as rn, count(*) over (partition by dataset) as n from fx_examples),
f as (select *, n // {B} as fl from r),{tail}
k as (select dataset, row_id, concat_ws(':', 'd', dataset, cast((rn - 1) // {B} as varchar)) as bkey, (rn - 1) % {B} as pos from f where rn <= fl * {B}{mixed}),
b as (select bkey, row_number() over (order by md5(concat_ws(':', '{s}', 'batch', bkey)), bkey) - 1 as batch_order from (select distinct bkey from k))
select cast(b.batch_order as bigint) as batch_order, cast(k.pos as bigint) as pos_in_batch, k.dataset, k.row_id from k join b using (bkey)
"""


@register("plan_batches_by_dataset", _plan_sql(False))
def plan_batches_by_dataset(spark, d):
    return BT.plan_batches(T.fx_examples(spark, d), B, seed=SEED, epoch=0)


@register("plan_batches_by_cluster", _plan_sql(True))
def plan_batches_by_cluster(spark, d):
    return BT.plan_batches(T.fx_examples(spark, d), B, seed=SEED, epoch=0, cluster="cluster")


@register("assign_replica", "with p as (" + _plan_sql(False).strip() + f""")
select row_id, cast(batch_order * {B} + pos_in_batch as bigint) as global_pos, cast((batch_order * {B} + pos_in_batch) % 4 as bigint) as replica from p
""")
def assign_replica(spark, d):
    p = BT.plan_batches(T.fx_examples(spark, d), B, seed=SEED, epoch=0)
    return BT.assign_replica(p, B, 4).select("row_id", "global_pos", "replica")


@register("batch_min_truncate", "with p as (" + _plan_sql(False).strip() + f"""),
e as (select p.batch_order, x.row_id, {_SAMPLE_ARR.format(arr='x.positive', tag='positive', k=2).replace('row_id', 'x.row_id')} as sp,
             {_SAMPLE_ARR.format(arr='x.negative', tag='negative', k=2).replace('row_id', 'x.row_id')} as sn
      from p join fx_examples x using (row_id))
select row_id, array_to_string(sp[1:m], chr(31)) as positive, array_to_string(sn[1:mn], chr(31)) as negative
from (select *, min(len(sp)) over (partition by batch_order) as m, min(len(sn)) over (partition by batch_order) as mn from e)
""")
def batch_min_truncate(spark, d):
    e = T.fx_examples(spark, d)
    p = BT.plan_batches(e, B, seed=SEED, epoch=0).select("batch_order", "row_id")
    j = p.join(e.select("row_id", "positive", "negative"), "row_id")
    t = S.batch_min_truncate(j, "batch_order", cols=("positive", "negative"), k=2, seed=0, row_key="row_id")
    return t.select("row_id", joined("positive"), joined("negative"))


@register("batch_flag_all", "with p as (" + _plan_sql(False).strip() + """)
select row_id, bool_and(x.dataset <> 'en') over (partition by batch_order) as batch_flag from p join fx_examples x using (row_id)
""")
def batch_flag_all(spark, d):
    e = T.fx_examples(spark, d)
    p = BT.plan_batches(e, B, seed=SEED, epoch=0).select("batch_order", "row_id", "dataset")
    f = p.withColumn("flag", F.col("dataset") != "en")
    return S.batch_flag_all(f, "batch_order", "flag").select("row_id", "batch_flag")


@register("global_row_ids", """
with r as (select dataset, row_id, row_number() over (partition by dataset order by row_id) - 1 as li from fx_examples),
s as (select dataset, coalesce(sum(n) over (order by dataset rows between unbounded preceding and 1 preceding), 0) as off
      from (select dataset, count(*) as n from fx_examples group by dataset))
select r.dataset, r.row_id, cast(s.off + r.li as bigint) as global_id from r join s using (dataset)
""")
def global_row_ids(spark, d):
    e = T.fx_examples(spark, d).select("dataset", "row_id")
    return S.global_row_ids(e, "dataset", "row_id").select("dataset", "row_id", "global_id")


def _asked_rows_sql(group: str) -> str:
    return f"""
with x as (select {group} as dataset, row_id from fx_examples),
r as (select dataset, row_number() over (partition by dataset order by row_id) - 1 as local_row from x),
s as (select dataset, coalesce(sum(n) over (order by dataset rows between unbounded preceding and 1 preceding), 0) as off
      from (select dataset, count(*) as n from x group by dataset)),
g as (select r.dataset, r.local_row, s.off + r.local_row as place, (select count(*) from x) as total from r join s using (dataset))
select cast(place as bigint) as asked, dataset, cast(local_row as bigint) as local_row from g
union all select cast(place - total as bigint), dataset, cast(local_row as bigint) from g"""


def _asked_rows(spark, d, group: str, few: int):
    e = T.fx_examples(spark, d).select(F.col(group).alias("dataset"), "row_id")
    ids = S.global_row_ids(e, "dataset", "row_id").select(F.col("global_id").alias("asked"))
    total = ids.agg(F.count(F.lit(1))).first()[0]
    sizes = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    both = ids.unionByName(ids.select((F.col("asked") - total).alias("asked")))  # every row from the front and from the end
    return S.rows_of_global_ids(both, sizes, "asked", few=few).select("asked", "dataset", "local_row")


@register("rows_of_global_ids", _asked_rows_sql("dataset"))
def rows_of_global_ids(spark, d):
    """Every global id back to its dataset and row there, by binary search."""
    return _asked_rows(spark, d, "dataset", 4096)


@register("rows_of_global_ids_merged", _asked_rows_sql("cluster"))
def rows_of_global_ids_merged(spark, d):
    """The same with one dataset per source, by the merge that many datasets take."""
    return _asked_rows(spark, d, "cluster", 0)


def registry_for(spark):
    """Fixture registry rows for the example datasets (one per language)."""
    rows = [("de", "Retrieve German passages.", False), ("en", "Retrieve passages.", True),
            ("es", "Retrieve Spanish passages.", None), ("fr", "Retrieve French passages.", True)]
    return spark.createDataFrame(rows, "dataset string, instruction string, enable_cross_batch_negative_sampling boolean")


@register("training_view", f"""
with reg as (select * from (values ('de', 'Retrieve German passages.', false), ('en', 'Retrieve passages.', true),
                                   ('es', 'Retrieve Spanish passages.', null), ('fr', 'Retrieve French passages.', true))
             t(dataset, instruction, flag))
select x.dataset, x.row_id, x.query, array_to_string({_SAMPLE_ARR.format(arr='x.positive', tag='pos', k=1).replace('row_id', 'x.row_id')}, chr(31)) as positive,
       array_to_string({_SAMPLE_ARR.format(arr='x.negative', tag='neg', k=1).replace('row_id', 'x.row_id')}, chr(31)) as negative,
       coalesce(reg.instruction, '') as instruction, coalesce(reg.flag, true) as cross_batch
from fx_examples x left join reg using (dataset)
""")
def training_view(spark, d):
    v = S.training_view(T.fx_examples(spark, d), registry_for(spark), 1, 1, seed=0)
    return v.select("dataset", "row_id", "query", joined("positive"), joined("negative"), "instruction", "cross_batch")


_VPLAN = _plan_sql(False).replace("fx_examples", "vx").replace("dataset", "ds")


@register("hard_pair_mining", "with vx as (select 'v' as ds, vec_id as row_id, cluster from fx_vectors), p as (" + _VPLAN.strip() + """),
b as (select p.batch_order, p.row_id as id, v.cluster, v.embedding from p join fx_vectors v on v.vec_id = p.row_id),
s as (select a.batch_order, a.id as anchor, o.id as other, a.cluster = o.cluster as same,
             list_sum(list_transform(list_zip(a.embedding, o.embedding), lambda z: z[1]::double * z[2]::double))
             / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double)))
                * sqrt(list_sum(list_transform(o.embedding, lambda x: x::double * x::double)))) as sim
      from b a join b o on a.batch_order = o.batch_order and a.id <> o.id),
m as (select batch_order, anchor, min(case when same then sim end) as min_pos, max(case when not same then sim end) as max_neg
      from s group by batch_order, anchor)
select s.batch_order, s.anchor, s.other, case when s.same then 'positive' else 'negative' end as kind, round(s.sim, 6) as sim
from s join m using (batch_order, anchor)
where (not s.same and m.min_pos is not null and s.sim + 0.25 > m.min_pos)
   or (s.same and m.max_neg is not null and s.sim - 0.25 < m.max_neg)
""")
def hard_pair_mining(spark, d):
    v = T.fx_vectors(spark, d).withColumn("ds", F.lit("v")).withColumnRenamed("vec_id", "row_id")
    p = BT.plan_batches(v, B, seed=SEED, epoch=0, dataset="ds").select("batch_order", "row_id")
    j = p.join(v.select("row_id", "cluster", "embedding"), "row_id")
    m = BT.hard_pair_mining(j, "batch_order", "row_id", "cluster", "embedding", 0.25)
    return m.select("batch_order", "anchor", "other", "kind", F.round("sim", 6).alias("sim"))
