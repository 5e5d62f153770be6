"""Registered queries: example builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import builders as B
from tessera.operators import filters as P
from tessera.plans.catalog import joined, register
from tessera.sources import tables as T

# fixed values: label id -> text of the five-level review scale
REVIEW_LABELS = {0: "Poor", 1: "Fair", 2: "Good", 3: "Very good", 4: "Excellent"}

MD5U = "((('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::UBIGINT) / 4294967296.0)"
CATS_SQL = "array_to_string(list_sort(list_distinct(list_transform(string_split({c}, ' '), lambda p: split_part(p, '.', 1)))), '; ')"


@register("build_pairs", """
select conv_id, turn, query, positive, 1::bigint as n_positive from fx_pairs
""")
def build_pairs(spark, d):
    b = B.build_pairs(T.fx_pairs(spark, d), "query", "positive", keep=("conv_id", "turn"))
    return b.select("conv_id", "turn", "query", joined("positive"), F.size("positive").cast("bigint").alias("n_positive"))


@register("build_pairs_from_set", "select conv_id, turn, query, positive from fx_pairs")
def build_pairs_from_set(spark, d):
    s = T.fx_pairs(spark, d).select("conv_id", "turn", F.array("query", "positive").alias("set"))
    b = B.build_pairs_from_set(s, "set", keep=("conv_id", "turn"))
    return b.select("conv_id", "turn", "query", joined("positive"))


@register("build_multi_positive_qa", """
with e as (select row_id, query, array_to_string(positive, ' ') as context,
                  dataset || '. ' || array_to_string(negative, ' ') as answer from fx_examples)
select row_id, query, context || chr(31) || answer as positive, answer || ' ' || context as full_answer from e
""")
def build_multi_positive_qa(spark, d):
    e = T.fx_examples(spark, d).withColumn("long_answer", F.array_join("negative", " "))
    b = B.build_multi_positive_qa(e, "query", "positive", "long_answer", decision="dataset", keep=("row_id",))
    return b.select("row_id", "query", joined("positive"), "full_answer")


@register("build_label_examples", """
with v as (select list_sort(list(distinct label_text)) as vocab from fx_labelled)
select doc_id, text as query, label_text as positive,
       array_to_string(list_filter(v.vocab, lambda x: x <> label_text), chr(31)) as negative
from fx_labelled, v
""")
def build_label_examples(spark, d):
    b = B.build_label_examples(T.fx_labelled(spark, d), "text", "label_text", keep=("doc_id",))
    return b.select("doc_id", "query", joined("positive"), joined("negative"))


@register("build_fixed_label_examples", """
with l as (select doc_id, text, (['Poor', 'Fair', 'Good', 'Very good', 'Excellent'])[label + 1] as lab from fx_labelled)
select doc_id, text as query, lab as positive,
       array_to_string(list_filter(['Excellent', 'Fair', 'Good', 'Poor', 'Very good'], lambda x: x <> lab), chr(31)) as negative
from l
""")
def build_fixed_label_examples(spark, d):
    b = B.build_fixed_label_examples(T.fx_labelled(spark, d), "text", "label", REVIEW_LABELS, keep=("doc_id",))
    return b.select("doc_id", "query", joined("positive"), joined("negative"))


@register("build_bitext_pairs", f"""
select item_id, case when {MD5U.format(parts="'0', 'bitext', cast(item_id as varchar)")} > 0.5 then t1 else t2 end as query,
       case when {MD5U.format(parts="'0', 'bitext', cast(item_id as varchar)")} > 0.5 then t2 else t1 end as positive
from fx_bitext
""")
def build_bitext_pairs(spark, d):
    bt = T.fx_bitext(spark, d).select("item_id", F.create_map(F.lit("a"), "t1", F.lit("b"), "t2").alias("translation"))
    b = B.build_bitext_pairs(bt, "translation", "item_id", seed=0, keep=("item_id",))
    return b.select("item_id", "query", joined("positive"))


@register("build_passage_examples", """
select row_id, query,
       array_to_string(list_transform(positive, lambda x: query || chr(10) || x), chr(31)) as positive,
       array_to_string(list_transform(negative, lambda x: query || chr(10) || x), chr(31)) as negative
from fx_examples where len(positive) > 0 and len(negative) > 0
""")
def build_passage_examples(spark, d):
    e = T.fx_examples(spark, d)
    mk = lambda c: F.transform(c, lambda x: F.struct(F.col("query").alias("title"), x.alias("text")))
    p = e.select("row_id", "query", mk(F.col("positive")).alias("positive_passages"),
                 mk(F.col("negative")).alias("negative_passages"))
    b = P.require_pos_neg(B.build_passage_examples(p, keep=("row_id",)))
    return b.select("row_id", "query", joined("positive"), joined("negative"))


@register("wrap_scalar_lists", """
select row_id, pos, query, p as positive, negative[pos % len(negative) + 1] as negative, 1::bigint as n_positive
from (select *, unnest(range(len(positive))) as pos, unnest(positive) as p from fx_examples where len(positive) > 0 and len(negative) > 0)
""")
def wrap_scalar_lists(spark, d):
    # every positive with a negative; negatives in turn, one fewer at most
    e = P.require_pos_neg(T.fx_examples(spark, d)).select("row_id", "query", F.posexplode("positive").alias("pos", "positive"), "negative")
    e = e.withColumn("negative", F.expr("negative[pos % size(negative)]"))
    w = B.wrap_scalar_lists(e)
    return w.select("row_id", F.col("pos").cast("bigint").alias("pos"), "query", joined("positive"), joined("negative"),
                    F.size("positive").cast("bigint").alias("n_positive"))


_B10_SQL = f"""
with g as (select * from fx_grouped where categories in (select categories from fx_grouped group by categories having count(*) >= 5)),
r as (select categories, doc_id, text, row_number() over (partition by categories order by doc_id) as rn from g),
c as (select *, cast(floor((rn - 1) / 32) as bigint) as chunk from r where rn <= 3000),
k as (select categories, chunk, row_number() over (partition by categories order by md5(concat_ws(':', '0', 'chunk', categories, cast(chunk as varchar))), chunk) as kk
      from (select distinct categories, chunk from c)),
m as (select c.categories, c.chunk, list(c.text order by c.rn) as l from c join k using (categories, chunk) where k.kk <= 16 group by c.categories, c.chunk)
select categories, chunk, l[1] as query, array_to_string(l[2:], chr(31)) as positive, cast(len(l) - 1 as bigint) as n_positive,
       {CATS_SQL.format(c='categories')} as cluster
from m
"""


@register("build_chunked_cluster_examples", _B10_SQL)
def build_chunked_cluster_examples(spark, d):
    g = P.min_group_size(T.fx_grouped(spark, d), "categories", 5)
    b = B.build_chunked_cluster_examples(g, "text", "categories", "doc_id", cap=3000, chunk=32, max_chunks=16,
                                         seed=0, cluster_expr=tx.category_prefixes)
    return b.select("categories", "chunk", "query", joined("positive"),
                    F.size("positive").cast("bigint").alias("n_positive"), "cluster")


@register("classification_to_clustering", """
with b as (select doc_id, text, label_text, md5(concat_ws(':', '0', 'ring', cast(doc_id as varchar))) as ok from fx_labelled),
r as (select *, row_number() over (partition by label_text order by ok, doc_id) - 1 as rr, count(*) over (partition by label_text) as n from b),
o as (select doc_id, label_text, rr, n, unnest(range(1, least(16, n - 1) + 1)) as k from r where n > 1),
p as (select o.doc_id, list(m.text order by o.k) as l from o join r m on m.label_text = o.label_text and m.rr = (o.rr + o.k) % o.n group by o.doc_id)
select r.doc_id, r.text as query, coalesce(array_to_string(p.l, chr(31)), '') as positive, cast(coalesce(len(p.l), 0) as bigint) as n_positive,
       r.label_text as cluster
from r left join p using (doc_id)
""")
def classification_to_clustering(spark, d):
    b = B.classification_to_clustering(T.fx_labelled(spark, d), "text", "label_text", "doc_id", window=16, seed=0)
    return b.select("doc_id", "query", joined("positive"), F.size("positive").cast("bigint").alias("n_positive"), "cluster")


@register("flatten_parallel_arrays", """
select conv_id, unnest(range(len(sentences))) as pos, unnest(sentences) as sentence, unnest(labels) as label from fx_parallel
""")
def flatten_parallel_arrays(spark, d):
    f = B.flatten_parallel_arrays(T.fx_parallel(spark, d), keep=("conv_id",))
    return f.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "sentence", "label")


@register("flatten_positives_corpus", """
select row_id, unnest(range(len(positive))) as pos, unnest(positive) as text from fx_examples
""")
def flatten_positives_corpus(spark, d):
    f = B.flatten_positives_corpus(T.fx_examples(spark, d))
    return f.select("row_id", F.col("pos").cast("bigint").alias("pos"), "text")


@register("flatten_cluster_corpus", """
select row_id, cluster, unnest(range(len(positive) + 1)) as pos, unnest([query] || positive) as text from fx_examples
""")
def flatten_cluster_corpus(spark, d):
    f = B.flatten_cluster_corpus(T.fx_examples(spark, d))
    return f.select("row_id", "cluster", F.col("pos").cast("bigint").alias("pos"), "text")


@register("normalize_categories", f"select doc_id, {CATS_SQL.format(c='categories')} as cluster from fx_grouped")
def normalize_categories(spark, d):
    return T.fx_grouped(spark, d).select("doc_id", B.normalize_categories("categories").alias("cluster"))
