"""Registered queries: projections, filters, set operations, aggregates
(P1-P12, U1, U3, A1-A4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import builders as B
from tessera.operators import filters as P
from tessera.operators.ranking import rank_in_group
from tessera.plans.catalog import joined, register
from tessera.sources import tables as T

WORDS_SQL = "(case when trim(regexp_replace({c}, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ')) end)"
PIECES_SQL = "len(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]'))"


@register("keep_columns", """
select query, array_to_string(positive, chr(31)) as positive, array_to_string(negative, chr(31)) as negative from fx_examples
""")
def keep_columns(spark, d):
    k = P.keep_columns(T.fx_examples(spark, d), ["query", "positive", "negative"])
    return k.select("query", joined("positive"), joined("negative"))


@register("length_between", """
select doc_id, cast(length(text) as bigint) as n_chars from fx_grouped where length(text) > 100 and length(text) < 2000
""")
def length_between(spark, d):
    return P.length_between(T.fx_grouped(spark, d), "text", 100, 2000).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"))


@register("min_word_filter", f"""
select doc_id, cast({PIECES_SQL.format(c='text')} as bigint) as n_pieces from documents where {PIECES_SQL.format(c='text')} >= 5
""")
def min_word_filter(spark, d):
    return P.min_word_filter(T.table(spark, d, "documents"), "text", 5).select(
        "doc_id", tx.n_word_pieces("text").cast("bigint").alias("n_pieces"))


@register("require_pos_neg", """
select row_id, cast(len(positive) as bigint) as n_positive, cast(len(negative) as bigint) as n_negative
from fx_examples where len(positive) > 0 and len(negative) > 0
""")
def require_pos_neg(spark, d):
    return P.require_pos_neg(T.fx_examples(spark, d)).select(
        "row_id", F.size("positive").cast("bigint").alias("n_positive"),
        F.size("negative").cast("bigint").alias("n_negative"))


@register("gated_short_query_filter", f"""
with k as (select * from fx_examples where len(positive) > 0 and len(negative) > 0)
select row_id, query from (select *, count(*) over (partition by dataset) as n from k) where n <= 1000 or {WORDS_SQL.format(c='query')} > 3
""")
def gated_short_query_filter(spark, d):
    k = P.require_pos_neg(T.fx_examples(spark, d))
    return P.gated_short_query_filter(k, "query", 1000, 3).select("row_id", "query")


@register("clean_funnel", f"""
select dataset, count(*) as n_rows,
  cast(sum(case when len(positive) > 0 then 1 else 0 end) as bigint) as n_with_positive,
  cast(sum(case when len(positive) > 0 and len(negative) > 0 then 1 else 0 end) as bigint) as n_with_negative,
  cast(case when sum(case when len(positive) > 0 and len(negative) > 0 then 1 else 0 end) > 1000
       then sum(case when len(positive) > 0 and len(negative) > 0 and {WORDS_SQL.format(c='query')} > 3 then 1 else 0 end)
       else sum(case when len(positive) > 0 and len(negative) > 0 then 1 else 0 end) end as bigint) as n_final
from fx_examples group by dataset
""")
def clean_funnel(spark, d):
    return P.clean_funnel(T.fx_examples(spark, d), "dataset")


@register("label_equals", "select doc_id, text from fx_labelled where label = 0")
def label_equals(spark, d):
    return P.label_equals(T.fx_labelled(spark, d), "label", 0).select("doc_id", "text")


@register("score_threshold", "select id, gold from fx_sts where gold >= 3")
def score_threshold(spark, d):
    return P.score_threshold(T.fx_sts(spark, d), "gold", 3.0).select("id", "gold")


@register("assert_single_positive", """
select count(*) as n_rows, 1 as min_positive, 1 as max_positive, true as ok from fx_pairs
""")
def assert_single_positive(spark, d):
    pairs = B.build_pairs(T.fx_pairs(spark, d), "query", "positive")
    return P.assert_single_positive(pairs).select(
        "n_rows", F.col("min_positive").cast("int").alias("min_positive"),
        F.col("max_positive").cast("int").alias("max_positive"), "ok")


@register("min_group_size", """
select doc_id, categories from fx_grouped where categories in
  (select categories from fx_grouped group by categories having count(*) >= 5)
""")
def min_group_size(spark, d):
    return P.min_group_size(T.fx_grouped(spark, d), "categories", 5).select("doc_id", "categories")


@register("select_rows_by_id", """
select row_id, query from fx_examples where row_id in (select doc_id from fx_labelled)
""")
def select_rows_by_id(spark, d):
    ids = T.fx_labelled(spark, d).select(F.col("doc_id").alias("row_id"))
    return P.select_rows_by_id(T.fx_examples(spark, d), ids, "row_id").select("row_id", "query")


_LANGS = ["ar", "bn", "de", "en", "es", "fa", "fi", "fr", "hi", "id", "ja", "ko", "ru", "sw", "te", "th", "vi", "yo", "zh"]


@register("skip_empty_datasets", f"""
with reg as (select unnest([{", ".join(repr(x) for x in _LANGS)}]) as dataset)
select reg.dataset, count(*) as n_rows from reg join fx_examples e on e.dataset = reg.dataset group by reg.dataset
""")
def skip_empty_datasets(spark, d):
    reg = spark.createDataFrame([(x,) for x in _LANGS], "dataset string")
    return P.skip_empty_datasets(reg, T.fx_examples(spark, d), "dataset")


@register("concat_datasets", """
select doc_id, text, label_text from fx_labelled where split = 'train'
union all by name
select doc_id, text, split from fx_labelled where split = 'test'
""")
def concat_datasets(spark, d):
    lab = T.fx_labelled(spark, d)
    tr = lab.where(F.col("split") == "train").select("doc_id", "text", "label_text")
    te = lab.where(F.col("split") == "test").select("doc_id", "text", "split")
    return tr.unionByName(te, allowMissingColumns=True)


@register("distinct_ids", """
select vec_id, array_to_string(list_sort(list_distinct(positive_ids || positive_ids)), ',') as ids from fx_vec_queries
""")
def distinct_ids(spark, d):
    q = T.fx_vec_queries(spark, d)
    ids = F.array_sort(F.array_distinct(F.concat("positive_ids", "positive_ids")))
    return q.select("vec_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@register("group_collect", """
select category, cast(row_number() over (partition by category order by doc_id) as bigint) as rn, doc_id from fx_grouped
""")
def group_collect(spark, d):
    """Group -> ordered members, in long form ``(group, rank, member)``: the
    ordered list without building a whole-group array in one task."""
    g = T.fx_grouped(spark, d).select("category", "doc_id")
    return rank_in_group(g, ["category"], ["doc_id"], out="rn").select("category", "rn", "doc_id")


@register("label_vocabulary", "select distinct label_text from fx_labelled")
def label_vocabulary(spark, d):
    return T.fx_labelled(spark, d).select("label_text").distinct()


@register("cluster_sizes", "select cluster, count(*) as n_rows from fx_examples group by cluster")
def cluster_sizes(spark, d):
    return T.fx_examples(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("n_rows", "cluster")


@register("dataset_sizes", "select dataset, count(*) as n_rows from fx_examples group by dataset")
def dataset_sizes(spark, d):
    return T.fx_examples(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
