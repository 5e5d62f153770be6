"""Registered queries: recipes, mined negative texts, in-batch pairs and the
row-producing clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import alignment as AL
from tessera.operators import batching as BT
from tessera.operators import dedup as D
from tessera.operators import filters as P
from tessera.operators import knn as K
from tessera.operators import sampling as S
from tessera.operators.ranking import dense_index
from tessera.plans import registry as REG
from tessera.plans.catalog import joined, register
from tessera.plans.q_builders import CATS_SQL, MD5U
from tessera.plans.q_dedup import FULL, _kept_sql, _clusters_sql, _edges_sql, _sig_sql
from tessera.plans.q_eval import _values
from tessera.plans.q_retrieval import _B9_SQL, _tables
from tessera.plans.q_sampling import _SAMPLE_ARR, _plan_sql
from tessera.plans.q_vectors import _corpus, _pairs_sql, _qvecs
from tessera.plans.recipes import MIRACL, RECIPES, build_examples, run_recipe
from tessera.sources import tables as T


def _dedup_sql(table: str, key: str, text: str) -> str:
    rows = f"from (select {key} as doc_id, {text} as text from {table}) documents"
    return _clusters_sql(FULL).replace("from documents", rows) + " select id from clusters where id = cluster"


@register("recipe_beir", f"""
with kc as ({_dedup_sql('fx_corpus', '_id', 'text')}), kq as ({_dedup_sql('fx_queries', '_id', 'text')}),
""" + _B9_SQL.strip()[len("with "):].replace("from fx_corpus)", "from fx_corpus where _id in (select id from kc))").replace(
    "join fx_queries fq on", "join (select * from fx_queries where _id in (select id from kq)) fq on"))
def recipe_beir(spark, d):
    qrels, corpus, queries = _tables(spark, d)
    ex = build_examples(RECIPES["beir"], {"qrels": qrels, "corpus": corpus, "queries": queries})
    return ex.select("query_id", "query", joined("positive_ids"),
                     F.size("positive_ids").cast("bigint").alias("n_positive_ids"),
                     joined("positive"), F.size("positive").cast("bigint").alias("n_positive"))


@register("recipe_qa_pairs", "select conv_id, turn, query, positive from fx_pairs where length(query) > 0")
def recipe_qa_pairs(spark, d):
    return run_recipe(RECIPES["qa_pairs"], {"rows": T.fx_pairs(spark, d)}).select("conv_id", "turn", "query", joined("positive"))


_STRIP_SQL = "regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def _counts_sql(name: str, key: str, text: str, rows: str) -> str:
    """CTEs ``{name}v(key, dim, n)`` and ``{name}s(key, s)``: hashed word counts and their squared length."""
    return f"""
{name}w as (select {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) as w from {rows}),
{name}v as (select {key}, ('0x' || substr(md5(w), 1, 8))::UBIGINT::BIGINT % 64 as dim, count(*) as n from {name}w group by all),
{name}s as (select {key}, sum(n * n) as s from {name}v group by {key})"""


def _mined_sql(k: int, skip: int, take: int | None, drop: str = "false") -> str:
    """CTEs over ``e(row_id, query, ...)`` and ``c(cid, text, ...)`` up to
    ``neg(row_id, n, m)``: the texts that mining leaves over."""
    last = f" and rr <= {skip + take}" if take else ""
    return (_counts_sql("c", "cid", "'passage: ' || text", "c") + "," + _counts_sql("q", "row_id", "'query: ' || query", "e") + f""",
dot as (select row_id, cid, sum(qv.n * cv.n) as d from qv join cv using (dim) group by row_id, cid),
near as (select qs.row_id, cs.cid, row_number() over (partition by qs.row_id order by qs.s + cs.s - 2 * coalesce(dot.d, 0), cs.cid) as rank
         from qs cross join cs left join dot on dot.row_id = qs.row_id and dot.cid = cs.cid),
left_over as (select near.row_id, c.text, row_number() over (partition by near.row_id order by rank) as rr
              from near join c using (cid) join e on e.row_id = near.row_id where rank <= {k} and not ({drop})),
neg as (select row_id, count(*) as n, md5(string_agg({_STRIP_SQL.format(c='text')}, chr(31) order by rr)) as m
        from left_over where rr > {skip}{last} group by row_id)""")


_NEG_COLS = "coalesce(neg.n, 0) as n_negative, coalesce(neg.m, md5('')) as negative_md5"


def _digest(df, *keep):
    return df.select(*keep, F.size("negative").cast("bigint").alias("n_negative"),
                     F.md5(F.array_join("negative", "\x1f")).alias("negative_md5"))


def _within_sql(column: str, rows: str, langs) -> str:
    """Rows of ``rows`` that stay when copies are removed within each language."""
    return " union all ".join(f"select row_id from ({_kept_sql(column, f'(select * from {rows} where lang = {lang!r})')})" for lang in langs)


@register("recipe_squad", f"""
with r as (select cast(row_number() over (order by conv_id, turn) - 1 as bigint) as row_id, query, positive from fx_pairs),
k as ({_kept_sql('query', 'r')}),
e as (select * from r where row_id in (select row_id from k)),
c0 as (select cast(row_number() over (order by row_id) - 1 as bigint) as cid, positive as text from e),
ck as ({_dedup_sql('c0', 'cid', 'text')}),
c as (select * from c0 where cid in (select id from ck)),
""" + _mined_sql(128, 30, None) + f"""
select e.row_id, query, positive, {_NEG_COLS} from e left join neg using (row_id)
""")
def recipe_squad(spark, d):
    """Question and passage pairs: near copies of a question go, negatives are mined among all passages."""
    rows = dense_index(T.fx_pairs(spark, d), ["conv_id", "turn"], out="row_id").select(
        "row_id", F.col("query").alias("question"), F.col("positive").alias("context"))
    return _digest(run_recipe(RECIPES["squad"], {"rows": rows}), "row_id", "query", joined("positive"))


@register("recipe_arxiv_abstracts", f"""
with r as (select doc_id as row_id, text, categories from fx_grouped where length(text) > 100 and length(text) < 2000),
k0 as ({_kept_sql('text', 'r')}),
g0 as (select * from r where row_id in (select row_id from k0)),
g as (select * from g0 where categories in (select categories from g0 group by categories having count(*) >= 5)),
b as (select *, cast(floor((row_number() over (partition by categories order by row_id) - 1) / 32) as bigint) as chunk,
             row_number() over (partition by categories order by row_id) as rn from g),
kk as (select categories, chunk, row_number() over (partition by categories order by md5(concat_ws(':', '0', 'chunk', categories, cast(chunk as varchar))), chunk) as kk
       from (select distinct categories, chunk from b where rn <= 3000)),
m as (select categories, chunk, list(text order by rn) as l from b join kk using (categories, chunk) where rn <= 3000 and kk.kk <= 16 group by categories, chunk),
e as (select cast(row_number() over (order by categories, chunk) - 1 as bigint) as row_id, l[1] as query, l[2:] as positive,
             {CATS_SQL.format(c='categories')} as cluster from m),
c0 as (select cast(row_number() over (order by row_id, pos) - 1 as bigint) as cid, text, cluster
       from (select row_id, cluster, unnest(range(len(positive) + 1)) as pos, unnest([query] || positive) as text from e)),
ck as ({_dedup_sql('c0', 'cid', 'text')}),
c as (select * from c0 where cid in (select id from ck)),
""" + _mined_sql(2048, 20, 120, "c.cluster = e.cluster") + f"""
select e.row_id, query, array_to_string(positive, chr(31)) as positive, cluster, {_NEG_COLS} from e left join neg using (row_id)
""")
def recipe_arxiv_abstracts(spark, d):
    """Texts of a length range, near copies gone, in chunks of their category; negatives come from other categories."""
    rows = T.fx_grouped(spark, d).select(F.col("doc_id").alias("row_id"), F.col("text").alias("abstract"), F.col("categories").alias("category"))
    return _digest(run_recipe(RECIPES["arxivP2P"], {"rows": rows}), "row_id", "query", joined("positive"), "cluster")


_BEIR_SQL = _B9_SQL.strip()[len("with "):].replace("from fx_corpus)", "from fx_corpus where _id in (select id from kc))").replace(
    "join fx_queries fq on", "join (select * from fx_queries where _id in (select id from kq)) fq on")


@register("recipe_beir_mined", f"""
with kc as ({_dedup_sql('fx_corpus', '_id', 'text')}), kq as ({_dedup_sql('fx_queries', '_id', 'text')}),
ex as (with {_BEIR_SQL}),
e as (select *, cast(row_number() over (order by query_id) - 1 as bigint) as row_id from ex),
c as (select _id, cast(row_number() over (order by _id) - 1 as bigint) as cid, {_STRIP_SQL.format(c="coalesce(title, '') || ' ' || coalesce(text, '')")} as text
      from fx_corpus where _id in (select id from kc)),
""" + _mined_sql(128, 30, None, "list_contains(string_split(e.positive_ids, chr(31)), c._id)") + f"""
select query_id, query, positive, {_NEG_COLS} from e left join neg using (row_id)
""")
def recipe_beir_mined(spark, d):
    """Judged queries with passages, negatives from the same corpus without the judged ones."""
    qrels, corpus, queries = _tables(spark, d)
    out = run_recipe(RECIPES["beir"], {"qrels": qrels, "corpus": corpus, "queries": queries})
    return _digest(out, "query_id", "query", joined("positive"))


@register("recipe_imdb", f"""
with r as (select doc_id as row_id, text as query, label_text from fx_labelled),
v as (select list_sort(list(distinct label_text)) as vocab from r),
k as ({_kept_sql('query', 'r')})
select row_id, query, label_text as positive, array_to_string(list_filter(v.vocab, lambda x: x <> label_text), chr(31)) as negative
from r, v where row_id in (select row_id from k)
""")
def recipe_imdb(spark, d):
    """Labelled texts of all splits: the other labels are the negatives."""
    rows = T.fx_labelled(spark, d).withColumnRenamed("doc_id", "row_id")
    return run_recipe(RECIPES["imdb"], {"rows": rows}).select("row_id", "query", joined("positive"), joined("negative"))


@register("recipe_nllb", f"""
with r0 as (select item_id as row_id, {MD5U.format(parts="'0', 'bitext', cast(item_id as varchar)")} > 0.5 as fwd, t1, t2 from fx_bitext),
r as (select row_id, case when fwd then t1 else t2 end as query, case when fwd then t2 else t1 end as positive from r0),
k1 as ({_kept_sql('query', 'r')}),
k2 as ({_kept_sql('positive', 'r join k1 using (row_id)')}),
e as (select * from r where row_id in (select row_id from k2)),
c0 as (select cast(row_number() over (order by row_id) - 1 as bigint) as cid, positive as text from e),
ck as ({_dedup_sql('c0', 'cid', 'text')}),
c as (select * from c0 where cid in (select id from ck)),
""" + _mined_sql(128, 30, None) + f"""
select e.row_id, query, positive, {_NEG_COLS} from e left join neg using (row_id)
""")
def recipe_nllb(spark, d):
    """Translation pairs in a random direction, copies of either side gone, mined among the second sides."""
    rows = T.fx_bitext(spark, d).select(F.col("item_id").alias("row_id"),
                                        F.create_map(F.lit("a"), "t1", F.lit("b"), "t2").alias("translation"))
    return _digest(run_recipe(RECIPES["nllb"], {"rows": rows}), "row_id", "query", joined("positive"))


@register("recipe_miracl", f"""
with r as (select row_id, dataset as lang, query, list_transform(positive, lambda x: query || chr(10) || x) as positive,
                  list_transform(negative, lambda x: query || chr(10) || x) as negative
           from fx_examples where len(positive) > 0 and len(negative) > 0),
k as ({_within_sql('query', 'r', MIRACL)})
select row_id, lang, query, array_to_string(positive, chr(31)) as positive, array_to_string(negative, chr(31)) as negative
from r where row_id in (select row_id from k)
""")
def recipe_miracl(spark, d):
    """Passages with a title of all languages of the set, in one plan; copies of a query go within its language."""
    e = T.fx_examples(spark, d)
    titled = lambda c: F.transform(c, lambda x: F.struct(F.col("query").alias("title"), x.alias("text")))
    rows = e.select("row_id", F.col("dataset").alias("lang"), "query", titled(F.col("positive")).alias("positive_passages"),
                    titled(F.col("negative")).alias("negative_passages"))
    return run_recipe(RECIPES["miracl"], {"rows": rows}).select("row_id", "lang", "query", joined("positive"), joined("negative"))


@register("hard_negative_texts", "with " + _pairs_sql("l2") + """,
n as (select qid, cid, rank from rk where rank > 30 and rank <= 128),
t as (select doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as t from documents)
select qid, count(*) as n_negative, md5(string_agg(t, chr(31) order by rank)) as negative_md5 from n join t on t.doc_id = n.cid group by qid
""")
def hard_negative_texts(spark, d):
    """The negative texts of every query vector, in rank order; a vector's text
    is the document of its number."""
    neg = K.hard_negatives(_qvecs(spark, d), _corpus(spark, d), k=128, skip=30, metric="l2")
    texts = K.attach_negative_texts(neg, T.table(spark, d, "documents"), "doc_id", "text")
    return texts.select("qid", F.size("negative").cast("bigint").alias("n_negative"), F.md5(F.array_join("negative", "\x1f")).alias("negative_md5"))


@register("clean_dataset", """
with k as (select *, count(*) over (partition by dataset) as n from fx_examples where len(positive) > 0 and len(negative) > 0)
select dataset, row_id from k where n <= 100 or len(regexp_extract_all(query, '\\S+')) > 3
""")
def clean_dataset(spark, d):
    return P.clean_dataset(T.fx_examples(spark, d), gate=100).select("dataset", "row_id")


@register("select_retrieval_datasets", "with g as " + _values(
    [(lang, n) for lang, ns in REG.LANG_GROUPS.items() for n in (REG.EN_CROSS_BATCH if lang == "en" else ns)], ["lang", "name"]) + """
select distinct name from g where lang in (select distinct dataset from fx_examples)
""")
def select_retrieval_datasets(spark, d):
    langs = T.fx_examples(spark, d).select(F.col("dataset").alias("lang")).distinct()
    return AL.select_training_datasets(REG.lang_groups(spark), langs, retrieval_only=True)


_ITEMS_SQL = f"""
e as (select p.batch_order, x.row_id, len({_SAMPLE_ARR.format(arr='x.positive', tag='pos', k=1).replace('row_id', 'x.row_id')})
             + len({_SAMPLE_ARR.format(arr='x.negative', tag='neg', k=1).replace('row_id', 'x.row_id')}) as n,
             len({_SAMPLE_ARR.format(arr='x.positive', tag='pos', k=1).replace('row_id', 'x.row_id')}) as np
      from p join fx_examples x using (row_id)),
i as (select batch_order, row_id, np, unnest(range(n + 1)) as slot from e),
l as (select *, slot > np as own from i)
select a.batch_order, a.row_id as a_key, cast(a.slot as int) as a_slot, b.row_id as b_key, cast(b.slot as int) as b_slot,
       case when a.row_id = b.row_id and not a.own and not b.own then 'positive' else 'negative' end as kind
from l a join l b on a.batch_order = b.batch_order and not (a.row_id = b.row_id and a.slot = b.slot)"""


def _batched(spark, d):
    ex = T.fx_examples(spark, d)
    plan = BT.plan_batches(ex, 32, seed=777, epoch=0).select("batch_order", "row_id")
    one = ex.select("row_id", S.sample_array(F.col("positive"), 1, 0, "row_id", "pos").alias("positive"),
                    S.sample_array(F.col("negative"), 1, 0, "row_id", "neg").alias("negative"))
    return plan.join(one, "row_id")


@register("in_batch_pairs", "with p as (" + _plan_sql(False).strip() + ")," + _ITEMS_SQL)
def in_batch_pairs(spark, d):
    return BT.in_batch_pairs(_batched(spark, d), "batch_order", "row_id", "cross")


@register("in_example_pairs", "with p as (" + _plan_sql(False).strip() + ")," + _ITEMS_SQL + " and a.row_id = b.row_id")
def in_example_pairs(spark, d):
    return BT.in_batch_pairs(_batched(spark, d), "batch_order", "row_id", "local")


@register("shingle_hash_sha1", "with " + _sig_sql(1).lstrip() + """
, hh as (select id, ('0x' || substr(sha1(unnest(sh)), 1, 8))::UBIGINT::BIGINT as h from s)
select id as doc_id, min(h) as min_hash, max(h) as max_hash from hh group by id
""")
def shingle_hash_sha1(spark, d):
    docs = D.spread(T.table(spark, d, "documents").select("doc_id", tx.word_pieces("text").alias("w"))).where(F.size("w") >= 5)
    hs = docs.select("doc_id", F.transform(tx.word_ngrams("w", 5, 5), lambda s: tx.shingle_hash(s, "sha1", 32)).alias("h"))
    return hs.select("doc_id", F.array_min("h").alias("min_hash"), F.array_max("h").alias("max_hash"))


@register("near_dup_clusters_verified", "with recursive " + _sig_sql(1).lstrip() + """,
g as materialized (select id, hash(unnest(sh)) as g, len(sh) as n from s),
c as (select a.id as src, b.id as dst, count(*) as common, any_value(a.n + b.n) as n from g a join g b on a.g = b.g and a.id > b.id
      where least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) group by a.id, b.id),
v as (select src, dst from c where common >= 0.8 * (n - common)),
und as (select src as a, dst as b from v union select dst, src from v),
cc(node, comp) as (select a, a from und union select und.b, cc.comp from cc join und on und.a = cc.node),
comps as (select node, min(comp) as component from cc group by node)
select f.id as doc_id, coalesce(c.component, f.id) as cluster from f left join comps c on c.node = f.id
""")
def near_dup_clusters_verified(spark, d):
    """All pairs of texts with a similarity of 0.8."""
    return D.similar_clusters(T.table(spark, d, "documents"), "doc_id", "text", 0.8).select(F.col("id").alias("doc_id"), "cluster")
