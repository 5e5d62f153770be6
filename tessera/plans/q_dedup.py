"""Registered queries: near-duplicate removal over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import dedup as D
from tessera.operators.components import connected_components
from tessera.operators.ranking import dense_index
from tessera.plans.catalog import register
from tessera.sources import tables as T

NONWORD = "'[^\\p{L}\\p{N}_]'"

# Parameters of the registered queries: 1000 permutations at 0.8, as all
# callers set them, and the defaults of the function (250 at 0.7) for the
# other hash widths.
FULL = D.REFERENCE_CALLER
WIDTHS = {
    "16": D.MinHashConfig(hash_func="md5", hash_bits=16),
    "32": D.MinHashConfig(hash_func="sha1", hash_bits=32),
    "64": D.MinHashConfig(hash_func="sha1", hash_bits=64),
    "xxh3": D.MinHashConfig(hash_func="xxh3", hash_bits=64),
}


def _sig_sql(num_perm: int, seed: int = 42, func: str = "md5", bits: int = 28) -> str:
    prime, most = D.HASH_WIDTHS[bits]
    digits = 16 if bits == 64 else 8
    value = f"(p.a * h.h + p.b) % {prime}"
    if bits in (32, 64):  # wider than 64 bits
        value = f"(((p.a::HUGEINT * h.h + p.b) % {prime})::BIGINT & {most})"
    return f"""
w as (select doc_id as id, regexp_split_to_array(lower(text), {NONWORD}) as w from documents),
f as (select * from w where len(w) >= 5),
s as (select id, case when len(w) < 5 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as sh from f),
h as (select distinct id, ('0x' || substr({func}(unnest(sh)), 1, {min(bits, 32) // 4}))::UBIGINT::BIGINT as h from s),
p as (select i as perm,
             1 + (('0x' || substr(md5('{seed}:a:' || i), 1, {digits}))::UBIGINT % {prime - 1})::BIGINT as a,
             (('0x' || substr(md5('{seed}:b:' || i), 1, {digits}))::UBIGINT % {prime})::BIGINT as b
      from range(0, {num_perm}) t(i)),
sig as (select h.id, p.perm, min({value}) as v from h, p group by h.id, p.perm)"""


def _edges_sql(cfg) -> str:
    b, r = cfg.band_rows()
    return _sig_sql(cfg.num_perm, cfg.seed) + f""",
bk as (select id, perm // {r} as band, list(v order by perm) as key from sig where perm < {b * r} group by id, perm // {r}),
bu as (select band, key, min(id) as root from bk group by band, key having count(*) > 1),
edges as (select distinct bk.id as src, bu.root as dst from bk join bu using (band, key) where bk.id <> bu.root)"""


def _components_sql(edge_cte: str) -> str:
    return edge_cte + """,
und as (select src as a, dst as b from edges union select dst, src from edges),
cc(node, comp) as (select a, a from und union select und.b, cc.comp from cc join und on und.a = cc.node),
comps as (select node, min(comp) as component from cc group by node)"""


def _clusters_sql(cfg) -> str:
    return "with recursive " + _components_sql(_edges_sql(cfg).lstrip()) + """,
clusters as (select f.id, coalesce(c.component, f.id) as cluster from f left join comps c on c.node = f.id)"""


@register("word_split", f"""
select doc_id, cast(len(regexp_split_to_array(lower(text), {NONWORD})) as bigint) as n_pieces,
       array_to_string(regexp_split_to_array(lower(text), {NONWORD}), chr(31)) as pieces
from documents
""")
def word_split(spark, d):
    w = tx.word_pieces("text")
    return T.table(spark, d, "documents").select(
        "doc_id", F.size(w).cast("bigint").alias("n_pieces"), F.array_join(w, "\x1f").alias("pieces"))


@register("word_shingles", "with " + _sig_sql(1).lstrip() + """
select id as doc_id, unnest(sh) as shingle from s
""")
def word_shingles(spark, d):
    docs = D.spread(T.table(spark, d, "documents").select("doc_id", tx.word_pieces("text").alias("w")))
    docs = docs.where(F.size("w") >= 5)
    return docs.select("doc_id", F.explode(tx.word_ngrams("w", 5, 5)).alias("shingle"))


@register("shingle_hash", "with " + _sig_sql(1).lstrip() + """
, hh as (select id, ('0x' || substr(md5(unnest(sh)), 1, 7))::UBIGINT::BIGINT as h from s)
select id as doc_id, count(*) as n_shingles, min(h) as min_hash, cast(sum(h) as bigint) as sum_hash from hh group by id
""")
def shingle_hash(spark, d):
    docs = D.spread(T.table(spark, d, "documents").select("doc_id", tx.word_pieces("text").alias("w")))
    docs = docs.where(F.size("w") >= 5)
    hs = docs.select("doc_id", F.explode(D.shingle_hashes("w", 5, 5)).alias("h"))
    return hs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shingles"), F.min("h").alias("min_hash"),
                                    F.sum("h").alias("sum_hash"))


SIGNATURES = """
select id as doc_id, count(*) as n_values, cast(min(v) as bigint) as min_value,
       md5(array_to_string(list(v order by perm), ',')) as signature_md5
from sig group by id
"""


def _signatures(spark, d, cfg):
    """One row per document: size, smallest value and digest of its signature."""
    s = D.minhash_signature(T.table(spark, d, "documents"), "doc_id", "text", cfg)
    return s.select(F.col("id").alias("doc_id"), F.size("signature").cast("bigint").alias("n_values"),
                    F.array_min("signature").alias("min_value"), _digest("signature").alias("signature_md5"))


def _digest(values):
    return F.md5(F.array_join(F.transform(values, lambda x: x.cast("string")), ","))


@register("minhash_signature", "with " + _sig_sql(FULL.num_perm).lstrip() + SIGNATURES)
def minhash_signature(spark, d):
    return _signatures(spark, d, FULL)


def _sig_width_sql(cfg) -> str:
    return "with " + _sig_sql(cfg.num_perm, cfg.seed, cfg.hash_func, cfg.hash_bits).lstrip() + SIGNATURES


@register("minhash_signature_16", _sig_width_sql(WIDTHS["16"]))
def minhash_signature_16(spark, d):
    """16 bits of md5, modulus 2^16 - 15."""
    return _signatures(spark, d, WIDTHS["16"])


@register("minhash_signature_32", _sig_width_sql(WIDTHS["32"]))
def minhash_signature_32(spark, d):
    """32 bits of sha1, modulus 2^32 - 5."""
    return _signatures(spark, d, WIDTHS["32"])


@register("minhash_signature_64", _sig_width_sql(WIDTHS["64"]))
def minhash_signature_64(spark, d):
    """32 bits of sha1, modulus 2^61 - 1, low 32 bits of the values."""
    return _signatures(spark, d, WIDTHS["64"])


@register("minhash_signature_xxh3")
def minhash_signature_xxh3(spark, d):
    """32 bits of xxh3, modulus 2^61 - 1 (DuckDB has no xxh3: tests compare
    with whole-number Python)."""
    return _signatures(spark, d, WIDTHS["xxh3"])


@register("lsh_bands", "with " + _sig_sql(FULL.num_perm).lstrip() + f"""
select id as doc_id, perm // {FULL.band_rows()[1]} as band,
       md5(array_to_string(list(v order by perm), ',')) as band_md5
from sig where perm < {FULL.band_rows()[0] * FULL.band_rows()[1]} group by id, perm // {FULL.band_rows()[1]}
""")
def lsh_bands(spark, d):
    """Every band of every document, its values as a digest."""
    s = D.minhash_signature(T.table(spark, d, "documents"), "doc_id", "text", FULL)
    n, r = FULL.band_rows()
    b = s.select(F.col("id").alias("doc_id"), F.posexplode(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _digest(F.slice("signature", i * r + 1, r)))
    ).alias("band", "band_md5"))
    return b.select("doc_id", F.col("band").cast("bigint").alias("band"), "band_md5")


@register("lsh_star_edges", "with " + _edges_sql(FULL).lstrip() + """
select src, dst from edges
""")
def lsh_star_edges(spark, d):
    b, r = FULL.band_rows()
    s = D.minhash_signature(T.table(spark, d, "documents"), "doc_id", "text", FULL)
    return D.lsh_star_edges(D.lsh_bands(s, b, r))


@register("connected_components", _components_sql("with recursive " + _edges_sql(FULL).lstrip()) + """
select node, component from comps
""")
def connected_components_q(spark, d):
    b, r = FULL.band_rows()
    s = D.minhash_signature(T.table(spark, d, "documents"), "doc_id", "text", FULL)
    return connected_components(D.lsh_star_edges(D.lsh_bands(s, b, r)), "src", "dst")


@register("near_dup_clusters", _clusters_sql(FULL) + """
select id as doc_id, cluster from clusters
""")
def near_dup_clusters(spark, d):
    res = D.near_dup_clusters(T.table(spark, d, "documents"), "doc_id", "text", FULL)
    return res.clusters.select(F.col("id").alias("doc_id"), "cluster")


@register("dedup_keep_representative", _clusters_sql(FULL) + """
select d.doc_id, d.lang, d.source from documents d join clusters c on c.id = d.doc_id where c.id = c.cluster
""")
def dedup_keep_representative(spark, d):
    return D.dedup(T.table(spark, d, "documents"), "doc_id", "text", FULL).select("doc_id", "lang", "source")


@register("dedup_report", _clusters_sql(FULL) + f""",
reps as (select min(doc_id) as id from documents join f on f.id = doc_id group by md5(text)),
rbk as (select bk.* from bk join reps using (id)),
rbu as (select band, key, min(id) as root from rbk group by band, key having count(*) > 1),
red as (select distinct rbk.id as src, rbu.root as dst from rbk join rbu using (band, key) where rbk.id <> rbu.root)
select (select count(*) from red) + (select count(*) from f) - (select count(*) from reps) as n_edges, count(*) as n_before, cast(sum(case when id = cluster then 1 else 0 end) as bigint) as n_after,
       count(distinct cluster) as n_clusters, cast({FULL.band_rows()[0]} as bigint) as n_bands from clusters
""")
def dedup_report(spark, d):
    return D.dedup_report(T.table(spark, d, "documents"), "doc_id", "text", FULL)


def _kept_sql(column: str, rows: str) -> str:
    source = f"from (select row_id as doc_id, {column} as text from {rows}) documents"
    return _clusters_sql(FULL).replace("from documents", source) + " select id as row_id from clusters where id = cluster"


@register("dedup_columns", f"""
with ex as (select row_id, query, array_to_string(positive, ' ') as context from fx_examples where len(positive) > 0),
k1 as ({_kept_sql('query', 'ex')}),
k2 as ({_kept_sql('context', 'ex join k1 using (row_id)')})
select row_id from k2
""")
def dedup_columns(spark, d):
    """Query column first, then the joined positives: whole rows removed."""
    ex = T.fx_examples(spark, d).where(F.size("positive") > 0).select("row_id", "query", F.array_join("positive", " ").alias("context"))
    return D.dedup_columns(ex, "row_id", ["query", "context"], FULL).select("row_id")


@register("row_index", """
select cast(row_number() over (order by lang, doc_id) - 1 as bigint) as idx, doc_id from documents
""")
def row_index(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "lang")
    return dense_index(docs, ["lang", "doc_id"], out="idx").select("idx", "doc_id")
