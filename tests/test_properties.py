"""Unit and property tests for the quirks and invariants of SURVEY §0/§5."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import batching as BT
from tessera.operators import dedup as D
from tessera.operators import knn as K
from tessera.operators import sampling as S
from tessera.operators.components import connected_components
from tessera.operators.ranking import dense_index, rank_in_group, running_sum
from tessera.sources import tables as T

from conftest import SF_SMALL


def test_lsh_params_match_reference_settings():
    assert D.lsh_params(0.8, 1000) == (50, 20)
    assert D.lsh_params(0.7, 250) == (25, 10)


def test_word_pieces_keep_empty_and_unicode(spark):
    r = spark.createDataFrame([("Ä b.",), ("a  b",)], "t string").select(
        tx.n_word_pieces("t").alias("n")).collect()
    assert [x.n for x in r] == [3, 3]  # 'ä','b','' and 'a','','b'


def test_whitespace_words_empty_is_zero(spark):
    r = spark.createDataFrame([("",), ("  a b ",), ("x\ty",)], "t string").select(
        tx.whitespace_words("t").alias("n")).collect()
    assert [x.n for x in r] == [0, 2, 2]


def test_connected_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(400, 470)]  # a long path
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    comp = {}
    for x in nodes:
        comp.setdefault(find(x), []).append(x)
    expect = {x: min(m) for m in comp.values() for x in m}
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == expect


def test_dense_index_and_group_rank_match_windows(spark):
    docs = T.table(spark, SF_SMALL, "documents").select("doc_id", "lang")
    idx = dense_index(docs, ["lang", "doc_id"], out="i").toPandas().sort_values(["lang", "doc_id"])
    assert list(idx["i"]) == list(range(len(idx)))
    rk = rank_in_group(docs, ["lang"], ["doc_id"], out="rn", size_col="n").toPandas()
    rk = rk.sort_values(["lang", "doc_id"])
    exp = rk.groupby("lang").cumcount() + 1
    assert list(rk["rn"]) == list(exp)
    assert (rk.groupby("lang")["n"].transform("size") == rk["n"]).all()


def test_running_sum(spark):
    df = spark.range(0, 500).withColumn("v", (F.col("id") % 7).cast("long"))
    got = running_sum(df, ["id"], ["v"]).toPandas().sort_values("id")
    assert list(got["cum_v"]) == list(np.cumsum([i % 7 for i in range(500)]))
    assert list(got["_pos"]) == list(range(1, 501))


def test_knn_blocked_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    C = rng.normal(size=(300, 8))
    Q = rng.normal(size=(20, 8))
    cdf = spark.createDataFrame([(i, C[i].tolist()) for i in range(300)], "cid long, cvec array<double>")
    qdf = spark.createDataFrame([(i, Q[i].tolist()) for i in range(20)], "qid long, qvec array<double>")
    for metric in ("l2", "ip", "cosine"):
        got = K.knn_topk(qdf, cdf, 7, metric, buckets=5, query_blocks=3).toPandas()
        for q in range(20):
            if metric == "l2":
                s = ((C - Q[q]) ** 2).sum(1)
                order = np.lexsort((np.arange(300), s))[:7]
            else:
                CC = C / np.linalg.norm(C, axis=1, keepdims=True) if metric == "cosine" else C
                s = CC @ Q[q]
                order = np.lexsort((np.arange(300), -s))[:7]
            mine = got[got.qid == q].sort_values("rank")["cid"].tolist()
            assert mine == order.tolist(), (metric, q)


def test_hard_negatives_never_contain_excluded(spark):
    rng = np.random.default_rng(1)
    C = rng.normal(size=(200, 6))
    cdf = spark.createDataFrame([(i, C[i].tolist(), i % 5) for i in range(200)], "cid long, cvec array<double>, cl long")
    qdf = spark.createDataFrame([(i, C[i].tolist(), i % 5) for i in range(0, 200, 10)], "qid long, qvec array<double>, cl long")
    pos = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 10)], "qid long, cid long")
    n1 = K.hard_negatives(qdf, cdf, k=50, skip=5, exclusion="positive_ids", positives=pos).toPandas()
    assert not set(zip(n1.qid, n1.cid)) & {(i, i + 1) for i in range(0, 200, 10)}
    n2 = K.hard_negatives(qdf, cdf, k=50, skip=5, exclusion="same_cluster", q_cluster="cl", c_cluster="cl").toPandas()
    assert ((n2.qid % 5) != (n2.cid % 5)).all()


def test_batch_plan_is_permutation_minus_tail(spark):
    ex = T.fx_examples(spark, SF_SMALL)
    n = ex.count()
    p = BT.plan_batches(ex, 8, seed=1, epoch=0).toPandas()
    assert p.row_id.is_unique
    assert n - len(p) < 8  # only the last short pooled batch is dropped
    sizes = p.groupby("batch_order").size()
    assert (sizes == 8).all()
    assert sorted(p.batch_order.unique()) == list(range(len(sizes)))
    # a batch of several datasets is pooled from the short rests, so each dataset is in few
    mixed = p[p.groupby("batch_order").dataset.transform("nunique") > 1]
    assert (mixed.groupby("dataset").size() < 8).all()
    # drop_last keeps only single-dataset batches
    q = BT.plan_batches(ex, 8, seed=1, epoch=0, drop_last=True).toPandas()
    assert (q.groupby("batch_order").dataset.nunique() == 1).all()
    # different epoch -> different order, same rows
    r = BT.plan_batches(ex, 8, seed=1, epoch=1).toPandas()
    assert set(r.row_id) == set(p.row_id)


def test_sample_array_subset_without_repeats(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, [])], "row_id long, arr array<string>")
    got = df.select("row_id", S.sample_array(F.col("arr"), 2, 0, "row_id").alias("s")).collect()
    for r, src in zip(got, (["a", "b", "c", "d"], ["x"], [])):
        assert len(r.s) == min(2, len(src)) and set(r.s) <= set(src) and len(set(r.s)) == len(r.s)


def test_stratified_sample_size(spark):
    ex = T.fx_examples(spark, SF_SMALL).select("row_id", "cluster")
    n = ex.count()
    for want in (10, 50, n + 5):
        got = S.stratified_cluster_sample(ex, want, "row_id", "cluster").count()
        assert got >= min(want, n)


def test_resolve_batch_size():
    assert S.resolve_batch_size(32, 4) == 32
    assert S.resolve_batch_size(30, 4) == 28
    assert S.resolve_batch_size(2, 4) == 4


def test_dedup_idempotent_and_order_independent(spark):
    docs = T.table(spark, SF_SMALL, "documents")
    cfg = D.MinHashConfig(num_perm=64, threshold=0.7)
    once = D.dedup(docs, "doc_id", "text", cfg)
    ids1 = sorted(r.doc_id for r in once.select("doc_id").collect())
    twice = D.dedup(once, "doc_id", "text", cfg)
    assert sorted(r.doc_id for r in twice.select("doc_id").collect()) == ids1
    shuffled = docs.repartition(7, F.rand(5))
    assert sorted(r.doc_id for r in D.dedup(shuffled, "doc_id", "text", cfg).select("doc_id").collect()) == ids1


def test_signature_paths_agree(spark):
    docs = T.table(spark, SF_SMALL, "documents").limit(40)
    cfg = D.MinHashConfig(num_perm=8, threshold=0.7, bands=2, rows=4)
    a = {r.id: list(r.signature) for r in D.minhash_signature(docs, "doc_id", "text", cfg, "arrow").collect()}
    b = {r.id: list(r.signature) for r in D.minhash_signature(docs, "doc_id", "text", cfg, "expr").collect()}
    assert a == b


def _all_pairs_clusters(texts: dict, threshold: float) -> dict:
    sets, top = {}, {}
    for i, t in texts.items():
        w = re.split(r"\W", t.lower())
        if len(w) >= 5:
            sets[i], top[i] = {" ".join(w[k:k + 5]) for k in range(len(w) - 4)}, i

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_similar_clusters_equal_all_pairs(spark):
    """An outlier as the smallest id, pairs right at 0.8, chains, copies, short texts."""
    rnd = random.Random(5)
    base = [f"t{i}" for i in range(104)]
    texts = {0: " ".join(base[:80] + [f"x{i}" for i in range(24)]), 1: " ".join(base), 2: " ".join(base[:103] + ["z"]),
             3: "a b c d", 4: "a b c d e", 5: "A b c d e", 6: "a b c d e"}
    texts |= {10 + k: " ".join(f"c{i}" for i in range(k * 8, k * 8 + 104)) for k in range(6)}  # chain, each 0.85 like the next
    for k in range(150):  # one template with single words changed, about 0.6 to 1 alike
        w = [f"b{i}" for i in range(60)]
        for i in rnd.sample(range(60), rnd.randint(0, 3)):
            w[i] = f"v{rnd.randint(0, 4)}"
        texts[100 + k] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.cluster for r in D.similar_clusters(df, "doc_id", "text", 0.8).collect()}
    want = _all_pairs_clusters(texts, 0.8)
    assert got == want and want[2] == want[1] != want[0] and want[15] == 10


def test_verified_clusters_lose_no_link(spark):
    import __spark_entry__ as E
    got = {r.doc_id: r.cluster for r in E.queries()["near_dup_clusters_verified"](spark, SF_SMALL).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert got == _all_pairs_clusters(texts, 0.8)


def test_only_pairs_that_may_be_similar_get_their_grams(spark):
    """Texts that share a passage do not reach the comparison of all grams; pairs
    at the threshold do, also where one has twice as many parities."""
    texts = {k: " ".join([f"p{i}" for i in range(90)] + [f"u{k}_{i}" for i in range(90)]) for k in range(12)}
    texts |= {100 + k: " ".join(f"c{i}" for i in range(60 + k)) for k in range(16)}  # 56 to 71 grams, a border at 64
    texts |= {200 + k: " ".join(f"d{i}" for i in range(k * 60, k * 60 + 544)) for k in range(3)}  # 540 grams, 480 in common: 0.8
    grams = {i: {" ".join(t.split(" ")[k:k + 5]) for k in range(len(t.split(" ")) - 4)} for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a > b]
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    df, words = spark.createDataFrame(pairs, "src long, dst long"), D._word_hashes(rows)
    near = {tuple(r) for r in D._not_far(df, words, D.REFERENCE_CALLER, 0.8).collect()}
    similar = {(a, b) for a, b in pairs if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    assert (201, 200) in similar and (115, 100) not in similar and (112, 100) in similar and similar <= near
    assert not [(a, b) for a, b in near if a < 12] and len(near) <= len(similar) + 60
    assert {tuple(r) for r in D._similar(df, words, D.REFERENCE_CALLER, 0.8).collect()} == similar
