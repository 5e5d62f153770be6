"""Edge cases that the tables at hand do not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.operators import containment, joins
from tessera.operators import dedup as D
from tessera.operators import knn as K
from tessera.operators import metrics as M
from tessera.operators import rollups as R
from tessera.operators import sampling as S
from tessera.operators.cluster import assign_nearest_centroid
from tessera.operators.vectors import HashingEncoder, encode_texts, hashing_embedding
from tessera.plans import catalog, registry
from tessera.session import ensure_checkpoint_dir
from tessera.sources import io
from tessera.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_hold_every_character(spark):
    ex = T.fx_examples(spark, SF_SMALL).join(
        T.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("row_id"), "text"), "row_id")
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x))
    n = F.length("query") + chars("positive") + chars("negative") + F.size("positive") + F.size("negative")
    assert ex.where(n != F.length("text")).count() == 0


def test_every_vector_is_a_query(spark):
    q = T.fx_vec_queries(spark, SF_SMALL)
    assert q.count() == T.table(spark, SF_SMALL, "embeddings").count() == q.select("vec_id").distinct().count()
    assert "Window" not in plan(q)


def test_retrieval_plans_have_no_nested_loop(spark):
    catalog.load_all()
    for key in ("build_retrieval_examples", "join_qrels_corpus_queries", "queries_without_qrels"):
        p = plan(catalog.QUERIES[key](spark, SF_SMALL))
        assert "NestedLoop" not in p and "CartesianProduct" not in p


def test_containment_equals_search(spark):
    texts = [(1, "one two three four five six seven"), (2, "xone two threex"), (3, ""), (4, None), (5, "a\nb c"), (6, "two  three"), (7, "é")]
    passages = [(1, "two three four five six"), (2, "ne two thr"), (3, "wo"), (4, "b"), (5, "two"), (6, "three four five six seven eight"),
                (7, "a\nb"), (8, "é"), (9, None), (10, " two three "), (11, "one two three four five six seven")]
    t = spark.createDataFrame(texts, "id long, text string")
    p = spark.createDataFrame(passages, "pid long, passage string")
    got = {(r.pid, r.id) for r in containment.contains_pairs(t, p, "id", "text", "pid", "passage").collect()}
    assert got == {(i, j) for i, x in passages for j, y in texts if x is not None and y is not None and x in y}


def test_first_row_per_id_is_by_order(spark):
    corpus = spark.createDataFrame([("d", "zeta", "t1", 1), ("d", "alpha", "t2", 2), ("e", None, "t3", 3)], "_id string, title string, text string, row long")
    qrels = spark.createDataFrame([("q", "d", 1), ("q", "gone", 1), ("r", "gone", 1), ("s", "e", 0)], "query_id string, corpus_id string, score int")
    queries = spark.createDataFrame([(x, x.upper()) for x in "qrst"], "_id string, text string")
    (row,) = joins.retrieval_examples(qrels, corpus, queries, order="row").collect()
    assert (row.query_id, row.positive_ids, row.positive) == ("q", ["d", "gone"], ["zeta\nt1"])
    dropped = {r._id: (r.reason, r.n_judged) for r in joins.queries_without_qrels(qrels, corpus, queries).collect()}
    assert dropped == {"r": (joins.NO_PASSAGE, 1), "s": (joins.NO_JUDGEMENT, 0), "t": (joins.NO_JUDGEMENT, 0)}


@pytest.mark.parametrize("offset", [0, 100, 10_000])
def test_knn_is_exact_off_the_unit_sphere(spark, offset):
    rng = np.random.default_rng(4)
    C = offset + rng.integers(0, 4, (400, 6)) / 8
    Q = offset + rng.integers(0, 4, (50, 6)) / 8
    corpus = spark.createDataFrame([(i, C[i].tolist()) for i in range(400)], "cid long, cvec array<double>")
    queries = spark.createDataFrame([(i, Q[i].tolist()) for i in range(50)], "qid long, qvec array<double>")
    for group_bytes in (64 << 20, 4096):  # one group, several
        out = K.knn_topk(queries, corpus, 50, "l2", group_bytes=group_bytes).toPandas().sort_values(["qid", "rank"])
        for q in range(50):
            want = np.lexsort((np.arange(400), ((C - Q[q]) ** 2).sum(axis=1)))[:50]
            assert out[out.qid == q].cid.tolist() == want.tolist()


def test_centroid_blocks_agree(spark):
    rng = np.random.default_rng(5)
    X, C = rng.integers(0, 5, (80, 3)) + 1000.0, rng.integers(0, 5, (40, 3)) + 1000.0
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(80)], "id long, embedding array<double>")
    cents = spark.createDataFrame([(i, C[i].tolist()) for i in range(40)], "cid long, centroid array<double>")
    want = {i: int(np.lexsort((np.arange(40), ((C - X[i]) ** 2).sum(axis=1)))[0]) for i in range(80)}
    for block_bytes in (64 << 20, 7 * 32):  # all, and 7 centroids of 32 bytes
        assert {r.id: r.cluster for r in assign_nearest_centroid(df, cents, block_bytes=block_bytes).collect()} == want


def test_average_precision_counts_what_is_beyond_the_cut(spark):
    run = spark.createDataFrame([(1, r, r) for r in range(1, 11)], "qid long, rank int, cid long")
    rel = spark.createDataFrame([(1, c) for c in range(1, 21)], "qid long, cid long")
    (row,) = M.retrieval_metrics(run, rel, 10).collect()
    assert row.map == pytest.approx(0.5) and row.precision == 1.0 and row.recall == 0.5
    (mean,) = M.mean_over_queries(M.retrieval_metrics(run, rel, 10)).collect()
    assert mean.map == pytest.approx(0.5) and mean.n_queries == 1


def test_average_precision_of_ties_ignores_the_order(spark):
    for labels in ((1, 0, 0, 1), (0, 1, 1, 0)):
        df = spark.createDataFrame([(0.7, y) for y in labels], "s double, y int")
        assert M.pair_average_precision(df, "s", "y").first().average_precision == pytest.approx(0.5)


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([(i, float(v), float(w)) for i, (v, w) in enumerate([(1, 2), (1, 1), (2, 2), (3, 9), (3, 9)])], "id long, s double, g double")
    got = M.sts_correlation(df, "s", "g").first()
    a, b = np.array([1.5, 1.5, 3, 4.5, 4.5]), np.array([2.5, 1, 2.5, 4.5, 4.5])
    assert got.spearman == pytest.approx(np.corrcoef(a, b)[0, 1]) and got.n_pairs == 5


def test_flat_scores_improve_once(spark):
    df = spark.createDataFrame([("m", i, 0.5) for i in range(3)], "metric string, step int, score double")
    row = R.best_checkpoint(df).first()
    assert (row.n_improvements_strict, row.n_improvements_ge, row.best_step_strict, row.best_step_ge) == (1, 3, 0, 2)


def test_all_languages_have_no_ja(spark):
    from tessera.operators.alignment import select_training_datasets
    names = {r.name for r in select_training_datasets(registry.lang_groups(spark), None).collect()}
    assert not [n for n in names if n.startswith("ja_")] and "de_MIRACL" in names


def test_sample_n_rows_is_the_first_n(spark):
    df = spark.range(3000).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    from tessera.functions.order import order_key
    want = {r.k for r in df.orderBy(order_key(0, "sample", "k"), "k").limit(40).collect()}
    assert {r.k for r in S.sample_n_rows(df, 40, "k").collect()} == want
    assert S.sample_n_rows(df, 4000, "k").count() == 3000 and S.sample_n_rows(df.limit(0), 5, "k").count() == 0


def test_one_signature_pass(spark):
    docs = T.table(spark, SF_SMALL, "documents")
    cfg = D.MinHashConfig(num_perm=16, threshold=0.7, bands=4, rows=4)
    edges = D.lsh_star_edges(D.lsh_bands(D.minhash_signature(docs, "doc_id", "text", cfg), 4, 4))
    assert "ArrowEvalPython" not in plan(edges)  # behind the checkpoint


def test_encoders_agree(spark):
    df = spark.createDataFrame([(1, "Some words, some MORE words"), (2, ""), (3, None), (4, "é")], "id long, t string")
    a = {r.id: r.embedding for r in encode_texts(df, "t", lambda: HashingEncoder(16)).collect()}
    b = {r.id: r.embedding for r in hashing_embedding(df, "id", "t", 16).collect()}
    assert all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a)


def test_lenient_scan_keeps_every_record(spark, tmp_path):
    lines = ['{"_id": "1", "title": "t", "text": "a"}', '{"_id": "2", "text": "b"}', '{"_id": "3", "title": {"x": 1}, "text": "c"}', '{"_id": ', "junk"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "x"))
    from pyspark.sql import types as X
    schema = X.StructType([X.StructField(c, X.StringType()) for c in ("_id", "title", "text")])
    records, bad = io.scan_jsonl_lenient(spark, str(tmp_path / "x"), schema)
    assert {r._id: r.text for r in records.collect()} == {"1": "a", "2": "b", "3": "c"}
    assert sorted(r.line for r in bad.collect()) == sorted(lines[3:])
    with pytest.raises(Exception):
        io.scan_jsonl_lenient(spark, str(tmp_path / "none"), schema)[0].count()


class _Fs:
    """A file system whose n-th rename fails."""

    def __init__(self, fails):
        self.fails, self.done = fails, []

    def rename(self, a, b):
        self.done.append((a, b))
        return len(self.done) not in self.fails

    def delete(self, path, recursive):
        self.done.append(("delete", path))


def test_failed_swap_keeps_the_data():
    fs = _Fs({1})
    with pytest.raises(OSError):
        io._swap(fs, "src", "new", "old")
    assert fs.done == [("src", "old")]
    fs = _Fs({2})
    with pytest.raises(OSError):
        io._swap(fs, "src", "new", "old")
    assert fs.done == [("src", "old"), ("new", "src"), ("old", "src")]
    fs = _Fs(set())
    io._swap(fs, "src", "new", "old")
    assert fs.done[-1] == ("delete", "old")


def test_no_private_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_other_languages_and_sources_stay(spark, tmp_path):
    import __spark_entry__ as E
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    other = spark.createDataFrame([(10 ** 6, "q\np\nn", "it", "src3", 5), (10 ** 6 + 1, "q", None, "web", 1), (10 ** 6 + 2, "q\np", "de", "src40", 3)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(other.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    more = other.select(*[F.col(c) if c == "doc_id" else F.lit(1).cast(labels.schema[c].dataType).alias(c) for c in labels.columns])
    labels.unionByName(more).write.parquet(f"{tmp_path}/labels.parquet")
    q = E.queries()
    routes = {r.row_id: r for r in q["route_alignment_task"](spark, str(tmp_path)).where("row_id >= 1000000").collect()}
    assert routes[10 ** 6].dataset == "it" and routes[10 ** 6].route is None and routes[10 ** 6 + 1].query == "q"
    prompts = q["render_prompts"](spark, str(tmp_path)).where("row_id >= 1000000").collect()
    assert sorted((r.row_id, r.pos, r.query_prompt is None) for r in prompts) == [(10 ** 6, 0, True), (10 ** 6 + 2, 0, False)]
    sheet = {(r.lang, r.dataset): (r.pos, r.score) for r in q["score_sheet"](spark, str(tmp_path)).collect()}
    assert sheet["it", "src3"] == (3, 100.0) and sheet["de", "src40"] == (40, 100.0) and sheet["en", "src40"] == (40, 0.0)
    assert sheet["en", "web"] == (None, 0.0) and len([k for k in sheet if k[1] == "web"]) >= 1
