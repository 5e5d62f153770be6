"""Recipes and mining against plain versions on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup as D
from tessera.operators import mining as M
from tessera.operators import vectors as V
from tessera.plans import recipes as R

WORDS = "amber brook cedar delta ember fjord grove heath islet jetty knoll larch marsh north ocean plain".split()


def _text(rng, n=12):
    return " ".join(rng.choice(WORDS, n))


def _counts(text):
    return V.HashingEncoder(64, normalize=False).encode([text])[0].astype(float)


def _plain(asked, passages, k, skip, take, banned):
    """Texts by rank for one query: (id, text) pairs, ids that the mode bans."""
    q = _counts("query: " + asked)
    near = sorted(((float(((q - _counts("passage: " + t)) ** 2).sum()), i, t) for i, t in passages))[:k]
    left = [t for _, i, t in near if i not in banned]
    return left[skip:None if take is None else skip + take]


def _examples(spark, rng, n, clusters=3):
    rows = [(i, _text(rng), [_text(rng) for _ in range(1 + i % 2)], f"c{i % clusters}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, query string, positive array<string>, cluster string")


def test_mode_none_skips_the_nearest(spark):
    rows, df = _examples(spark, np.random.default_rng(1), 60)
    got = {r.row_id: r.negative for r in M.mine_negatives(df, "none").collect()}
    passages = list(enumerate(t for _, _, ps, _ in rows for t in ps))
    kept = {r.cid for r in M.example_corpus(df, "none").select("cid").collect()}
    passages = [p for p in passages if p[0] in kept]
    assert got == {i: _plain(q, passages, 128, 30, None, ()) for i, q, _, _ in rows}
    assert all(got.values())


def test_mode_same_cluster_and_other_queries(spark):
    rows, df = _examples(spark, np.random.default_rng(2), 45)
    flat = [(c, t) for _, q, ps, c in rows for t in [q, *ps]]
    kept = {r.cid for r in M.example_corpus(df, "same_cluster").select("cid").collect()}
    passages = [(i, t) for i, (_, t) in enumerate(flat) if i in kept]
    got = {r.row_id: r.negative for r in M.mine_negatives(df, "same_cluster").collect()}
    own = {c: {i for i, (cc, _) in enumerate(flat) if cc == c} for c in ("c0", "c1", "c2")}
    assert got == {i: _plain(q, passages, 2048, 20, 120, own[c]) for i, q, _, c in rows}
    got = {r.row_id: r.negative for r in M.mine_negatives(df, "other_queries").collect()}
    passages = [(i, q) for i, q, _, _ in rows]
    assert got == {i: _plain(q, passages, 2048, 20, 120, {j for j, _, _, cc in rows if cc == c}) for i, q, _, c in rows}


def test_mode_positive_ids_never_returns_judged(spark):
    rng = np.random.default_rng(3)
    corpus = [(f"d{i:03d}", None if i % 4 == 0 else f"title{i}", _text(rng)) for i in range(50)]
    rows = [(i, _text(rng), [corpus[i][2]], [corpus[i][0], corpus[i + 1][0], "gone"]) for i in range(8)]
    df = spark.createDataFrame(rows, "row_id long, query string, positive array<string>, positive_ids array<string>")
    docs = spark.createDataFrame(corpus, "_id string, title string, text string")
    got = {r.row_id: r.negative for r in M.mine_negatives(df, "positive_ids", corpus=docs).collect()}
    passages = [(i, f"{title or ''} {text}".strip()) for i, (_, title, text) in enumerate(corpus)]
    assert got == {i: _plain(q, passages, 128, 30, None, {i, i + 1}) for i, q, _, _ in rows}
    with pytest.raises(ValueError):
        M.mine_negatives(df, "positive_ids")


def test_small_and_empty_inputs(spark):
    _, df = _examples(spark, np.random.default_rng(4), 3)
    out = M.mine_negatives(df.withColumn("negative", F.array(F.lit("old"))), "none")
    assert [r.negative for r in out.collect()] == [[], [], []]  # fewer passages than the mode skips
    assert M.mine_negatives(df.where("false"), "none").count() == 0
    assert M.mine_negatives(df, M.COPY) is df
    with pytest.raises(KeyError):
        M.mine_negatives(df, "nearest")


def test_copies_are_looked_for_within_a_language(spark):
    text = " ".join(WORDS)
    df = spark.createDataFrame([(1, "fr", text), (2, "en", text), (3, "fr", text), (4, "en", text + " end")],
                               "id long, lang string, text string")
    both = {r.id for r in D.dedup(df, "id", "text", within=["lang"]).collect()}
    assert {r.id for r in D.dedup(df, "id", "text").collect()} <= {1, 4}
    assert {1, 2} <= both <= {1, 2, 4}


def test_registry_rows_name_known_steps_and_modes():
    for r in R.RECIPES.values():
        assert {s[0] for s in r.steps} <= set(R.STEPS)
        assert r.mining == M.COPY or r.mining in M.MODES


@pytest.mark.parametrize("name,row,want", [
    ("snli", [(1, 0), (2, 1)], {1}),
    ("sts", [(1, 3), (2, 2), (3, 5)], {1, 3}),
])
def test_filters_before_the_builder(spark, name, row, want):
    rng = np.random.default_rng(5)
    column = "label" if name == "snli" else "score"
    q, p = ("premise", "hypothesis") if name == "snli" else ("sentence1", "sentence2")
    rows = spark.createDataFrame([(i, v, _text(rng), _text(rng)) for i, v in row], f"row_id long, {column} int, {q} string, {p} string")
    out = R.build_examples(R.RECIPES[name], {"rows": rows})
    assert {r.row_id for r in out.collect()} == want
    assert out.columns == ["row_id", "query", "positive"]


def test_flattened_lists_and_languages(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(WORDS, 14)) for _ in range(30)]
    nested = spark.createDataFrame([(0, texts[:20], ["a"] * 20), (1, texts[20:], ["b"] * 10)],
                                   "row_id long, sentences array<string>, labels array<string>")
    out = R.build_examples(R.RECIPES["reddit_clustering"], {"rows": nested}).collect()
    assert {r.cluster for r in out} == {"a", "b"}
    assert sum(1 + len(r.positive) for r in out) <= 30
    rows = spark.createDataFrame([(0, "zh", "q", "p", "n"), (1, "xx", "q", "p", "n")],
                                 "row_id long, lang string, query string, positive string, negative string")
    out = R.build_examples(R.RECIPES["dureader"], {"rows": rows}).collect()
    assert [(r.row_id, r.positive, r.negative) for r in out] == [(0, ["p"], ["n"])]


def test_encoder_order_and_nulls(spark):
    rows = [(i, None if i == 3 else " ".join(WORDS[: 1 + (7 * i) % 16])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    got = V.encode_texts(df, "t", batch_rows=3).collect()
    assert [r.id for r in got] == list(range(40))
    want = V.HashingEncoder().encode([t or "" for _, t in rows])
    assert np.allclose(np.array([r.embedding for r in got]), want)
    assert [r.t for r in got] == [t for _, t in rows]


def test_encoder_is_kept_per_process():
    made = []

    def factory():
        made.append(1)
        return V.HashingEncoder(8)
    assert V._encoder(factory) is V._encoder(factory)
    assert made == [1]
