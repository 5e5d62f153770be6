"""Stored results by path, and figures that judge a fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as C
from tessera.operators import metrics as M
from tessera.sources import io

CELLS = "lang string, dataset string, split string, score double"


def test_only_files_of_one_model_and_revision_are_read(spark, tmp_path):
    root = str(tmp_path / "store")
    cells = spark.createDataFrame([("en", "a.b", "test", 0.25), ("en", "a.b", "dev", 0.75), ("de", "a.b", "test", 0.1),
                                   ("de", "c-d", "test", None)], CELLS)
    assert len(io.results_store_publish(cells, root, "m__x", "r1")) == 3
    io.results_store_publish(cells, root, "m__x", "r2")
    io.results_store_publish(cells, root, "m", "r1")
    scan = io.results_store_scan(spark, root, "m__x", "r1")
    assert sorted(p.split("store/")[1] for p in scan.inputFiles()) == [
        "de/m__x/r1/a.b.json", "de/m__x/r1/c-d.json", "en/m__x/r1/a.b.json"]
    assert sorted(map(tuple, scan.collect()), key=str) == [("de", "a.b", 0.1), ("de", "c-d", None), ("en", "a.b", 0.5)]
    wanted = spark.createDataFrame([("en", "a.b"), ("en", "c-d"), ("fr", "a.b")], "lang string, dataset string")
    got = {(r.lang, r.dataset): r.score for r in io.results_store_lookup(spark, root, wanted, "m__x", "r1").collect()}
    assert got == {("en", "a.b"): 0.5, ("en", "c-d"): None, ("fr", "a.b"): None}


def test_stored_results_stay(spark, tmp_path):
    root = str(tmp_path / "store")
    cell = spark.createDataFrame([("en", "a", "test", 1.0)], CELLS)
    assert io.results_store_scan(spark, root, "m", "r").count() == 0
    assert io.results_store_publish(cell, root, "m", "r")
    both = cell.withColumn("score", F.lit(2.0)).unionByName(spark.createDataFrame([("en", "b", "test", 3.0)], CELLS))
    assert [p.rsplit("/", 1)[1] for p in io.results_store_publish(both, root, "m", "r")] == ["b.json"]
    got = {r.dataset: r.score for r in io.results_store_scan(spark, root, "m", "r").collect()}
    assert got == {"a": 1.0, "b": 3.0}
    assert io.results_store_publish(cell.limit(0), root, "m", "r") == []
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith(".staging")]
    for bad in ("x/y", "..", "", "a b"):
        with pytest.raises(ValueError):
            io.results_store_publish(cell, root, bad, "r")
        with pytest.raises(ValueError):
            io.results_store_publish(cell.withColumn("dataset", F.lit(bad)), root, "m", "r")


def _vectors(spark, n):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(n)], "vec_id long, embedding array<double>")


def test_kmeans_report_finds_wrong_clusters(spark, monkeypatch):
    df = _vectors(spark, 300)
    row = C.kmeans_report(df, "vec_id", k=10, max_iter=100).first().asDict()
    assert row == {"n_rows": 300, "n_unassigned": 0, "n_unknown": 0, "n_not_nearest": 0, "k": 10, "k_fits": True}
    assert C.kmeans_report(df, "vec_id", k=1024).first()["k"] == 15  # 300 // 20
    assert C.kmeans_report(_vectors(spark, 12), "vec_id", k=1024).first()["k"] == 1
    fit = C.kmeans_clusters

    def spoilt(*args, **kw):
        out, centres = fit(*args, **kw)
        wrong = F.when(F.col("id") % 3 == 0, (F.col("cluster") + 1) % len(centres)).when(F.col("id") == 1, 99).otherwise(F.col("cluster"))
        return out.withColumn("cluster", F.when(F.col("id") != 2, wrong)), centres
    monkeypatch.setattr(C, "kmeans_clusters", spoilt)
    row = C.kmeans_report(df, "vec_id", k=10).first()
    assert (row.n_not_nearest, row.n_unknown, row.n_unassigned) == (100, 2, 1)  # no cluster is no centre either


def test_probe_scores_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) + 2.0 * np.eye(4)[i % 3]).tolist(), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y long")
    train, test = df.where("id < 300"), df.where("id >= 300")
    pred = [(int(r.y), int(r.prediction)) for r in M.probe_predictions(train, test, "v", "y").collect()]
    assert len(pred) == 100
    f1 = []
    for c in {x for p in pred for x in p}:
        tp = sum(y == p == c for y, p in pred)
        f1.append(2 * tp / (sum(y == c for y, _ in pred) + sum(p == c for _, p in pred)))
    row = M.probe_accuracy(train, test, "v", "y").first()
    assert row.accuracy == pytest.approx(sum(y == p for y, p in pred) / 100) and row.accuracy > 0.6
    assert row.macro_f1 == pytest.approx(sum(f1) / len(f1))
