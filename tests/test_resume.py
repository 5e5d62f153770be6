"""Published sinks, resumable stages, and global ids back to rows."""

import bisect
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling as S
from tessera.sources import io


def test_half_written_folder_is_redone(spark, tmp_path):
    path = tmp_path / "out"
    (path / "_temporary").mkdir(parents=True)
    (path / "part-0.json").write_text('{"id": 99}\n')
    assert io.published(spark, str(path)) is None
    assert io.sink_if_absent(spark.range(5), str(path))
    assert sorted(r.id for r in spark.read.json(str(path)).collect()) == [0, 1, 2, 3, 4]
    assert io.published(spark, str(path))["rows"] == 5


def test_published_output_is_not_computed_again(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(10).mapInArrow(counted, "id long")
    assert io.sink_if_absent(df, str(tmp_path / "x")) and seen.value == 10
    assert not io.sink_if_absent(df, str(tmp_path / "x")) and seen.value == 10
    with pytest.raises(ValueError):
        io.sink_if_absent(df, str(tmp_path / "x"), version="2")
    with pytest.raises(FileExistsError):
        io.publish(df, str(tmp_path / "x"))


def test_stages_go_on_where_they_broke(spark, tmp_path):
    calls = []

    def stage(name, make, fail=False):
        def run(done):
            calls.append(name)
            if fail:
                return make(done).withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
            return make(done)
        return name, run

    load, mine = (lambda x: spark.range(20)), (lambda x: x["load"].where("id % 2 = 0"))
    with pytest.raises(Exception):
        io.run_stages(spark, str(tmp_path), [stage("load", load), stage("mine", mine, fail=True)])
    assert calls == ["load", "mine"]
    assert io.run_stages(spark, str(tmp_path), [stage("load", load), stage("mine", mine)]) == {"load": False, "mine": True}
    assert calls == ["load", "mine", "mine"]
    assert io.run_stages(spark, str(tmp_path), [stage("load", load), stage("mine", mine)]) == {"load": False, "mine": False}
    assert io.run_stages(spark, str(tmp_path), [stage("load", load)], version="new input") == {"load": True}


@pytest.mark.parametrize("few", [4096, 0])
def test_rows_of_global_ids(spark, few):
    rnd = random.Random(few)
    sizes = [(f"d{i:03d}", rnd.choice([0, 0, 1, 3, 50])) for i in range(60)]
    ends = list(accumulate(n for _, n in sizes))
    asked = list(range(ends[-1])) + list(range(-ends[-1], 0)) + [7] * 3000  # one id asked for by most
    ids = spark.createDataFrame([(a, "x") for a in asked], "global_id long, _at string")
    got = S.rows_of_global_ids(ids.withColumnRenamed("_at", "n"), spark.createDataFrame(sizes, "dataset string, n long"), few=few)
    want = []
    for a in asked:
        at = a % ends[-1]
        i = bisect.bisect_right(ends, at)
        want.append((a, "x", sizes[i][0], at - (ends[i - 1] if i else 0)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    for wrong in (ends[-1], -ends[-1] - 1):
        with pytest.raises(Exception, match="no row has the global id"):
            S.rows_of_global_ids(spark.createDataFrame([(wrong,)], "global_id long"), spark.createDataFrame(sizes, "dataset string, n long"), few=few).collect()
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_normalising_takes_linear_time(spark):
    """The norm is bound once: its sum stands once in the plan, not in the inner lambda."""
    from tessera.functions.vectors import l2_normalize

    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(l2_normalize("v").alias("v")).collect()
    assert [r.v for r in got] == [[0.6, 0.8], [0.0, 0.0], None]


def test_gate_is_per_dataset(spark):
    """A dataset above the gate loses its short queries, one at the gate keeps them; a null name is a dataset."""
    from tessera.operators import filters as P

    rows = [("big", "two words")] * 5 + [("big", "now there are five words")] + [("small", "two words")] * 3 + [(None, "two words")] * 4
    got = P.gated_short_query_filter(spark.createDataFrame(rows, "dataset string, query string"), gate=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("big", "now there are five words")] + [("small", "two words")] * 3, key=str)
