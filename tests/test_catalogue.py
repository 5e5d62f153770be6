"""Catalogue files, named tables and the script codes both ways."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment as AL
from tessera.operators import joins as J
from tessera.plans import registry as REG
from tessera.sources import catalogue as CT
from tessera.sources import io


@pytest.fixture
def files(spark, tmp_path):
    def entry(text):
        return {"instruction": text, "task_type": "STS"}
    docs = [{"de": {"a": entry("A"), "b": entry(" "), "c": entry(None)}, "xx": {"a": entry("X")}},
            {"*": {"a": entry("all a"), "b": entry("all b")}, "en": {"z": entry("flat")}}, {"de": {"a": entry("A again")}}]
    (tmp_path / "cat").mkdir()
    lines = [json.dumps(d) for d in docs] + ["", "no catalogue", '{"de": {"d": {"instruction": "D"}, "d": {"instruction": "D2"}}}']
    (tmp_path / "cat" / "one.json").write_text("\n".join(lines[:3]))
    (tmp_path / "cat" / "two.json").write_text("\n".join(lines[3:]))
    return str(tmp_path / "cat")


def test_entries_lookups_and_problems(spark, files):
    entries, bad = CT.scan_catalogue(spark, files)
    assert [r.line for r in bad.collect()] == ["no catalogue"]
    assert entries.count() == 10  # a name that stands twice in one document counts twice
    cells = spark.createDataFrame([("de", "a"), ("de", "b"), ("de", "c"), ("de", "d"), ("fr", "a"), ("en", "z"), ("fr", "z"), ("fr", "z")],
                                  "lang string, dataset string")
    got = sorted(((r.lang, r.dataset, r.instruction, r.found_in) for r in CT.catalogue_lookup(cells, entries).collect()), key=str)
    assert got == sorted([("de", "a", "A", "de"), ("de", "b", "all b", "*"), ("de", "c", None, None), ("de", "d", "D", "de"),
                          ("fr", "a", "all a", "*"), ("en", "z", "flat", "en")] + [("fr", "z", None, None)] * 2, key=str)
    chain = CT.catalogue_lookup(cells, entries, ("*", "lang", "en"))
    assert {(r.lang, r.dataset): r.found_in for r in chain.collect()} == {
        ("de", "a"): "*", ("de", "b"): "*", ("de", "c"): None, ("de", "d"): "de", ("fr", "a"): "*", ("en", "z"): "en", ("fr", "z"): "en"}
    known = spark.createDataFrame([("de",), ("en",)], "lang string")
    got = sorted(map(tuple, CT.catalogue_problems(entries, known, cells).collect()), key=str)
    assert got == sorted([("duplicate", "de", "a", 2), ("duplicate", "de", "d", 2), ("unknown language", "xx", None, 1),
                          ("no instruction", "de", "b", 1), ("no instruction", "de", "c", 1), ("not found", "de", "c", 1),
                          ("not found", "fr", "z", 2)], key=str)
    assert CT.catalogue_lookup(cells.limit(0), entries).count() == 0
    assert CT.catalogue_lookup(cells, entries.limit(0)).where("instruction is not null").count() == 0


def test_named_tables(spark, tmp_path):
    rows = spark.range(200).select("id", F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3).cast("string").alias("part"))
    name = f"tessera_test_{abs(hash(str(tmp_path)))}"
    table = io.sink_catalog_table(rows, name, str(tmp_path / "a"), ["part"], ["id"], 4)
    assert table.count() == 200
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        io.sink_catalog_table(rows, name, str(tmp_path / "b"))
    new = rows.where("part = '1'").select("part", F.lit("new").alias("text"), "id").limit(5)  # columns in another order
    got = io.overwrite_partitions(new, name)
    assert got.groupBy("part").count().orderBy("part").collect() == [("0", 67), ("1", 5), ("2", 66)]
    assert got.where("text = 'new'").count() == 5
    other = io.sink_catalog_table(rows.select("id", F.col("text").alias("t2")), name + "_2", str(tmp_path / "c"), (), ["id"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(name).join(other, "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()  # buckets meet where they lie
        assert joined.count() == 138
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    schema = "id long, text string, part string"
    rows.limit(7).write.json(str(tmp_path / "file"))
    assert io.scan_with_fallback_path(spark, name, str(tmp_path / "file"), schema).count() == 138
    assert io.scan_with_fallback_path(spark, name + "_absent", str(tmp_path / "file"), schema).count() == 7
    for t in (name, name + "_2"):
        spark.sql(f"drop table {t}")


def test_modes_of_alignment(spark):
    routes = REG.alignment_routes(spark)
    names = {m: {r.name for r in AL.alignment_datasets(routes, *m).collect()} for m in ((True, False), (False, True), (True, True))}
    assert names[True, True] == names[True, False] | names[False, True] == {r.name for r in routes.collect()}
    assert not names[True, False] & names[False, True]
    with pytest.raises(ValueError):
        AL.alignment_datasets(routes, False, False)


def test_script_codes_both_ways(spark):
    sc = spark.createDataFrame([("de", "deu_Latn"), ("ru", "rus_Cyrl")], "short string, script string")
    pairs = spark.createDataFrame([("de-ru",), ("ru-de",), ("de-xx",)], "pair string")
    there = J.lang_pair_parse(pairs, sc)
    assert {(r.pair, r.unknown) for r in there.collect()} == {("de-ru", ""), ("ru-de", ""), ("de-xx", "xx")}
    codes = there.where("unknown = ''").select(F.concat_ws("-", "src_script", "tgt_script").alias("pair"), F.col("pair").alias("was"))
    back = J.lang_pair_parse(codes, sc.select(F.col("script").alias("short"), F.col("short").alias("script")))
    assert all(f"{r.src_script}-{r.tgt_script}" == r.was for r in back.collect()) and back.count() == 2
