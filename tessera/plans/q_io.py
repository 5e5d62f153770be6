"""Registered queries: sources and sinks as round trips through the shared
scratch folder (S1-S14).  Each writes data derived from the given tables and
reads it back through the operator under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from tessera.operators import filters as P
from tessera.operators import rollups as R
from tessera.plans.catalog import joined, r6, register
from tessera.session import scratch_path
from tessera.sources import io
from tessera.sources import tables as T

PAIR_SCHEMA = "conv_id long, turn long, query string, positive string"
CORPUS_SCHEMA = T_.StructType([T_.StructField("_id", T_.StringType()), T_.StructField("title", T_.StringType()),
                               T_.StructField("text", T_.StringType())])
EX_SQL = "select query, array_to_string(positive, chr(31)) as positive, array_to_string(negative, chr(31)) as negative from fx_examples"
CELLS_SQL = "cells as (select lang, dataset, avg(score) as score from fx_scores group by lang, dataset)"


def _examples_rendered(df):
    return df.select("query", joined("positive"), joined("negative"))


@register("scan_jsonl", EX_SQL)
def scan_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    io.sink_jsonl(T.fx_examples(spark, d).select("query", "positive", "negative"), path)
    return _examples_rendered(io.scan_jsonl(spark, path, io.EXAMPLE_SCHEMA))


@register("scan_jsonl_lenient", """
select _id, title, text, cast(null as varchar) as line from fx_corpus
union all select null, null, null, '{"_id": ' || _id from fx_queries
""")
def scan_jsonl_lenient(spark, d):
    path = scratch_path(spark, "lenient")
    good = T.fx_corpus(spark, d).select(F.to_json(F.struct("_id", "title", "text")).alias("value"))
    bad = T.fx_queries(spark, d).select(F.concat(F.lit('{"_id": '), F.col("_id")).alias("value"))  # broken lines
    good.unionByName(bad).write.text(path)
    records, lines = io.scan_jsonl_lenient(spark, path, CORPUS_SCHEMA)
    return records.unionByName(lines, allowMissingColumns=True)


@register("scan_qrels_tsv", "select cast(query_id as varchar) as \"query-id\", cast(corpus_id as varchar) as \"corpus-id\", score from fx_qrels")
def scan_qrels_tsv(spark, d):
    path = scratch_path(spark, "qrels")
    q = T.fx_qrels(spark, d).select(F.col("query_id").cast("string").alias("query-id"),
                                    F.col("corpus_id").cast("string").alias("corpus-id"), "score")
    q.where("score > 0").write.option("sep", "\t").option("header", True).csv(path + "/judged")
    q.where("score <= 0").write.option("sep", "\t").option("header", True).csv(path + "/zero")
    return io.scan_qrels_tsv(spark, path + "/*", glob="*.csv")


@register("scan_named_dataset", "select doc_id, lang from documents")
def scan_named_dataset(spark, d):
    reg = spark.createDataFrame([("documents", f"{d.rstrip('/')}/documents.parquet"),
                                 ("labels", f"{d.rstrip('/')}/labels.parquet")], "name string, data_path string")
    return io.scan_named_dataset(spark, reg, "documents").select("doc_id", "lang")


@register("scan_with_fallback_path", "select conv_id, turn, query, positive from fx_pairs")
def scan_with_fallback_path(spark, d):
    path = scratch_path(spark, "fallback")
    io.sink_jsonl(T.fx_pairs(spark, d), path)
    return io.scan_with_fallback_path(spark, "tessera_no_such_table", path, PAIR_SCHEMA)


@register("scan_with_fallback_table", """
select conv_id, turn, query, positive, case when turn % 4 = 0 then 'table' else 'file' end as branch from fx_pairs
""")
def scan_with_fallback_table(spark, d):
    """Both branches: a named table that exists, and a file for one that does not."""
    pairs, path = T.fx_pairs(spark, d), scratch_path(spark, "fallback")
    in_table = F.col("turn") % 4 == 0
    name = f"tessera_pairs_{uuid.uuid4().hex[:12]}"
    io.sink_catalog_table(pairs.where(in_table), name, f"{path}-table")
    io.sink_jsonl(pairs.where(~in_table), f"{path}-file")
    have = io.scan_with_fallback_path(spark, name, f"{path}-file", PAIR_SCHEMA).withColumn("branch", F.lit("table"))
    rest = io.scan_with_fallback_path(spark, name + "_absent", f"{path}-file", PAIR_SCHEMA).withColumn("branch", F.lit("file"))
    return have.unionByName(rest).select("conv_id", "turn", "query", "positive", "branch")


@register("scan_split_slice", "select doc_id, lang from documents order by doc_id limit 100")
def scan_split_slice(spark, d):
    return io.scan_split_slice(T.table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id")


@register("scan_subcorpora", "select _id, text, lang as subcorpus from fx_corpus")
def scan_subcorpora(spark, d):
    root = scratch_path(spark, "beir")
    c = T.fx_corpus(spark, d).select("_id", "text", F.col("lang").alias("subcorpus"))
    c.write.partitionBy("subcorpus").json(root)
    T.fx_qrels(spark, d).select(F.lit("qrels").alias("subcorpus"), F.col("query_id").cast("string").alias("_id"),
                                F.lit("").alias("text")).write.partitionBy("subcorpus").mode("append").json(root)
    return io.scan_subcorpora(spark, root, schema="_id string, text string, subcorpus string").select(
        "_id", "text", "subcorpus")


@register("sink_jsonl", "select conv_id, turn, query, positive from fx_pairs")
def sink_jsonl(spark, d):
    path = scratch_path(spark, "sink")
    io.sink_jsonl(T.fx_pairs(spark, d), path)
    return spark.read.schema(PAIR_SCHEMA).json(path)


@register("sink_if_absent", "select conv_id, turn, query, positive from fx_pairs")
def sink_if_absent(spark, d):
    path = scratch_path(spark, "ifabsent")
    first = io.sink_if_absent(T.fx_pairs(spark, d), path)
    second = io.sink_if_absent(T.fx_pairs(spark, d).limit(1), path)  # skipped: output exists
    assert first and not second
    return spark.read.schema(PAIR_SCHEMA).json(path)


@register("run_stages", """
select conv_id, turn, query, positive from fx_pairs where len(regexp_extract_all(query, '\\S+')) > 3
""")
def run_stages(spark, d):
    """Load and filter as resumable stages; the second run finds both published."""
    root = scratch_path(spark, "stages")
    stages = [("load", lambda x: T.fx_pairs(spark, d)), ("long", lambda x: x["load"].where(P.short_query_predicate("query", 3)))]
    first, second = (io.run_stages(spark, root, stages, version=d) for _ in range(2))
    if not all(first.values()) or any(second.values()):
        raise RuntimeError("a published stage was run again")
    return spark.read.schema(PAIR_SCHEMA).parquet(f"{root}/long-*")


@register("sink_replace_in_place", """
select query, array_to_string(positive, chr(31)) as positive, array_to_string(negative, chr(31)) as negative
from fx_examples where len(positive) > 0 and len(negative) > 0
""")
def sink_replace_in_place(spark, d):
    path = scratch_path(spark, "inplace")
    io.sink_jsonl(T.fx_examples(spark, d).select("query", "positive", "negative"), path)
    out = io.sink_replace_in_place(spark, path, P.require_pos_neg, io.EXAMPLE_SCHEMA)
    return _examples_rendered(out)


@register("sink_table", "select row_id, dataset, cluster, query from fx_examples")
def sink_table(spark, d):
    path = scratch_path(spark, "table")
    t = io.sink_table(T.fx_examples(spark, d).select("row_id", "dataset", "cluster", "query"), path, ["dataset"])
    return t.select("row_id", "dataset", "cluster", "query")


@register("sink_catalog_table", """
select row_id, case when dataset = 'en' then 'again ' || query else query end as query, dataset from fx_examples
""")
def sink_catalog_table(spark, d):
    """A named table, partitioned by dataset and bucketed by row; the English
    partition is then written anew and the others stay."""
    ex = T.fx_examples(spark, d).select("row_id", "query", "dataset")
    name = f"tessera_examples_{uuid.uuid4().hex[:12]}"
    io.sink_catalog_table(ex, name, scratch_path(spark, "named"), ["dataset"], ["row_id"])
    english = ex.where(F.col("dataset") == "en").withColumn("query", F.concat(F.lit("again "), "query"))
    return io.overwrite_partitions(english, name)


@register("results_json_io", "with " + CELLS_SQL + " select lang, dataset, round(score, 6) as score from cells")
def results_json_io(spark, d):
    path = scratch_path(spark, "results")
    io.results_to_json(R.dataset_language_score(T.fx_scores(spark, d))).write.text(path)
    back = io.results_from_json(spark.read.text(path))
    return back.select("lang", "dataset", r6("score"))


@register("results_store_lookup", "with " + CELLS_SQL + """
select c.lang, c.dataset, case when c.dataset in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9')
                               then round(c.score, 6) end as score
from cells c
""")
def results_store_lookup(spark, d):
    """Files of two models below one root; those of one are read."""
    root = scratch_path(spark, "store")
    cells = R.dataset_language_score(T.fx_scores(spark, d)).withColumn("split", F.lit("test"))
    stored = cells.where(F.col("dataset").isin([f"src{i}" for i in range(10)]))
    io.results_store_publish(stored, root, "model-a", "r1")
    io.results_store_publish(cells.withColumn("score", F.col("score") + 1), root, "model-b", "r1")
    if io.results_store_publish(stored.withColumn("score", F.col("score") + 2), root, "model-a", "r1"):
        raise RuntimeError("a stored result was replaced")
    out = io.results_store_lookup(spark, root, cells.select("lang", "dataset"), "model-a", "r1")
    return out.select("lang", "dataset", r6("score"))


@register("report_by_language", "with " + CELLS_SQL + """
select lang, cast(substr(dataset, 4) as int) as pos, dataset, round(score * 100.0, 6) as score from cells
""")
def report_by_language(spark, d):
    path = scratch_path(spark, "report")
    cells = R.dataset_language_score(T.fx_scores(spark, d))
    sheet = cells.select("lang", F.substring("dataset", 4, 10).cast("int").alias("pos"), "dataset",
                         F.round(F.col("score") * 100.0, 6).alias("score"))
    return io.report_by_language(sheet, path).select("lang", "pos", "dataset", r6("score"))
