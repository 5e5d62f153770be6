"""Base-table scans and the fixture views derived from them.

The fixture views give the given tables the shapes the reference's inputs
have (BEIR triple, pairs, labelled classification data, grouped texts,
training examples, vectors ...).  Each is a lazy DataFrame; Catalyst prunes
columns and pushes filters into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fx_corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("_id"),
        F.expr("split_part(text, '\\n', 1)").alias("title"),
        "text", "lang", "source", F.col("doc_id").alias("row"))


def fx_queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("_id"), "text")


def fx_qrels(spark, d) -> DataFrame:
    """Judged pairs: benchmark passage contained in a document (score 1), a
    score-0 row per query, and ids missing from the corpus for every 5th."""
    from tessera.operators.containment import contains_pairs

    b = table(spark, d, "benchmark")
    pairs = contains_pairs(table(spark, d, "documents"), b, "doc_id", "text", "item_id", "text")
    hits = pairs.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("corpus_id"), F.lit(1).alias("score"))
    zero = b.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("corpus_id"),
                    F.lit(0).alias("score"))
    missing = b.where(F.col("item_id") % 5 == 0).select(
        F.col("item_id").alias("query_id"),
        (F.lit(100000000) + F.col("item_id")).alias("corpus_id"), F.lit(1).alias("score"))
    return hits.unionByName(zero).unionByName(missing)


def fx_pairs(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    return (c.select("conv_id", "turn", "role", "text",
                     F.lead("text").over(w).alias("nxt"), F.lead("role").over(w).alias("nrole"))
            .where((F.col("role") == "user") & (F.col("nrole") == "assistant"))
            .select("conv_id", "turn", F.col("text").alias("query"), F.col("nxt").alias("positive")))


def fx_labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    lab = table(spark, d, "labels")
    j = docs.join(lab, "doc_id")
    return j.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"),
        "text",
        F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.lit("_"),
                 F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("label_text"),
        (F.col("quality") * 2 + F.col("toxic")).alias("label"))


def fx_grouped(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", "text",
        F.concat_ws("", "lang", F.lit("."), "source", F.lit(" "), "lang", F.lit(".x")).alias("categories"),
        F.col("source").alias("category"))


def fx_examples(spark, d) -> DataFrame:
    """All lines of a document: the first is the query, then positives and
    negatives in turn."""
    lines = F.split(F.col("text"), "\n")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("dataset"),
        F.col("source").alias("cluster"), lines.getItem(0).alias("query"),
        F.filter(lines, lambda x, i: i % 2 == 1).alias("positive"),
        F.filter(lines, lambda x, i: (i > 0) & (i % 2 == 0)).alias("negative"))


def fx_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("cluster"))


def fx_vec_queries(spark, d) -> DataFrame:
    """Every vector; its positives are the first two of the next 30 vectors
    with its label."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    near = e.select("vec_id", "cluster", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k"))
    other = e.select(F.col("vec_id").alias("pid"), "cluster")
    pos = (near.withColumn("pid", F.col("vec_id") + F.col("k")).join(other, ["pid", "cluster"])
           .groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list("pid")), 1, 2).alias("positive_ids")))
    return e.join(pos, "vec_id", "left").select(
        "vec_id", "cluster", F.coalesce("positive_ids", F.array().cast("array<bigint>")).alias("positive_ids"))


def fx_token_vectors(spark, d) -> DataFrame:
    """Every 32 vectors in a row are the tokens of one document."""
    return table(spark, d, "embeddings").select(
        F.expr("vec_id div 32").alias("doc"), F.expr("vec_id % 32").alias("pos"),
        F.when(F.col("vec_id") % 4 == 0, 0).otherwise(1).alias("mask"), "embedding")


def fx_sts(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("e1"), F.col("label").alias("la"))
    b = e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("e2"), F.col("label").alias("lb"))
    return a.join(b, "id").select(
        "id", "e1", "e2",
        F.when(F.col("la") == F.col("lb"), F.lit(5.0) - (F.col("id") % 3))
        .otherwise((F.col("id") % 3) * 1.0).cast("double").alias("gold"))


def fx_bitext(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    a = b.select("item_id", F.col("text").alias("t1"))
    c = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("t2"))
    return a.join(c, "item_id")


def fx_parallel(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("s"))
    return g.select("conv_id", F.col("s.text").alias("sentences"), F.col("s.role").alias("labels"))


def fx_scores(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    j = docs.join(table(spark, d, "labels"), "doc_id")
    return j.groupBy(
        "lang", F.concat(F.col("lang"), (F.col("doc_id") % 2).cast("string")).alias("code"),
        F.col("source").alias("dataset")).agg(F.avg("quality").alias("score"))


def fx_eval_steps(spark, d) -> DataFrame:
    ev = table(spark, d, "events")
    step = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("int")
    return ev.groupBy(step.alias("step"), F.col("event_type").alias("metric")).agg(
        F.avg("value").alias("score"))
