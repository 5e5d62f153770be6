"""Corpus pipeline over ``documents``: quality rules, SimHash near-dedup,
substring dedup, benchmark decontamination, BPE encoding.

Every stage takes the documents that the one before has kept; all but the last
return the columns of ``documents``.  Null ids and null or empty texts are
defined by each operator; a text that loses words keeps the others, joined by
one space, and its ``n_chars`` follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, rules, simhash, substring
from tessera.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy keeps."""
    book = rules.ledger(docs.select(F.struct("*").alias("doc")), "doc.text", keep=["doc"])
    return book.where(rules.passes(rules.POLICIES[-1])).select("doc.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints: the one with the
    smallest id (rows without an id come last), then the smallest fingerprint,
    then the smallest hash of its columns.  The operator runs on row numbers,
    so rows that share an id, or have none, are told apart."""
    path = scratch_path(spark, "numbered")
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)  # numbers that a second reading repeats
    rows = spark.read.parquet(path)
    own = rows.select(F.col("_row").alias("doc_id"), "text")
    found = simhash.near_duplicates(own).select(F.col("doc_id").alias("_row"), "fingerprint", "component_id")
    keys = rows.select("_row", "doc_id", F.xxhash64(*docs.columns).alias("_hash"))  # no text goes through the join
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("fingerprint").alias("c"),
                     F.col("_hash").alias("d"), F.col("_row").alias("e"))
    first = found.join(keys, "_row").groupBy("component_id").agg(F.min(order).alias("o")).select(F.col("o.e").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document has."""
    rest = [c for c in docs.columns if c != "text"]
    out = substring.remove_repeats(docs, carry=rest, keep_text=True)
    text = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("text"))
    out = out.select("doc.*", text.alias("text"), (F.size("spans") > 0).alias("_cut"))
    if "n_chars" in rest:
        n = F.when(F.col("_cut"), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of ``benchmark``."""
    return decontam.drop_leaking(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)``."""
    out = bpe.encode(docs, TOKENIZER, decode=False)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup),
          ("substring_dedup", substring_dedup), ("benchmark_decontamination", benchmark_decontamination),
          ("bpe_encoding", bpe_encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:  # later stages read a table, not the whole lineage
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
