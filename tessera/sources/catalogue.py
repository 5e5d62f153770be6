"""Instruction catalogues given as files (J3, J4): nested documents
``{language: {dataset: {instruction, task_type}}}``, one per line, become rows;
what is wrong with them becomes rows too, and lookups go along a chain of
languages.  The language ``*`` holds entries for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "map<string,map<string,struct<instruction:string,task_type:string>>>"
ANY = "*"


def scan_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(entries, bad)``: ``(lang, dataset, instruction, task_type)`` for every
    entry, repeated ones included, and the lines that are no catalogue."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", DOCUMENT).alias("doc"))
    inner = lines.where(F.col("doc").isNotNull()).select(F.explode("doc").alias("lang", "tasks"))
    entries = inner.select("lang", F.explode("tasks").alias("dataset", "entry")).select(
        "lang", "dataset", "entry.instruction", "entry.task_type")
    return entries, lines.where(F.col("doc").isNull()).select(F.col("value").alias("line"))


def catalogue_problems(entries: DataFrame, languages: DataFrame, cells: DataFrame, chain=("lang", ANY)) -> DataFrame:
    """``(kind, lang, dataset, n)``: entries that stand more than once with
    their number, languages not in ``languages(lang)`` with the number of
    their entries, entries without an instruction, and cells that no step of
    the chain finds."""
    some = F.lit(None).cast("string")
    twice = entries.groupBy("lang", "dataset").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate").alias("kind"), "lang", "dataset", "n")
    unknown = entries.where(F.col("lang") != ANY).join(languages, "lang", "left_anti").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("unknown language").alias("kind"), "lang", some.alias("dataset"), "n")
    empty = entries.where(F.trim(F.coalesce("instruction", F.lit(""))) == "").groupBy("lang", "dataset").agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("no instruction").alias("kind"), "lang", "dataset", "n")
    lost = catalogue_lookup(cells, entries, chain).where(F.col("instruction").isNull()).groupBy("lang", "dataset").agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("not found").alias("kind"), "lang", "dataset", "n")
    return twice.unionByName(unknown).unionByName(empty).unionByName(lost)


def catalogue_lookup(cells: DataFrame, entries: DataFrame, chain=("lang", ANY)) -> DataFrame:
    """``cells`` with ``instruction``, ``task_type`` and ``found_in``: the first
    step of the chain that has an entry with an instruction.  A step is
    ``lang``, the cell's own language, or a fixed one.  Of repeated entries the
    smallest instruction counts."""
    one = (entries.where(F.trim(F.coalesce("instruction", F.lit(""))) != "").groupBy("lang", "dataset")
           .agg(F.min(F.struct("instruction", "task_type")).alias("entry")))
    out, steps = cells, []
    for i, step in enumerate(chain):
        at = F.col("lang") if step == "lang" else F.lit(step)
        have = one.select(F.col("lang").alias("_lang"), F.col("dataset").alias("_dataset"),
                          F.struct("entry.*", F.col("lang").alias("found_in")).alias(f"_e{i}"))
        out = out.join(have, (at == F.col("_lang")) & (F.col("dataset") == F.col("_dataset")), "left").drop("_lang", "_dataset")
        steps.append(f"_e{i}")
    found = F.coalesce(*steps)
    return out.withColumns({c: found[c] for c in ("instruction", "task_type", "found_in")}).drop(*steps)
