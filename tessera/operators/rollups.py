"""Score roll-ups over a long score table ``(lang, dataset, task, score)``
(R1-R8) and the evaluation lookups (J4, J9).  Score tables are small (one
row per language x dataset x step); all steps are grouped aggregations or
windows over one metric / one language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pick_eval_split(available: DataFrame, priority, dataset: str = "dataset", split: str = "split") -> DataFrame:
    """First available split in ``priority`` per dataset; unknown splits ignored."""
    pr = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(split))
    a = available.select(dataset, split, pr.alias("_p")).where(F.col("_p") > 0)
    return a.groupBy(dataset).agg(F.min_by(split, "_p").alias(split))


def dataset_language_score(scores: DataFrame, agg: str = "avg") -> DataFrame:
    """Mean (or another aggregate) over the language codes of each (lang, dataset)."""
    fn = getattr(F, agg)
    return scores.groupBy("lang", "dataset").agg(fn("score").alias("score"))


def task_average(scores: DataFrame, task: str = "task") -> DataFrame:
    return scores.groupBy(task).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_datasets"))


def language_rollup(cells: DataFrame) -> DataFrame:
    """Mean per language plus the overall mean over all (lang, dataset) cells
    (micro average), as ``rollup(lang)``; the total row has lang 'avg'."""
    r = cells.rollup("lang").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_cells"))
    return r.select(F.coalesce(F.col("lang"), F.lit("avg")).alias("lang"), "score", "n_cells")


def quick_subset(cells: DataFrame, quick: DataFrame, dataset: str = "dataset") -> DataFrame:
    return cells.join(quick.select(dataset), dataset, "left_semi")


def score_sheet(sheet: DataFrame, cells: DataFrame, fallback_langs=("de", "fr", "ja", "ar"),
                zero_langs=("en",)) -> DataFrame:
    """``sheet(lang, pos, dataset)`` (ordered list per language) x scores:
    score x 100; a missing name falls back to ``name + '.v2'`` for the
    fallback languages; missing English cells are 0, other missing cells are
    omitted."""
    c1 = cells.select("lang", "dataset", F.col("score").alias("_s1"))
    c2 = cells.where(F.col("dataset").endswith(".v2")).select(
        "lang", F.expr("substring(dataset, 1, length(dataset) - 3)").alias("dataset"), F.col("score").alias("_s2"))
    j = sheet.join(c1, ["lang", "dataset"], "left").join(c2, ["lang", "dataset"], "left")
    fb = F.col("lang").isin(list(fallback_langs))
    s = F.coalesce(F.col("_s1"), F.when(fb, F.col("_s2")))
    s = F.when(s.isNull() & F.col("lang").isin(list(zero_langs)), F.lit(0.0)).otherwise(s * 100.0)
    return j.select("lang", "pos", "dataset", s.alias("score")).where(F.col("score").isNotNull())


def crosslingual_average(cells: DataFrame) -> DataFrame:
    """Mean per dataset over languages, ignoring null and NaN."""
    ok = F.col("score").isNotNull() & ~F.isnan("score")
    return cells.groupBy("dataset").agg(F.avg(F.when(ok, F.col("score"))).alias("score"),
                                        F.sum(ok.cast("int")).alias("n_langs"))


def best_checkpoint(steps: DataFrame, group: str = "metric") -> DataFrame:
    """Per metric: best step under the strict rule (first step reaching the
    max) and the ``>=`` rule (last), and how many steps each rule saves: those
    that beat (or equal) the best of the steps before, the first one included."""
    w = Window.partitionBy(group).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    run = steps.withColumn("_before", F.max("score").over(w))
    best = steps.groupBy(group).agg(F.max("score").alias("best_score"))
    j = steps.join(best, group).where(F.col("score") == F.col("best_score"))
    pick = j.groupBy(group, "best_score").agg(F.min("step").alias("best_step_strict"),
                                              F.max("step").alias("best_step_ge"))
    first = F.col("_before").isNull()
    improved = run.groupBy(group).agg(
        F.sum((first | (F.col("score") > F.col("_before"))).cast("int")).alias("n_improvements_strict"),
        F.sum((first | (F.col("score") >= F.col("_before"))).cast("int")).alias("n_improvements_ge"))
    return pick.join(improved, group)


def task_instruction_lookup(cells: DataFrame, flat: DataFrame, per_lang: DataFrame, flat_lang: str = "en") -> DataFrame:
    """Instruction per (lang, dataset): the flat catalogue first for
    ``flat_lang`` then the per-language map; other languages use the
    per-language map only; cells without an instruction are skipped."""
    f = flat.select("dataset", F.col("instruction").alias("_fi"))
    p = per_lang.select("lang", "dataset", F.col("instruction").alias("_pi"))
    j = cells.join(f, "dataset", "left").join(p, ["lang", "dataset"], "left")
    ins = F.when(F.col("lang") == flat_lang, F.coalesce("_fi", "_pi")).otherwise(F.col("_pi"))
    return j.select("lang", "dataset", ins.alias("instruction")).where(F.col("instruction").isNotNull())
