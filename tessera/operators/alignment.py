"""Alignment (pre-training) example routing, prompt rendering and token
masking (L1-L4).  Per-row column expressions; the random draws are md5
uniforms of (seed, tag, row key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.order import uniform
from tessera.plans.registry import EN_NON_CROSS_BATCH, QUESTION_INSTRUCTION, RECONSTRUCT_INSTRUCTION


def select_training_datasets(groups: DataFrame, langs: DataFrame | None, retrieval_only: bool = False) -> DataFrame:
    """Dataset names of the chosen languages (``langs(lang)``; ``None`` =
    all languages), de-duplicated and sorted.  ``retrieval_only`` leaves out
    the English datasets without cross-batch negatives."""
    chosen = groups if langs is None else groups.join(langs, "lang", "left_semi")
    if retrieval_only:
        chosen = chosen.where((F.col("lang") != "en") | ~F.col("name").isin(EN_NON_CROSS_BATCH))
    return chosen.select("name").distinct().orderBy("name")


def alignment_datasets(routes: DataFrame, reconstruct: bool, alignment: bool) -> DataFrame:
    """Names for pre-training: those to reconstruct, those to align, or both;
    neither is an error."""
    if not reconstruct and not alignment:
        raise ValueError("choose reconstruction, alignment or both")
    wanted = ["reconstruct"] * reconstruct + ["passage2query", "query2passage"] * alignment
    return routes.where(F.col("route").isin(wanted)).select("name", "route").orderBy("name")


def route_alignment_task(examples: DataFrame, routes: DataFrame, instructions: DataFrame | None = None,
                         seed: int = 777, key: str = "row_id", dataset: str = "dataset") -> DataFrame:
    """Per example: ``(route, query, answer, instruction)``.

    - reconstruct: ``(query, reconstruct instruction)``, no answer;
    - passage->query: u1 < 0.3 -> ``(query -> positive)`` with the dataset
      instruction; else u2 < 0.4 -> reconstruct the positive; else
      ``(positive -> query)`` with the question-writing instruction;
    - query->passage: u1 < 0.1 -> reconstruct the query; else
      ``(query -> positive)`` with the dataset instruction.
    The positive is element ``1 + floor(u3 * size)``; examples of the two
    pair routes without any positive are dropped.  Examples of a dataset
    without a route are reported: route, answer and instruction are null."""
    j = examples.join(routes.withColumnRenamed("name", dataset), dataset, "left")
    if instructions is not None:
        j = j.join(instructions, dataset, "left")
    else:
        j = j.withColumn("instruction", F.lit(""))
    u1, u2, u3 = (uniform(seed, t, key) for t in ("u1", "u2", "u3"))
    n = F.size("positive")
    pos = F.try_element_at("positive", (F.floor(u3 * n) + 1).cast("int"))
    rt = F.col("route")
    rec = F.lit(RECONSTRUCT_INSTRUCTION)
    dins = F.coalesce(F.col("instruction"), F.lit(""))
    p2q_a, p2q_b = (u1 < 0.3), (u2 < 0.4)
    q2p_a = u1 < 0.1
    query = (F.when(rt == "reconstruct", F.col("query"))
             .when(rt == "passage2query", F.when(p2q_a, F.col("query")).otherwise(pos))
             .otherwise(F.col("query")))
    answer = (F.when(rt == "reconstruct", F.lit(None).cast("string"))
              .when(rt == "passage2query", F.when(p2q_a, pos).when(p2q_b, F.lit(None).cast("string")).otherwise(F.col("query")))
              .otherwise(F.when(q2p_a, F.lit(None).cast("string")).otherwise(pos)))
    instr = (F.when(rt == "reconstruct", rec)
             .when(rt == "passage2query", F.when(p2q_a, dins).when(p2q_b, rec).otherwise(F.lit(QUESTION_INSTRUCTION)))
             .otherwise(F.when(q2p_a, rec).otherwise(dins)))
    kept = j.where(rt.isNull() | (rt == "reconstruct") | (n > 0))
    return kept.select(key, dataset, "route", query.alias("query"), F.when(rt.isNotNull(), answer).alias("answer"),
                       F.when(rt.isNotNull(), instr).alias("instruction"))


def render_prompts(df: DataFrame, tokens: DataFrame, backbone: str, instruction: str = "instruction",
                   query: str = "query", candidate: str | None = "candidate") -> DataFrame:
    """Query: ``bos + "{instruction}." + "\\n{example}" + eos``; candidate:
    ``bos + "{instruction}. Candidate:\\n{example}" + eos``."""
    row = tokens.where(F.col("backbone") == backbone).select("bos", "eos").limit(2).collect()
    if len(row) != 1:
        raise KeyError(backbone)
    bos, eos = F.lit(row[0]["bos"]), F.lit(row[0]["eos"])
    j = df
    out = j.withColumn("query_prompt", F.concat(bos, F.col(instruction), F.lit(".\n"), F.col(query), eos))
    if candidate:
        out = out.withColumn("candidate_prompt",
                             F.concat(bos, F.col(instruction), F.lit(". Candidate:\n"), F.col(candidate), eos))
    return out


def mask_tokens(df: DataFrame, tokens: str, key: str, mask_id: int, p: float = 0.15, seed: int = 0,
                pad_to: str | None = None, pad_id: int = 0, label_pad: int = -100) -> DataFrame:
    """Labels = tokens (padding -> ``label_pad``); input tokens replaced by
    ``mask_id`` with probability ``p`` (never padding); an independent draw
    zeroes the attention with probability ``p``."""
    tok = F.col(tokens)
    if pad_to:
        padn = F.greatest(F.col(pad_to) - F.size(tok), F.lit(0))
        tok = F.concat(tok, F.array_repeat(F.lit(pad_id), padn))
        real = F.size(F.col(tokens))
    else:
        real = F.size(tok)
    d = df.withColumn("_tok", tok).withColumn("_real", real)
    ui = lambda i: uniform(seed, "in", key, i)
    ua = lambda i: uniform(seed, "att", key, i)
    ids = F.transform("_tok", lambda x, i: F.when((i < F.col("_real")) & (ui(i) < p), F.lit(mask_id)).otherwise(x))
    att = F.transform("_tok", lambda x, i: F.when((i >= F.col("_real")) | (ua(i) < p), F.lit(0)).otherwise(F.lit(1)))
    lab = F.transform("_tok", lambda x, i: F.when(i >= F.col("_real"), F.lit(label_pad)).otherwise(x))
    return d.withColumn("input_ids", ids).withColumn("attention_mask", att).withColumn("labels", lab).drop("_tok", "_real")
