"""Projections and row filters over example tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx


def keep_columns(df: DataFrame, keep) -> DataFrame:
    """Keep a fixed column set (in the given order), drop the complement."""
    return df.select(*[c for c in keep if c in df.columns])


def length_between(df: DataFrame, col: str, lo: int | None, hi: int | None) -> DataFrame:
    return df.where(tx.length_between(col, lo, hi))


def min_word_filter(df: DataFrame, col: str, min_length: int = 5) -> DataFrame:
    """Keep rows with at least ``min_length`` non-word-split pieces (empties count)."""
    if min_length <= 0:
        return df
    return df.where(tx.n_word_pieces(col) >= F.lit(min_length))


def require_pos_neg(df: DataFrame, positive: str = "positive", negative: str | None = "negative") -> DataFrame:
    cond = F.size(positive) > 0
    if negative:
        cond = cond & (F.size(negative) > 0)
    return df.where(cond)


def short_query_predicate(query: str = "query", min_words: int = 3) -> Column:
    return tx.whitespace_words(query) > F.lit(min_words)


def gated_short_query_filter(df: DataFrame, query: str = "query", gate: int = 1000,
                             min_words: int = 3, dataset: str = "dataset") -> DataFrame:
    """Apply the short-query filter to the datasets of more than ``gate`` rows.

    The counts are one row per dataset and join back by name (a null name is a
    dataset too); nothing runs before the result is asked for."""
    counts = df.groupBy(F.col(dataset).alias("_ds")).agg(F.count(F.lit(1)).alias("_n"))
    j = df.join(counts, F.col(dataset).eqNullSafe(F.col("_ds")))
    return j.where((F.col("_n") <= gate) | short_query_predicate(query, min_words)).select(*df.columns)


def clean_funnel(df: DataFrame, dataset: str = "dataset", gate: int = 1000,
                 min_words: int = 3) -> DataFrame:
    """Per dataset: rows before, after non-empty positive, after non-empty
    negative, after the gated short-query filter; one aggregation pass."""
    pos = F.size("positive") > 0
    neg = pos & (F.size("negative") > 0)
    q = neg & short_query_predicate("query", min_words)
    g = df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(pos.cast("long")).alias("n_with_positive"),
        F.sum(neg.cast("long")).alias("n_with_negative"),
        F.sum(q.cast("long")).alias("_n_q"))
    return g.select(dataset, "n_rows", "n_with_positive", "n_with_negative",
                    F.when(F.col("n_with_negative") > gate, F.col("_n_q"))
                    .otherwise(F.col("n_with_negative")).alias("n_final"))


def clean_dataset(df: DataFrame, dataset: str = "dataset", gate: int = 1000, min_words: int = 3) -> DataFrame:
    """The rows the funnel keeps, for all datasets at once: the gate is per
    dataset, taken from the grouped counts (one row per dataset)."""
    kept = df.where((F.size("positive") > 0) & (F.size("negative") > 0))
    return gated_short_query_filter(kept, "query", gate, min_words, dataset)


def label_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def score_threshold(df: DataFrame, col: str, threshold: float, inclusive: bool = True) -> DataFrame:
    return df.where(F.col(col) >= threshold if inclusive else F.col(col) > threshold)


def assert_single_positive(df: DataFrame, positive: str = "positive") -> DataFrame:
    """One-row check: fails at execution unless every row has exactly one positive."""
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.min(F.size(positive)).alias("min_positive"),
                 F.max(F.size(positive)).alias("max_positive"))
    ok = (F.col("min_positive") == 1) & (F.col("max_positive") == 1)
    return agg.select("n_rows", "min_positive", "max_positive",
                      F.when(ok | (F.col("n_rows") == 0), F.lit(True))
                      .otherwise(F.raise_error(F.lit("every row must have exactly one positive"))).alias("ok"))


def min_group_size(df: DataFrame, group: str, min_size: int = 5) -> DataFrame:
    """Keep rows of groups with at least ``min_size`` members: grouped count
    (map-side partial) + semi join, not a window over the whole group."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size).select(group)
    return df.join(big, group, "left_semi")


def select_rows_by_id(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def skip_empty_datasets(registry: DataFrame, rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Datasets of ``registry`` that have rows, with their size; fails if none."""
    sizes = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_rows"))
    out = registry.join(sizes, dataset)
    if out.limit(1).count() == 0:
        raise ValueError("no dataset with rows left")
    return out
