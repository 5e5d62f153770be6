"""Example builders: turn source tables into ``(query, positive[], negative[])``
training examples (B1-B15).  All column expressions; the grouped builders
use ranks (no whole-group lists) and collect at most one chunk per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.order import order_key, uniform
from tessera.operators.ranking import rank_in_group


def build_pairs(df: DataFrame, query: str, positive: str, keep=()) -> DataFrame:
    return df.select(*keep, F.col(query).alias("query"), F.array(F.col(positive)).alias("positive"))


def build_pairs_from_set(df: DataFrame, set_col: str = "set", keep=()) -> DataFrame:
    """Element 1 is the query, element 2 the positive."""
    s = F.col(set_col)
    return df.select(*keep, F.element_at(s, 1).alias("query"), F.array(F.element_at(s, 2)).alias("positive"))


def build_multi_positive_qa(df: DataFrame, question: str, contexts: str, long_answer: str,
                            decision: str | None = None, keep=()) -> DataFrame:
    """Contexts joined with a space; answer = ``decision + '. '`` (when the
    column exists) + long answer; positives ``[context, answer]``;
    ``full_answer = answer + ' ' + context``."""
    context = F.array_join(F.col(contexts), " ")
    prefix = F.concat(F.coalesce(F.col(decision), F.lit("")), F.lit(". ")) if decision else F.lit("")
    answer = F.concat(prefix, F.coalesce(F.col(long_answer), F.lit("")))
    return df.select(*keep, F.col(question).alias("query"), F.array(context, answer).alias("positive"),
                     F.concat(answer, F.lit(" "), context).alias("full_answer"))


def label_vocabulary(df: DataFrame, label: str) -> DataFrame:
    """One row with the sorted distinct labels over all rows (all splits)."""
    return df.agg(F.sort_array(F.collect_set(label)).alias("vocabulary"))


def build_label_examples(df: DataFrame, text: str, label_text: str, vocabulary=None, keep=()) -> DataFrame:
    """Classification -> ``(text, [label], all other labels)``.  The vocabulary
    is the label set over the whole input, a scalar subquery, unless given.
    Every example lists all other labels, as its definition asks."""
    if vocabulary is None:
        allv = label_vocabulary(df, label_text).scalar()
    else:
        allv = F.array(*[F.lit(v) for v in sorted(vocabulary)]).cast("array<string>")
    return df.select(*keep, F.col(text).alias("query"), F.array(F.col(label_text)).alias("positive"),
                     F.array_except(allv, F.array(F.col(label_text))).alias("negative"),
                     F.col(label_text).alias("full_positive"))


def build_fixed_label_examples(df: DataFrame, text: str, label: str, id_to_text: dict, keep=()) -> DataFrame:
    """Label id -> text through a fixed map; negatives = the other texts."""
    m = F.create_map(*[x for k, v in sorted(id_to_text.items()) for x in (F.lit(k), F.lit(v))])
    lab = F.element_at(m, F.col(label))
    allv = F.array(*[F.lit(v) for v in sorted(set(id_to_text.values()))])
    return df.select(*keep, F.col(text).alias("query"), F.array(lab).alias("positive"),
                     F.array_except(allv, F.array(lab)).alias("negative"), lab.alias("full_positive"))


def build_bitext_pairs(df: DataFrame, translation: str, key: str, seed: int = 0, keep=()) -> DataFrame:
    """Each two-entry translation map in a random direction (p = 0.5).  The
    draw is ``uniform(seed, key)``: the same on every retry and partitioning."""
    vals = F.map_values(F.col(translation))
    first, second = F.element_at(vals, 1), F.element_at(vals, 2)
    fwd = uniform(seed, "bitext", key) > F.lit(0.5)
    q = F.when(fwd, first).otherwise(second)
    p = F.when(fwd, second).otherwise(first)
    return df.select(*keep, q.alias("query"), F.array(p).alias("positive"), p.alias("full_positive"))


def _passages(col: str):
    return F.transform(F.col(col), lambda x: F.concat_ws("\n", F.coalesce(x["title"], F.lit("")), x["text"]))


def build_passage_examples(df: DataFrame, query: str = "query", positive_passages: str = "positive_passages",
                           negative_passages: str = "negative_passages", keep=()) -> DataFrame:
    """Passage structs -> ``"title\\ntext"`` strings."""
    return df.select(*keep, F.col(query).alias("query"), _passages(positive_passages).alias("positive"),
                     _passages(negative_passages).alias("negative"))


def wrap_scalar_lists(df: DataFrame, cols=("positive", "negative")) -> DataFrame:
    out = df
    for c in cols:
        out = out.withColumn(c, F.array(F.col(c)))
    return out


def flatten_parallel_arrays(df: DataFrame, sentences: str = "sentences", labels: str = "labels",
                            keep=()) -> DataFrame:
    """``sentences[]``/``labels[]`` -> one row each (position kept)."""
    z = F.arrays_zip(F.col(sentences).alias("sentence"), F.col(labels).alias("label"))
    return df.select(*keep, F.posexplode(z).alias("pos", "z")).select(
        *keep, "pos", F.col("z.sentence").alias("sentence"), F.col("z.label").alias("label"))


def flatten_positives_corpus(df: DataFrame, keep=("row_id",)) -> DataFrame:
    return df.select(*keep, F.posexplode("positive").alias("pos", "text"))


def flatten_cluster_corpus(df: DataFrame, keep=("row_id",)) -> DataFrame:
    """Queries and positives, each a row, with their cluster."""
    return df.select(*keep, "cluster", F.posexplode(F.concat(F.array("query"), "positive")).alias("pos", "text"))


def normalize_categories(col) -> "F.Column":
    return tx.category_prefixes(col)


def build_chunked_cluster_examples(df: DataFrame, text: str, group: str, order: str,
                                   cap: int = 3000, chunk: int = 32, max_chunks: int = 16,
                                   seed: int = 0, cluster_expr=None) -> DataFrame:
    """Per group: first ``cap`` texts (by ``order``), cut into chunks of
    ``chunk``, ``max_chunks`` chunks drawn by md5 without replacement; the
    first text of a chunk is the query, the rest its positives.

    Ranks come from a range-partitioned sort (a hot group is spread over
    tasks); the only list built is one chunk (<= ``chunk`` texts)."""
    r = rank_in_group(df.select(group, order), [group], [order], out="rn")  # ids only; texts join the survivors
    r = r.where(F.col("rn") <= cap).withColumn("chunk", F.floor((F.col("rn") - 1) / chunk).cast("bigint"))
    chunks = r.select(group, "chunk").distinct()
    # chunks per group <= cap / chunk, so this window is bounded in size
    w = Window.partitionBy(group).orderBy(order_key(seed, "chunk", group, "chunk"), "chunk")
    picked = chunks.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_chunks).drop("_k")
    members = r.join(picked, [group, "chunk"], "left_semi").join(df.select(group, order, text), [group, order])
    g = members.groupBy(group, "chunk").agg(F.sort_array(F.collect_list(F.struct("rn", text))).alias("_m"))
    cl = cluster_expr(F.col(group)) if cluster_expr is not None else F.col(group)
    return g.select(
        F.col(group), F.col("chunk"),
        F.col("_m")[0][text].alias("query"),
        F.transform(F.slice(F.col("_m"), 2, chunk), lambda x: x[text]).alias("positive"),
        cl.alias("cluster"))


RING_BLOCK = 1024  # ring places whose texts meet in one window


def classification_to_clustering(df: DataFrame, text: str, label: str, key: str,
                                 window: int = 16, seed: int = 0) -> DataFrame:
    """Every text becomes a query; its positives are the next ``window`` label
    mates in an md5 ring order of the label (never itself; all mates when the
    label has at most ``window + 1`` members).  The ring is cut into blocks that
    also hold the ``window`` places after them, so a text travels about once and
    not once per mate, and no per-label list is built.  Rows that repeat a key
    share the mates of all of them."""
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(label).alias("_label"))
    ranked = rank_in_group(base.select("_key", "_label", order_key(seed, "ring", "_key").alias("_ok")),
                           ["_label"], ["_ok", "_key"], out="_r", size_col="_n")
    ranked = ranked.withColumn("_r", F.col("_r") - 1).drop("_ok")
    texts = base.where(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("_text"))).alias("_t"), F.count(F.lit(1)).alias("_c"))
    again = base.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_key")

    size = max(RING_BLOCK, window)
    block = lambda place: F.floor(place / size)
    e, n = F.col("_e"), F.col("_n")
    # the first places of a ring come once more after its last one
    ring = ranked.join(texts, "_key", "left").withColumn("_e", F.explode(
        F.when(F.col("_r") < F.least(F.lit(window), n), F.array("_r", F.col("_r") + n)).otherwise(F.array("_r"))))
    ring = ring.withColumn("_b", F.explode(F.array_distinct(F.array(block(e), block(e - window))))).where("_b >= 0")
    w = Window.partitionBy("_label", "_b").orderBy("_e").rowsBetween(1, window)
    ring = ring.withColumn("_p", F.collect_list(F.struct("_e", "_t")).over(w))
    ring = ring.where((e < n) & (F.col("_b") == block(e)) & (F.col("_c") == 1))
    mates = F.filter("_p", lambda x: (x["_e"] - e < n) & x["_t"].isNotNull())
    out = ring.select("_key", F.col("_t")[0]["_text"].alias("_text"),
                      F.flatten(F.transform(mates, lambda x: F.transform(x["_t"], lambda t: t["_text"]))).alias("_p"), "_label")

    offs = ranked.join(again, "_key", "left_semi").where(n > 1).select(
        "_key", "_label", F.explode(F.sequence(F.lit(1), F.least(F.lit(window), n - 1))).alias("_k"), "_r", "_n")
    offs = offs.withColumn("_tr", F.pmod(F.col("_r") + F.col("_k"), n))
    places = ranked.select("_label", F.col("_r").alias("_tr"), F.col("_key").alias("_mk"))
    mate_texts = base.select(F.col("_key").alias("_mk"), F.col("_text").alias("_mate"))
    shared = offs.join(places, ["_label", "_tr"]).join(mate_texts, "_mk").groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("_k", "_mate"))).alias("_s"))
    no_ring = F.col("_key").isNull() | F.col("_label").isNull()
    rest = base.where(no_ring).unionByName(base.where(~no_ring).join(again, "_key", "left_semi"))
    rest = rest.join(shared, "_key", "left").select(
        "_key", "_text", F.coalesce(F.col("_s._mate"), F.array().cast("array<string>")).alias("_p"), "_label")
    return out.unionByName(rest).select(F.col("_key").alias(key), F.col("_text").alias("query"), F.col("_p").alias("positive"),
                                        F.col("_label").alias("cluster"))
