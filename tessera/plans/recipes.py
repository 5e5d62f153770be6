"""Recipes: how a source becomes training examples.

A recipe is a row of the registry: the ordered steps from the rows of a source
to its examples, how negatives are mined for them, and the languages it is
repeated for.  ``build_examples`` and ``run_recipe`` interpret such rows; each
step is one of ``STEPS``, a thin call of a library operator.  All languages of a
recipe are built in one plan: rows carry ``lang`` and copies are looked for
within a language.

Inputs are a dict of DataFrames.  ``rows`` (most recipes) holds all splits of
the source with a unique bigint ``row_id``; ``judged`` recipes read ``qrels``,
``corpus`` and ``queries``.  With ``languages`` every input has a ``lang``."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import builders as B
from tessera.operators import dedup as D
from tessera.operators import filters as P
from tessera.operators import joins
from tessera.operators import mining as M
from tessera.operators.ranking import dense_index
from tessera.sources import io


@dataclass(frozen=True)
class Recipe:
    name: str
    steps: tuple[tuple, ...]
    mining: str = M.COPY
    languages: tuple[str, ...] = ()
    keep: tuple[str, ...] = ("row_id",)


# fixed values: languages of the two multilingual passage sets
MR_TYDI = ("ar", "bn", "en", "id", "fi", "ko", "ru", "sw", "te", "th", "ja")
MIRACL = ("ar", "bn", "en", "es", "fa", "fi", "fr", "hi", "id", "ja", "ko", "ru", "sw", "te", "th", "zh", "de", "yo")
# fixed values: label texts
COUNTERFACTUAL = {"not-counterfactual": "not-counterfactual", "counterfactual": "counterfactual"}
REVIEW = {0: "Poor", 1: "Fair", 2: "Good", 3: "Very good", 4: "Excellent"}


@dataclass
class Work:
    """What a step sees: the inputs by name and the rows it goes on with."""

    recipe: Recipe
    inputs: dict[str, DataFrame]
    rows: DataFrame | None
    cfg: D.MinHashConfig

    @property
    def within(self):
        return ["lang"] if self.recipe.languages else []

    @property
    def keep(self):
        return [*self.recipe.keep, *self.within]


def _single(df: DataFrame) -> DataFrame:
    """The first positive as a column of its own, for a later dedup."""
    return df.withColumn("full_positive", F.element_at("positive", 1))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    return dense_index(df.drop("row_id"), list(order), out="row_id")


def _dedup(w: Work, column: str) -> DataFrame:
    return D.dedup_columns(w.rows, "row_id", [column], w.cfg, within=w.within)


def _dedup_input(w: Work, name: str, key: str, column: str) -> None:
    w.inputs[name] = D.stored(D.dedup(w.inputs[name], key, column, w.cfg, within=w.within), "input")


def _flatten(w: Work, sentences: str, labels: str) -> DataFrame:
    flat = B.flatten_parallel_arrays(w.rows, sentences, labels, keep=("row_id",)).withColumnRenamed("row_id", "parent")
    return _numbered(flat, "parent", "pos")


def _clusters(w: Work, text: str, group: str, prefixes: bool = False) -> DataFrame:
    rows = P.min_group_size(w.rows, group, 5)
    out = B.build_chunked_cluster_examples(rows, text, group, "row_id", cap=3000, chunk=32, max_chunks=16, seed=0,
                                           cluster_expr=tx.category_prefixes if prefixes else None)
    return _numbered(out, group, "chunk").select("row_id", "query", "positive", "cluster")


def _judged(w: Work) -> DataFrame:
    out = joins.retrieval_examples(w.inputs["qrels"], w.inputs["corpus"], w.inputs["queries"], order="row")
    return _numbered(out, "query_id")


STEPS: dict[str, Callable[..., DataFrame | None]] = {
    "first": lambda w, n: io.scan_split_slice(w.rows, n, "row_id"),
    "equals": lambda w, column, value: P.label_equals(w.rows, column, value),
    "at_least": lambda w, column, least: P.score_threshold(w.rows, column, least),
    "length": lambda w, column, lo, hi: P.length_between(w.rows, column, lo, hi),
    "pos_and_neg": lambda w: P.require_pos_neg(w.rows),
    "positive": lambda w: P.require_pos_neg(w.rows, negative=None),
    "dedup": _dedup,
    "dedup_input": _dedup_input,
    "flatten": _flatten,
    "pairs": lambda w, query, positive: _single(B.build_pairs(w.rows, query, positive, keep=w.keep)),
    "set": lambda w, column: _single(B.build_pairs_from_set(w.rows, column, keep=w.keep)),
    "qa": lambda w, *columns: B.build_multi_positive_qa(w.rows, *columns, keep=w.keep),
    "labels": lambda w, text, label: B.build_label_examples(w.rows, text, label, keep=w.keep),
    "fixed_labels": lambda w, text, label, texts: B.build_fixed_label_examples(w.rows, text, label, texts, keep=w.keep),
    "bitext": lambda w, column: B.build_bitext_pairs(w.rows, column, "row_id", keep=w.keep),
    "passages": lambda w: B.build_passage_examples(w.rows, keep=w.keep),
    "lists": lambda w: B.wrap_scalar_lists(w.rows),
    "clusters": _clusters,
    "judged": _judged,
    "ring": lambda w, text, label: B.classification_to_clustering(w.rows, text, label, "row_id", window=16, seed=0),
}


def _build(recipe: Recipe, inputs: dict[str, DataFrame], cfg: D.MinHashConfig) -> Work:
    if recipe.languages:
        inputs = {name: df.where(F.col("lang").isin(*recipe.languages)) for name, df in inputs.items()}
    w = Work(recipe, dict(inputs), inputs.get("rows"), cfg)
    for name, *args in recipe.steps:
        out = STEPS[name](w, *args)
        w.rows = w.rows if out is None else out
    helpers = [c for c in ("full_positive", "full_answer") if c in w.rows.columns]
    w.rows = w.rows.drop(*helpers)
    return w


def build_examples(recipe: Recipe, inputs: dict[str, DataFrame], cfg: D.MinHashConfig = D.REFERENCE_CALLER) -> DataFrame:
    """The examples of a recipe before mining."""
    return _build(recipe, inputs, cfg).rows


def run_recipe(recipe: Recipe, inputs: dict[str, DataFrame], cfg: D.MinHashConfig = D.REFERENCE_CALLER,
               encode: M.Encode = M.word_counts) -> DataFrame:
    """The examples of a recipe, mined as its ``mining`` says: every language
    over a corpus of its own.  The built examples are stored once, since the
    corpus, the queries and the result read them."""
    w = _build(recipe, inputs, cfg)
    if recipe.mining == M.COPY:
        return w.rows
    built = D.stored(w.rows, "built")
    corpus = w.inputs.get("corpus")
    if not recipe.languages:
        return M.mine_negatives(built, recipe.mining, encode, corpus, cfg)
    own = [F.col("lang") == lang for lang in recipe.languages]
    return functools.reduce(DataFrame.unionByName, [
        M.mine_negatives(built.where(o), recipe.mining, encode, None if corpus is None else corpus.where(o), cfg) for o in own])


def _label_recipe(name: str) -> Recipe:
    return Recipe(name, (("labels", "text", "label_text"), ("dedup", "query")))


def _cluster_recipe(name: str, text: str, group: str, lo: int, hi: int | None, prefixes: bool = False,
                    before: tuple[tuple, ...] = ()) -> Recipe:
    return Recipe(name, (*before, ("length", text, lo, hi), ("dedup", text), ("clusters", text, group, prefixes)), "same_cluster")


_JUDGED = (("dedup_input", "corpus", "_id", "text"), ("dedup_input", "queries", "_id", "text"), ("judged",))
_NESTED = (("flatten", "sentences", "labels"),)

RECIPES = {r.name: r for r in [
    Recipe("beir", _JUDGED, "positive_ids"),
    Recipe("vihealthqa", _JUDGED, "positive_ids"),
    Recipe("pubmedqa", (("qa", "question", "contexts", "long_answer", "final_decision"), ("dedup", "full_answer")), "none"),
    Recipe("pqa", (("first", 500_000), ("set", "set"), ("dedup", "full_positive"), ("dedup", "query")), "none"),
    Recipe("snli", (("equals", "label", 0), ("pairs", "premise", "hypothesis"), ("dedup", "full_positive"), ("dedup", "query")), "none"),
    Recipe("squad", (("pairs", "question", "context"), ("dedup", "query")), "none"),
    Recipe("sts", (("at_least", "score", 3), ("pairs", "sentence1", "sentence2"), ("dedup", "query"), ("dedup", "full_positive")), "none"),
    Recipe("amazon_counterfactual", (("fixed_labels", "text", "label_text", COUNTERFACTUAL), ("dedup", "query"))),
    Recipe("amazon_review", (("fixed_labels", "text", "label", REVIEW), ("dedup", "query"))),
    *(_label_recipe(n) for n in ("banking77", "emotion", "imdb", "mtop_intent", "toxic_conversations", "tweet_sentiments")),
    _cluster_recipe("arxivS2S", "title", "category", 20, None, prefixes=True),
    _cluster_recipe("arxivP2P", "abstract", "category", 100, 2000, prefixes=True),
    *(_cluster_recipe(f"{n}S2S", "title", "category", 20, None) for n in ("biorxiv", "medrxiv")),
    *(_cluster_recipe(f"{n}P2P", "abstract", "category", 100, 2000) for n in ("biorxiv", "medrxiv")),
    _cluster_recipe("20newsgroups", "text", "label", 100, 2000),
    *(_cluster_recipe(f"{n}_clustering", "sentence", "label", 50, 2000, before=_NESTED) for n in ("reddit", "stackexchange")),
    Recipe("nllb", (("bitext", "translation"), ("dedup", "query"), ("dedup", "full_positive")), "none"),
    Recipe("mr-tydi", (("passages",), ("pos_and_neg",), ("dedup", "query")), languages=MR_TYDI),
    Recipe("miracl", (("passages",), ("pos_and_neg",), ("dedup", "query")), languages=MIRACL),
    Recipe("dureader", (("lists",),), "none", ("zh",)),
    Recipe("t2ranking", (("lists",),), "none", ("zh",)),
    # pairs and labels of any source
    Recipe("qa_pairs", (("length", "query", 0, None), ("pairs", "query", "positive")), keep=("conv_id", "turn")),
    Recipe("classification", (("ring", "text", "label_text"), ("positive",)), "other_queries"),
]}
