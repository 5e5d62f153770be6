"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text accepts exactly the strings
that occur in it.  A text is parsed greedily against each: a phrase is the
longest piece, from where the last one ended, that occurs in the language's
text (or one symbol that never does).  A phrase costs about the logarithm of the
length of the text it points into, so the phrases are normalised by it per
symbol, and the language needing the fewest wins.

The parse only walks forward, so the automaton becomes a table: from a state by
a symbol to the next state, and where no edge leads on, from the root anew with
a mark, the start of a phrase.  Many pieces of text walk it side by side (one
numpy step moves all by a symbol); a piece ends every ``PIECE`` symbols of any
text, and a phrase with it.

Texts are lower-cased, and runs of other characters than letters become one
space; symbols are the UTF-8 bytes of that.

It learns from a bounded sample: per language the ``segments`` pieces of
``segment_bytes`` bytes with the smallest hashes, out of all pieces of all its
labelled texts (equal pieces count once).  Tables of ``block_langs`` languages
are broadcast at a time, and every text keeps its best over the blocks.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text if nothing was learnt; null ids and null languages teach nothing;
a tie goes to the first language by name; repeated rows are judged one by one;
languages whose texts have no letter are not learnt.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.rows import text_slices

PIECE = 4096
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_NEW = np.uint32(1 << 31)  # marks the start of a phrase


@dataclass(frozen=True)
class Settings:
    segments: int = 64
    segment_bytes: int = 512
    block_langs: int = 8
    folds: int = 4
    held_out_fold: int = 2


def symbols(text: str | None) -> bytes:
    return _OTHER.sub(" ", (text or "").lower()).strip().encode()


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


# ---------------------------------------------------------------- learning
def _smallest(settings: Settings):
    """Of ``(lang, text)`` the pieces with the smallest hashes per language in
    this task; ``heap`` holds negated hashes, so the largest is on top."""
    size, most = settings.segment_bytes, settings.segments

    def run(batches):
        heaps: dict[str, list] = {}
        have: dict[str, set] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not has_letter(text):
                    continue
                body = symbols(text)
                heap, seen = heaps.setdefault(lang, []), have.setdefault(lang, set())
                for at in range(0, len(body), size):
                    piece = body[at:at + size]
                    h = xxh64_intdigest(piece)
                    if h in seen or len(heap) == most and -heap[0][0] <= h:
                        continue
                    seen.add(h)
                    if len(heap) < most:
                        heapq.heappush(heap, (-h, piece))
                    else:
                        seen.discard(-heapq.heapreplace(heap, (-h, piece))[0])
        rows = [(lang, -h - (1 << 63), piece) for lang, heap in heaps.items() for h, piece in heap]
        if rows:
            lang, h, piece = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array(piece, pa.binary())],
                                             ["lang", "h", "piece"])

    return run


def sample(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(lang, h, piece)`` of the pieces to learn from; ``labelled`` has ``lang, text``."""
    own = labelled.select("lang", "text").mapInArrow(_smallest(settings), "lang string, h long, piece binary").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # a few rows of every task
    return own.withColumn("nth", nth).where(F.col("nth") <= settings.segments).drop("nth")


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Edges of the states of the suffix automaton of a sequence."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    return edges


@dataclass
class Language:
    """``step[state + kind[byte]]`` is the next state (a place in ``step``),
    with the mark ``_NEW`` if a phrase starts there; ``start`` is the state
    from which any symbol starts one."""

    name: str
    kind: np.ndarray
    step: np.ndarray
    start: int
    bits: float  # what a phrase costs


def learn(name: str, pieces: list[bytes]) -> Language:
    """The pieces are joined by a symbol that no text has."""
    used = sorted(set(b"".join(pieces)))
    kind = np.zeros(256, dtype=np.intp)  # 0: a byte that the pieces lack
    kind[used] = np.arange(1, len(used) + 1)
    k = len(used) + 1
    edges = automaton([s for p in pieces for s in [*kind[list(p)].tolist(), -1]])
    n = len(edges)
    table = np.full((n + 1, k), -1, dtype=np.int64)
    for state, out in enumerate(edges):
        for c, to in out.items():
            if c >= 0:
                table[state, c] = to
    anew = np.where(table[0] >= 0, table[0], n) * k + int(_NEW)  # from the root, or to the start state
    step = np.where(table >= 0, table * k, anew[None, :]).astype(np.uint32)
    return Language(name, kind, step.ravel(), n * k, float(np.log2(max(2, sum(map(len, pieces))))))


def _learned(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A language's table, from its bounded sample."""
    x = learn(key[0], [bytes(p) for p in pdf.sort_values("h")["piece"]])
    return pd.DataFrame({"name": [x.name], "kind": [x.kind.astype("<i2").tobytes()], "step": [x.step.astype("<u4").tobytes()],
                         "start": [x.start], "bits": [x.bits]})


# ---------------------------------------------------------------- parsing
def _phrases(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: Language) -> np.ndarray:
    """Phrases of every piece, pieces being sorted by falling size."""
    kinds = x.kind[codes]
    state = np.full(len(starts), x.start, dtype=np.intp)
    count = np.zeros(len(starts), dtype=np.int64)
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # pieces longer than i
    for i, n in enumerate(active):
        v = x.step[state[:n] + kinds[starts[:n] + i]]
        count[:n] += v >> np.uint32(31)
        state[:n] = v & ~_NEW
    return count


def phrase_counts(bodies: list[bytes], languages: list[Language]) -> np.ndarray:
    """Phrases by text and language."""
    size = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    first = np.cumsum(size) - size
    n = -(-size // PIECE)
    doc = np.repeat(np.arange(len(bodies)), n)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
    starts, sizes = first[doc] + at, np.minimum(PIECE, size[doc] - at)
    by = np.argsort(-sizes, kind="stable")
    codes = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    out = np.zeros((len(bodies), len(languages)), dtype=np.int64)
    for j, x in enumerate(languages):
        out[:, j] = np.bincount(doc[by], weights=_phrases(codes, starts[by], sizes[by], x), minlength=len(bodies))
    return out


def _judge(shared, slice_bytes: int = 1 << 22):
    """Carries the best and the second best cost of every text so far."""
    def run(batches: Iterator[pa.RecordBatch]):
        languages = shared.value
        names = [x.name for x in languages]
        bits = np.array([x.bits for x in languages])
        for b in text_slices(batches, slice_bytes):
            texts = b.column(1).to_pylist()
            bodies = [symbols(t) if has_letter(t) else b"" for t in texts]
            cost = phrase_counts(bodies, languages) * bits / np.maximum(1, [[len(x)] for x in bodies])
            best, low, next_low = (b.column(i).to_pylist() for i in (2, 3, 4))
            for i, body in enumerate(bodies):
                if body:
                    ranked = sorted([(low[i], best[i]), *zip(cost[i].tolist(), names)])
                    low[i], best[i] = ranked[0]
                    next_low[i] = min(next_low[i], ranked[1][0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.string()), pa.array(low, pa.float64()),
                                              pa.array(next_low, pa.float64())], ["id", "text", "best", "low", "next_low"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        settings: Settings = Settings()) -> DataFrame:
    """One row per language with its table (``Language``); learns from the
    rows outside the held-out fold."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = d.where(fold("id", settings.folds) != settings.held_out_fold).where("lang is not null")
    return sample(own, settings).groupBy("lang").applyInPandas(
        _learned, "name string, kind binary, step binary, start long, bits double")


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def predict(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            settings: Settings = Settings()) -> DataFrame:
    """``(id_col, lang_pred, score)`` of every row.  The score is the cost of
    the second best language in that of both: 0.5 where they tie, 1 if there
    is no other."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumns({"best": F.lit(UNKNOWN), "low": F.lit(float("inf")), "next_low": F.lit(float("inf"))})
    names = sorted(r["name"] for r in model.select("name").collect())  # one short row per language
    for at in range(0, len(names), settings.block_langs):
        block = names[at:at + settings.block_langs]
        tables = model.where(F.col("name").isin(block)).orderBy("name").collect()
        languages = [Language(r["name"], np.frombuffer(r["kind"], "<i2").astype(np.intp), np.frombuffer(r["step"], "<u4"),
                              r["start"], r["bits"]) for r in tables]
        rows = rows.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(languages)),
                               f"id {kind}, text string, best string, low double, next_low double")
    low, other = F.col("low"), F.col("next_low")
    score = (F.when(low == float("inf"), 0.0).when(other == float("inf"), 1.0)
             .otherwise(other / (low + other)))
    return rows.select(F.col("id").alias(id_col), F.col("best").alias("lang_pred"), score.alias("score"))


def identify(docs: DataFrame, store: str, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document; the fitted
    tables are written to ``store``."""
    fit(docs, settings=settings).write.parquet(store)
    out = predict(docs, docs.sparkSession.read.parquet(store), settings=settings)
    held = fold("doc_id", settings.folds) == settings.held_out_fold
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
