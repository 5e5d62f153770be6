"""Exact substring dedup by content-cut phrases and window hashes, in place of a
greedy relative Lempel-Ziv parse: no longest-match factors are formed.

A window is ``window`` consecutive words.  A word goes if some window over it
also starts in a document with a smaller id.  The reference is the text of all
smaller ids; it is cut into phrases, indexed in blocks, and every document is
looked up in it:

1. *Phrases.*  Each window has an anchor, the smallest hash of the 5-word runs
   in it; windows in a row with one anchor make a phrase.  A phrase depends on
   its words alone, so a passage that two documents share is cut alike in both
   but for its ends.
2. *Index.*  Phrases meet by anchor hash: a block of the reference is a hash
   range of anchors, which Spark shuffles.  Each task has first merged the
   equal phrases it has read, so a passage that stands in a third of all
   documents sends one row per task; an anchor with many different phrases in
   a task sends two that stand for them, and those phrases go straight to 4.
3. *Copied phrases.*  A phrase whose words an earlier document has is copied
   from it: all its windows are duplicates.
4. *Boundaries.*  Where an earlier document has the anchor but no such phrase, a
   repeat may end inside the phrase.  The windows of those phrases
   alone are looked up one by one, in the same way.

Words are compared by hashes of 128 bits (anchor and phrase, or two window
hashes).  What comes back to a text is the set of contents it copies; they
count wherever the text has them, so a content is sent once per text, and rows
that repeat an id cannot mix their marks.

Defined cases: a null text has no words; a row with a null id loses nothing
and is no reference; rows that repeat an id are never each other's reference;
a text with fewer words than a window stays whole; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import text_slices, utf8
from tessera.llm.wordhash import Sequences, Words, hash_words, mix, ngrams, sliding_min
from tessera.session import scratch_path

ANCHOR = 5
U = np.uint64


def _staged(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.parquet(path)


class Phrases:
    """The phrases of some texts: text number, first window, windows, hashes."""

    def __init__(self, w: Words, window: int):
        n = len(w)
        empty = np.empty(0, dtype=np.int64)
        self.words, self.window = w, window
        self.doc = self.start = self.size = self.at = empty
        self.anchor = self.content = empty.astype(U)
        if n < window:
            return
        h1, h2 = w.hashes
        low = sliding_min(ngrams(h1, ANCHOR), window - ANCHOR + 1)
        whole = w.doc[: n - window + 1] == w.doc[window - 1:]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (low[1:] != low[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            return
        last = whole.copy()
        last[:-1] &= ~whole[1:] | new[1:]
        self.at, self.size = at, np.flatnonzero(last) - at + 1
        self.doc, self.start = w.doc[at], w.pos[at]
        self.anchor = low[at]
        self.content = Sequences(h2).of(at, at + self.size + window - 1)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: Kinds of rows that a task sends: to be looked up; settled in the task as a
#: duplicate; of a crowded key, so to be looked up window by window; and what
#: stands for a crowd among the rows of its key.
OPEN, SETTLED, CROWDED, SUMMARY = range(4)
CROWD = 16


def _settle(ids: np.ndarray, a: np.ndarray, b: np.ndarray, split_crowds: bool) -> tuple[np.ndarray, ...]:
    """Merges the rows of one task.  A text sends a content once; of equal
    (a, b) only that of the smallest id stays open.  With ``split_crowds``, a
    key ``a`` with more than ``CROWD`` open rows keeps two summaries; its
    contents differ, so its rows need no lookup by key to know that their
    windows do.  Settled and crowded rows get keys of their own, so no key
    gathers more than a few rows of a task."""
    order = np.lexsort((ids, b, a))
    ids, a, b = ids[order], a[order], b[order]
    same = np.zeros(len(a), dtype=bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    once = ~same
    once[1:] |= ids[1:] != ids[:-1]
    ids, a, b, same = ids[once], a[once], b[once], same[once]
    kind = np.where(same, SETTLED, OPEN)
    more = ()
    if split_crowds:
        at = np.flatnonzero(~same)
        first = np.flatnonzero(np.append(True, a[at][1:] != a[at][:-1]))
        size = np.diff(np.append(first, len(at)))
        many = size > CROWD
        first, size = first[many], size[many]
        rows = at[_expand(first, size)]
        if len(rows):
            starts = np.cumsum(size) - size
            keys = a[at[first]]
            more = [(f(ids[rows], starts), keys, f(_signed(b[rows]), starts).view(U)) for f in (np.minimum.reduceat, np.maximum.reduceat)]
            kind[rows] = CROWDED
    a = np.where(kind == OPEN, a, mix(ids.view(U) * U(0x9E3779B97F4A7C15) + b))
    kinds = [kind, *(np.full(len(m[0]), SUMMARY) for m in more)]
    return (*(np.concatenate(x) for x in zip((ids, a, b), *more)), np.concatenate(kinds))


def _emit(parts: list[tuple[np.ndarray, ...]], split_crowds: bool):
    ids, a, b, kind = _settle(*(np.concatenate(x) for x in zip(*parts)), split_crowds)
    for at in range(0, len(ids), 65536):
        cut = slice(at, at + 65536)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[cut]), pa.array(_signed(a[cut])), pa.array(_signed(b[cut])), pa.array(kind[cut].astype(np.int32))],
            ["id", "a", "b", "kind"])


def _merged(batches, rows_of, split_crowds: bool, flush_rows: int = 400_000):
    """Output of ``rows_of`` over slices, merged over many slices at a time."""
    parts, size = [], 0
    for b in text_slices(batches):
        got = rows_of(b)
        parts.append(got)
        size += len(got[0])
        if size >= flush_rows:
            yield from _emit(parts, split_crowds)
            parts, size = [], 0
    if size:
        yield from _emit(parts, split_crowds)


_ROW = "id long, a long, b long, kind int"


def _phrase_rows(window: int):
    def rows_of(b: pa.RecordBatch):
        ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        p = Phrases(hash_words(utf8(b.column(1)), 2), window)
        return ids[p.doc], p.anchor, p.content

    return lambda batches: _merged(batches, rows_of, True)


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for each."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _pairs(doc: np.ndarray, content: np.ndarray) -> np.ndarray:
    """(text, content) as one number."""
    return content * U(0x9E3779B97F4A7C15) ^ mix(doc.astype(U))


def _marked(doc: np.ndarray, content: np.ndarray, marks: pa.Array) -> np.ndarray:
    """Which (text, content) are among the marks, a list of contents per text."""
    marks = marks.fill_null([]) if marks.null_count else marks
    told = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    whose = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
    return np.isin(_pairs(doc, content), _pairs(whose, told))


def _boundary_rows(window: int):
    def rows_of(b: pa.RecordBatch):
        ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        w = hash_words(utf8(b.column(1)), 2)
        p = Phrases(w, window)
        i = np.flatnonzero(_marked(p.doc, p.content, b.column(2)))  # column 3 is the rest of the row
        at = _expand(p.at[i], p.size[i])
        h1, h2 = (Sequences(h).of(at, at + window) for h in w.hashes)
        return ids[w.doc[at]], h1, h2

    return lambda batches: _merged(batches, rows_of, False)


def _kept_batches(window: int, keep_text: bool):
    """Last pass: words under a marked phrase or window go."""
    passed = ["text"] * keep_text + ["doc"]

    def run(batches):
        for b in text_slices(batches):
            texts = utf8(b.column(0))
            phrases, windows = b.column(1), b.column(2)
            w = hash_words(texts, 2)
            gone = np.zeros(len(w) + 1, dtype=np.int64)  # +1 where cover begins, -1 behind its end
            if phrases.null_count < len(phrases):
                p = Phrases(w, window)
                i = np.flatnonzero(_marked(p.doc, p.content, phrases))
                np.add.at(gone, p.at[i], 1)
                np.add.at(gone, p.at[i] + p.size[i] + window - 1, -1)
            if windows.null_count < len(windows) and len(w) >= window:
                at = np.flatnonzero(w.doc[: len(w) - window + 1] == w.doc[window - 1:])
                at = at[_marked(w.doc[at], Sequences(w.hashes[1]).of(at, at + window), windows)]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            dead = np.cumsum(gone[:-1]) > 0
            kept, spans = [], []
            for d, t in enumerate(texts):
                lo, n = w.first[d], w.count[d]
                x = dead[lo:lo + n]
                words = t.split()
                if x.any():
                    edge = np.flatnonzero(np.diff(x.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                    words = [words[i] for i in np.flatnonzero(~x)]
                else:
                    spans.append([])
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in passed), pa.array(w.count), pa.array(kept, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                [*passed, "n_words", "kept", "spans"])

    return run


def _first_holders(rows: DataFrame, n: int) -> DataFrame:
    """Rows with a copy elsewhere: ``copied`` if an earlier holder of the same
    content is known, ``contested`` if the key has other contents.  One shuffle
    by ``a``."""
    mine = Window.partitionBy("a")
    seen = F.col("kind").isin(OPEN, SUMMARY)
    x = rows.repartition(n, "a").withColumns({
        "first_id": F.min(F.when(seen, F.col("id"))).over(mine), "last_id": F.max(F.when(seen, F.col("id"))).over(mine),
        "low": F.min(F.when(seen, F.col("b"))).over(mine), "high": F.max(F.when(seen, F.col("b"))).over(mine),
    }).where((F.col("kind") != SUMMARY) & ((F.col("kind") != OPEN) | (F.col("first_id") < F.col("last_id"))))
    holder = F.min(F.when(F.col("kind") == OPEN, F.col("id"))).over(Window.partitionBy("a", "b"))
    copied = (F.col("kind") == SETTLED) | ((F.col("kind") == OPEN) & (holder < F.col("id")))
    return x.select("id", "b", copied.alias("copied"),
                    ((F.col("kind") == CROWDED) | (F.col("low") < F.col("high"))).alias("contested"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 13, carry: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """Per row: ``doc`` (struct of the columns ``carry``; default the id),
    ``n_words``, ``kept`` (kept words joined by one space) and ``spans``
    (removed word ranges, end exclusive); ``keep_text`` adds the text as it
    was."""
    if window < ANCHOR:
        raise ValueError(f"window must be at least {ANCHOR}")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.struct(*[F.col(c) for c in (carry or [id_col])])
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), own.alias("doc"))
    texts = base.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text")
    found = _staged(_first_holders(texts.mapInArrow(_phrase_rows(window), _ROW), n)
                    .where("copied or contested").select("id", "b", "copied"), "phrases")

    by_id = base.where(F.col("id").isNotNull()).repartition(n, "id")  # read twice, shuffled once
    open_ = (found.where(~F.col("copied")).repartition(n, "id").groupBy("id")
             .agg(F.collect_set("b").alias("marks")))
    rows = (by_id.join(open_.hint("shuffle_hash"), "id").select("id", "text", "marks", "doc")
            .mapInArrow(_boundary_rows(window), _ROW))
    windows = _first_holders(rows, n).where("copied").select("id", "b", F.lit(False).alias("whole"))
    whole = found.where("copied").select("id", "b", F.lit(True).alias("whole"))
    marks = (whole.unionByName(windows).repartition(n, "id").groupBy("id")
             .agg(F.collect_set(F.when(F.col("whole"), F.col("b"))).alias("phrases"),
                  F.collect_set(F.when(~F.col("whole"), F.col("b"))).alias("windows")))
    marked = by_id.join(marks.hint("shuffle_hash"), "id", "left").select("text", "phrases", "windows", "doc")
    none = F.lit(None).cast("array<bigint>")
    unnamed = base.where(F.col("id").isNull()).select("text", none.alias("phrases"), none.alias("windows"), "doc")
    doc_type = base.schema["doc"].dataType.simpleString()
    return marked.unionByName(unnamed).mapInArrow(
        _kept_batches(window, keep_text), f"{'text string, ' * keep_text}doc {doc_type}, n_words long, kept string,"
        " spans array<struct<start:int,end:int>>")
