"""Benchmark decontamination by SimHash of item-sized windows.

A document leaks an item if some window of it, as many words long as the item
(the whole document if that is shorter), has a weighted Jaccard similarity of
at least ``threshold`` with the item over 5-word shingles of A-Z-lower-cased
words, weighted by how often each occurs.

1. A window that similar shares a shingle with the item, so only windows over
   a shared shingle are fingerprinted (lossless).
2. Their SimHash is looked up among the items of that size.  The fingerprint
   is cut into ``(radius + 2) // 2`` blocks; two fingerprints within ``radius``
   bits differ by at most one bit in some block, and items are indexed under
   each block value and its one-bit variants, so all within the radius meet.
3. Every candidate is verified by its exact weighted similarity.

At similarity 0.8 two fingerprints differ in about 9 bits, with a standard
deviation under 3; the default radius of 19 lies more than three of them away.

The benchmark is split by bytes into blocks of ``block_bytes``; each block is
sent to the executors by itself, and documents pass every block.

Defined cases: null or empty items and texts match nothing; an item with
fewer words than a shingle is one shingle; ties between windows go to the
first; repeated items and rows each have results of their own; an empty
benchmark or table gives no leaks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import text_slices, utf8
from tessera.llm.wordhash import hash_words, ngrams
from tessera.session import scratch_path

U = np.uint64
TABLE_BITS = 22
HIT = "array<struct<item_id:bigint,similarity:double,start_word:int,n_words:int>>"
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()),
                                 ("start_word", pa.int32()), ("n_words", pa.int32())]))


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    radius: int = 19
    block_bytes: int = 16 << 20


def _votes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the bits of shingle hashes, from zero."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return sums


def _simhash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    ones = sums[end] - sums[start]
    return np.packbits(2 * ones > (end - start)[:, None], axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class SizeGroup:
    """Items of one size: fingerprints under one-bit block variants."""

    words: int
    shingle: int
    items: np.ndarray
    prints: np.ndarray
    blocks: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def build(self, radius: int) -> None:
        n, at = (radius + 2) // 2, 0
        for j in range(n):
            width = 64 // n + (j < 64 % n)
            own = (self.prints >> U(at)) & U((1 << width) - 1)
            variants = np.concatenate([own, *(own ^ U(1 << b) for b in range(width))]).astype(np.int64)
            who = np.tile(np.arange(len(own)), width + 1)
            order = np.argsort(variants, kind="stable")
            starts = np.searchsorted(variants[order], np.arange((1 << width) + 1))
            self.blocks.append((at, width, starts, who[order]))
            at += width

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (print, item) at most ``radius`` bits apart."""
        found = []
        for at, width, starts, who in self.blocks:
            v = ((prints >> U(at)) & U((1 << width) - 1)).astype(np.int64)
            size = starts[v + 1] - starts[v]
            ends = np.cumsum(size)
            place = np.repeat(starts[v] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            found.append(np.repeat(np.arange(len(prints)), size) * len(self.prints) + who[place])
        pair = np.unique(np.concatenate(found))
        p, i = pair // len(self.prints), pair % len(self.prints)
        near = np.bitwise_count(prints[p] ^ self.prints[i]) <= radius
        return p[near], i[near]


class Benchmark:
    """Index of one block of items."""

    def __init__(self, ids: list, texts: list[bytes], s: Settings):
        self.settings = s
        w = hash_words(texts, lower=True)
        self.ids = ids
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        owner: dict[int, list[tuple[np.ndarray, int]]] = {}
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i in range(len(ids)):
            n = int(w.count[i])
            k = min(s.shingle, n)
            g = ngrams(w.hashes[0][w.first[i]: w.first[i] + n], k) if n else np.empty(0, dtype=U)
            self.bags.append(np.unique(g, return_counts=True))
            if n:
                owner.setdefault(k, []).append((self.bags[i][0], i))
                print_ = _simhash(_votes(g), np.zeros(1, np.int64), np.array([len(g)]))[0]
                groups.setdefault((n, k), []).append((i, print_))
        self.groups = []
        self.group_of = np.full(len(ids), -1)
        for (n, k), members in sorted(groups.items()):
            items = np.array([m[0] for m in members])
            self.group_of[items] = len(self.groups)
            g = SizeGroup(n, k, items, np.array([m[1] for m in members], dtype=U))
            g.build(s.radius)
            self.groups.append(g)
        self.shingles = {}  # k -> (sorted hashes, starts, size groups that have them)
        for k, have in owner.items():
            h = np.concatenate([x for x, _ in have])
            who = np.concatenate([np.full(len(x), self.group_of[i]) for x, i in have])
            both = np.unique(np.stack([h, who.astype(U)]), axis=1)
            keys, starts = np.unique(both[0], return_index=True)
            table = np.zeros(1 << TABLE_BITS, dtype=bool)
            table[keys >> U(64 - TABLE_BITS)] = True
            self.shingles[k] = (keys, np.append(starts, both.shape[1]), both[1].astype(np.int64), table)

    def _windows(self, w, k: int, grams: np.ndarray) -> dict[int, np.ndarray]:
        """Per size group: (first word, words) of windows over a shared shingle."""
        keys, starts, groups, table = self.shingles[k]
        inside = w.doc[: len(grams)] == w.doc[k - 1:]
        at = np.flatnonzero(table[grams >> U(64 - TABLE_BITS)] & inside)
        i = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
        hit = keys[i] == grams[at]
        at, i = at[hit], i[hit]
        size = starts[i + 1] - starts[i]
        ends = np.cumsum(size)
        who = groups[np.repeat(starts[i] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.repeat(at, size)
        out = {}
        for g in np.unique(who):
            here = at[who == g]
            m = self.groups[g].words
            doc = w.doc[here]
            lo, n = w.first[doc], w.count[doc]
            first = np.maximum(here + k - m, lo)
            last = np.maximum(np.minimum(here, lo + n - m), lo)
            first = np.minimum(first, last)
            covered = np.zeros(len(w) + 1, dtype=np.int32)
            np.add.at(covered, first, 1)
            np.add.at(covered, last + 1, -1)
            start = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
            out[int(g)] = np.stack([start, np.minimum(m, w.count[w.doc[start]])])
        return out

    def leaks(self, texts: list[bytes]) -> list[dict[int, tuple[float, int, int]]]:
        """Per text: item -> (similarity, first word, words) of its best window."""
        s = self.settings
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        w = hash_words(texts, lower=True)
        for k in self.shingles:
            grams = ngrams(w.hashes[0], k)
            if not len(grams):
                continue
            for g, (start, words) in self._windows(w, k, grams).items():
                for at in _chunks(start):
                    self._verify(self.groups[g], w, grams, start[at], words[at], best, s)
        return best

    def _verify(self, group: SizeGroup, w, grams, start, words, best, s: Settings) -> None:
        size = words - group.shingle + 1  # shingles
        lo, hi = int(start.min()), int((start + size).max())
        prints = _simhash(_votes(grams[lo:hi]), start - lo, start - lo + size)
        for p, i in zip(*group.within(prints, s.radius)):
            item = int(group.items[i])
            keys, counts = self.bags[item]
            a = int(start[p])
            mine, times = np.unique(grams[a: a + int(size[p])], return_counts=True)
            j = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            common = int(np.minimum(times, counts[j])[keys[j] == mine].sum())
            similarity = common / (int(counts.sum()) + int(size[p]) - common)
            doc = int(w.doc[a])
            place = a - int(w.first[doc])
            have = best[doc].get(item)
            if similarity >= s.threshold and (have is None or (similarity, -place) > (have[0], -have[1])):
                best[doc][item] = (similarity, place, int(words[p]))


def _chunks(start: np.ndarray, span: int = 1 << 15):
    """Slices of sorted window starts that lie within ``span`` words."""
    at = 0
    while at < len(start):
        to = int(np.searchsorted(start, start[at] + span))
        yield slice(at, to)
        at = to


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, s: Settings):
    """Broadcast indexes of the benchmark, one block of bounded bytes after
    the other."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // s.block_bytes)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()
        if rows:
            yield spark.sparkContext.broadcast(Benchmark([r["id"] for r in rows], [r["text"].encode() for r in rows], s))


def _search(docs: DataFrame, index, text_col: str, carry: list[str]) -> DataFrame:
    """``doc`` (struct of the columns ``carry``) and ``hits`` of every row."""
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in carry]).alias("doc"))

    def run(batches):
        bench = index.value
        for b in text_slices(batches):
            hits = [[{"item_id": bench.ids[i], "similarity": x[0], "start_word": x[1], "n_words": x[2]}
                     for i, x in sorted(found.items())] for found in bench.leaks(utf8(b.column(0)))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(hits, _HIT_ARROW)], ["doc", "hits"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, hits {HIT}")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``(id_col, item_id, similarity, start_word, n_words)``: per row and item
    that it leaks, the best window."""
    out = docs.select(F.col(id_col)).where(F.lit(False)).select(
        id_col, *[F.lit(None).cast(t).alias(c) for c, t in
                  [("item_id", "long"), ("similarity", "double"), ("start_word", "int"), ("n_words", "int")]])
    for index in _blocks(benchmark, item_col, item_text, settings):
        found = _search(docs, index, text_col, [id_col])
        out = out.unionByName(found.select(F.col(f"doc.{id_col}").alias(id_col), F.explode("hits").alias("h"))
                              .select(id_col, "h.*"))
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    for nth, index in enumerate(_blocks(benchmark, item_col, item_text, settings)):
        if nth:  # one block in an executor's memory at a time
            path = scratch_path(docs.sparkSession, "decontam")
            docs.write.parquet(path)
            docs = docs.sparkSession.read.parquet(path)
        docs = _search(docs, index, text_col, docs.columns).where(F.size("hits") == 0).select("doc.*")
    return docs
