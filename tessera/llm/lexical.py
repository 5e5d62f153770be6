"""Ranked lexical search with an inverted index in shards: Block-Max MaxScore.

Index.  A task cuts its documents into shards of about ``shard_bytes`` of text.
A shard has a row per term: the postings (place of the document in the shard,
times it occurs) in blocks of ``BLOCK``, every block packed by the width of its
largest gap and count, with its last place and the greatest score part of any
posting in it.  A further row holds the shard's documents.

Search.  A shard group reads only rows of query terms.  Per query the lists are
sorted by their global bound; as many of the smallest as cannot lift a document
over the threshold together are non-essential.  Documents of the essential
lists are candidates; the block maxima of the non-essential lists reject those
that cannot get over the threshold, and only blocks with candidates left are
unpacked.  The places of a shard are worked off in ranges, so that the
threshold grows.  Every shard gives its best ``k`` per query; those heaps are
merged by Spark.  A part of the shards is searched first; its k-th best scores
are true lower bounds and start the threshold of all others.

Queries are taken in blocks of about ``query_bytes``; a block is broadcast to
the shards, so nothing that is broadcast grows with their number.

Terms, weights and scores are integers as defined in ``weight`` and
``score_part``; a document's ``m`` needs the number of documents and of terms,
which are counted first.

Defined cases: a null text, and one without a term, is in no list; rows that
repeat an id are documents of their own, and rank by score and id (nulls
first); an item's repeated rows count once, different texts of one item id are
one item; an item without a known term has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import text_slices, utf8

BLOCK = 128
RANGE = 2048  # places of a shard that are worked off at a time
DOCS = b""  # the row of a shard that holds its documents; no term is empty
#: Terms are runs of ASCII letters, digits and all other characters that are not ASCII.
_TERM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()

POSTINGS = "shard long, term binary, df long, most long, blocks array<struct<last:int,most:long,data:binary>>, ids array<long>, m array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 25 + (75 * n * n_docs) // max(n_terms, 1)


def score_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# ---------------------------------------------------------------- index
def pack(gaps: np.ndarray, counts: np.ndarray, block: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all blocks and where each begins.  A block is its two widths
    (1, 2 or 4 bytes), then its gaps, then its counts."""
    size = np.bincount(block, minlength=n_blocks)
    first = np.cumsum(size) - size
    within = np.arange(len(block)) - first[block]
    widths = []
    for x in (gaps, counts):
        top = np.maximum.reduceat(x, first) if len(x) else np.zeros(0, dtype=np.int64)
        widths.append(np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4)))
    ends = np.cumsum(2 + size * (widths[0] + widths[1]))
    begin = np.concatenate([[0], ends]).astype(np.int64)
    out = np.zeros(begin[-1], dtype=np.uint8)
    out[begin[:-1]], out[begin[:-1] + 1] = widths[0], widths[1]
    at = begin[:-1] + 2
    for x, width in zip((gaps, counts), widths):
        place = at[block] + within * width[block]
        for j in range(4):
            wide = width[block] > j
            out[place[wide] + j] = (x[wide] >> (8 * j)) & 255
        at = at + size * width
    return out, begin


def unpack(data: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a block; ``base`` is the last place before it."""
    wide = {1: "<u1", 2: "<u2", 4: "<u4"}
    n = (len(data) - 2) // (data[0] + data[1])
    gaps = np.frombuffer(data, wide[data[0]], n, 2).astype(np.int64)
    return base + np.cumsum(gaps), np.frombuffer(data, wide[data[1]], n, 2 + n * data[0]).astype(np.int64)


def _shard(number: int, ids: list, words: list[np.ndarray], number_of: dict[bytes, int], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The rows of a shard; its documents are put in order of their ids.
    ``words`` has the terms' numbers, in the order of the texts."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    ids, words = [ids[i] for i in order], [words[i] for i in order]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    m = length_norm(n, n_docs, n_terms)
    key = np.concatenate(words).astype(np.int64) * len(words) + np.repeat(np.arange(len(words)), n)
    key, count = np.unique(key, return_counts=True)
    term, place = key // len(words), key % len(words)
    df = np.bincount(term, minlength=len(number_of))
    first = np.cumsum(df) - df
    rank = np.arange(len(term)) - first[term]
    n_blocks = -(-df // BLOCK)
    block_first = np.cumsum(n_blocks) - n_blocks
    block = block_first[term] + rank // BLOCK
    gaps = place.copy()
    gaps[1:] -= place[:-1]
    gaps[first] = place[first] + 1  # a list starts before place 0
    starts = np.flatnonzero(rank % BLOCK == 0)
    part = score_part(count, m[place])
    data, begin = pack(gaps, count, block, len(starts))
    last = np.append(starts[1:], len(place)) - 1
    blocks = pa.StructArray.from_arrays(
        [pa.array(place[last], pa.int32()), pa.array(np.maximum.reduceat(part, starts)),
         pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data)])],
        ["last", "most", "data"])
    offsets = np.concatenate([[0], np.cumsum(n_blocks), [len(starts)]]).astype(np.int32)
    most = np.maximum.reduceat(part, first)
    names = [*number_of, DOCS]  # no list for the documents' row
    none = [None] * len(number_of)
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * len(names), pa.int64()), pa.array(names, pa.binary()), pa.array([*df.tolist(), len(ids)], pa.int64()),
         pa.array([*most.tolist(), 0], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), blocks),
         pa.array([*none, ids], pa.list_(pa.int64())), pa.array([*none, m.tolist()], pa.list_(pa.int64()))],
        ["shard", "term", "df", "most", "blocks", "ids", "m"])


def _count(batches):
    docs = total = 0
    for b in text_slices(batches):
        n = [len(terms_of(t)) for t in utf8(b.column(1))]
        docs, total = docs + sum(x > 0 for x in n), total + sum(n)
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "terms"])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                shard_bytes: int = 16 << 20) -> tuple[int, int]:
    """Writes the index of all documents with a term to ``path``; returns the
    number of those documents and of all their terms."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.mapInArrow(_count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        ids, words, number_of, size = [], [], {}, 0
        for b in text_slices(batches):
            for i, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                found = terms_of(text)
                if found:
                    ids.append(i)
                    words.append(np.array([number_of.setdefault(w, len(number_of)) for w in found], dtype=np.int32))
                    size += len(text)
            if size >= shard_bytes:
                yield _shard(shard, ids, words, number_of, n_docs, n_terms)
                shard, ids, words, number_of, size = shard + 1, [], [], {}, 0
        if ids:
            yield _shard(shard, ids, words, number_of, n_docs, n_terms)

    rows.mapInArrow(run, POSTINGS).write.parquet(path)
    return n_docs, n_terms


# ---------------------------------------------------------------- search
@dataclass
class PostingList:
    """A term's postings in a shard; blocks are unpacked when asked for."""

    most: int
    last: np.ndarray
    block_most: np.ndarray
    data: list[bytes]

    def __post_init__(self):
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            self.open[i] = unpack(self.data[i], int(self.last[i - 1]) if i else -1)
        return self.open[i]

    def within(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings with places in [lo, hi)."""
        a, b = np.searchsorted(self.last, lo), np.searchsorted(self.last, hi)
        got = [self.block(i) for i in range(a, min(b + 1, len(self.data)))]
        if not got:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place, tf = (np.concatenate(x) for x in zip(*got))
        inside = slice(np.searchsorted(place, lo), np.searchsorted(place, hi))
        return place[inside], tf[inside]

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """The block maximum at each place (0 behind the list's end)."""
        i = np.searchsorted(self.last, places)
        return np.where(i < len(self.last), self.block_most[np.minimum(i, len(self.last) - 1)], 0)

    def counts(self, places: np.ndarray) -> np.ndarray:
        """How often the term occurs at each place; unpacks only the blocks
        that these places (ascending) lie in."""
        out = np.zeros(len(places), dtype=np.int64)
        block = np.searchsorted(self.last, places)
        for i in np.unique(block[block < len(self.data)]):
            mine = np.flatnonzero(block == i)
            at, tf = self.block(int(i))
            j = np.minimum(np.searchsorted(at, places[mine]), len(at) - 1)
            out[mine] = np.where(at[j] == places[mine], tf[j], 0)
        return out


def search_shard(lists: list[tuple[int, PostingList]], m: np.ndarray, k: int, floor: int = 0,
                 seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(places, scores)`` of the best ``k`` documents of a shard: highest
    score first, then lowest place.  ``lists`` has (weight times occurrences in
    the query, postings); documents below ``floor`` are not wanted.  ``seen``
    counts candidates, those that block maxima reject, and scored ones."""
    lists = sorted(((w, x) for w, x in lists if w > 0), key=lambda t: t[0] * t[1].most)
    bound = np.array([w * x.most for w, x in lists], dtype=np.int64)
    below = np.cumsum(bound)  # the most that a list and all smaller ones give
    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    least = max(floor, 1)  # scores below that cannot enter
    for lo in range(0, len(m), RANGE):
        hi = min(lo + RANGE, len(m))
        cut = int(np.searchsorted(below, least))  # lists[:cut] are non-essential
        if cut == len(lists):
            break
        partial = np.zeros(hi - lo, dtype=np.int64)
        for w, x in lists[cut:]:
            place, tf = x.within(lo, hi)
            partial[place - lo] += w * score_part(tf, m[place])
        found = np.flatnonzero(partial)
        places, score = found + lo, partial[found]
        if seen is not None:
            seen["candidates"] += len(places)
        if cut and len(places):
            rest = np.zeros(len(places), dtype=np.int64)
            for w, x in lists[:cut]:
                rest += w * x.bounds(places)
            alive = score + rest >= least
            if seen is not None:
                seen["rejected"] += int((~alive).sum())
            places, score, rest = places[alive], score[alive], rest[alive]
            for w, x in reversed(lists[:cut]):
                if not len(places):
                    break
                score += w * score_part(x.counts(places), m[places])
                rest -= w * x.bounds(places)
                alive = score + rest >= least
                places, score, rest = places[alive], score[alive], rest[alive]
        if seen is not None:
            seen["scored"] += len(places)
        good = score >= least
        places, score = np.concatenate([best[0], places[good]]), np.concatenate([best[1], score[good]])
        top = np.lexsort((places, -score))[:k]
        best = places[top], score[top]
        if len(top) == k:
            least = max(least, int(best[1][-1]) + 1)  # later places lose a tie
    return best


def _search(shared, k: int):
    """A shard's rows for the terms of the query block -> its best documents."""
    def run(index: pa.Table) -> pa.Table:
        lists, ids, m = {}, [], np.zeros(0, dtype=np.int64)
        blocks = index.column("blocks").combine_chunks()
        for i, term in enumerate(index.column("term").to_pylist()):
            if term == DOCS:
                ids, m = index.column("ids")[i].as_py(), index.column("m")[i].values.to_numpy()
                continue
            own = blocks[i].values
            last, most, data = (own.field(j) for j in range(3))
            lists[term] = PostingList(index.column("most")[i].as_py(), last.to_numpy().astype(np.int64), most.to_numpy(), data.to_pylist())
        out: list[tuple] = []
        for item, terms, weights, floor in shared.value:
            own = [(w, lists[t]) for t, w in zip(terms, weights) if t in lists]
            places, scores = search_shard(own, m, k, floor)
            out += [(item, ids[p], s) for p, s in zip(places.tolist(), scores.tolist())]
        item, doc, score = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, term, times)``."""
    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()

    def run(batches):
        for b in text_slices(batches):
            rows = [(i, t, n) for i, text in zip(b.column(0).to_pylist(), utf8(b.column(1))) for t, n in Counter(terms_of(text)).items()]
            if rows:
                i, t, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.binary()), pa.array(n, pa.int64())],
                                                 ["item_id", "term", "times"])

    return texts.mapInArrow(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def weighted_queries(index: DataFrame, terms: DataFrame, n_docs: int, path: str, query_bytes: int) -> tuple[DataFrame, int]:
    """``(item, item_id, block, terms, weights)``, a row per item with terms
    that the index knows, and the number of blocks; a block has about
    ``query_bytes``."""
    df = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weigh = F.udf(lambda n: weight(n_docs, n), "long")  # once per distinct query term
    one = F.struct("term", (F.col("w") * F.col("times")).alias("w"))
    rows = (terms.join(df.select("term", weigh("df").alias("w")), "term").groupBy("item_id")
            .agg(F.sort_array(F.collect_list(one)).alias("x"), F.sum(F.octet_length("term") + 8).alias("size")))
    (rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "size", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))
     .write.parquet(path))
    rows = index.sparkSession.read.parquet(path)
    n_blocks = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / query_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks))), n_blocks


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every item, ranked; Spark keeps ``k`` per task before
    it shuffles."""
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _search_block(index: DataFrame, queries: DataFrame, k: int, first_part: int, path: str) -> DataFrame:
    """``(item, doc_id, score)``: candidates of one block of queries, the best
    ``k`` of every item among them."""
    spark = index.sparkSession
    rows = [(r["item"], [bytes(t) for t in r["terms"]], r["weights"]) for r in queries.collect()]  # about query_bytes

    wanted = queries.select(F.explode("terms").alias("term")).unionByName(spark.range(1).select(F.lit(DOCS).alias("term"))).distinct()
    needed = index.join(wanted, "term", "left_semi").select("shard", "term", "most", "blocks", "ids", "m")

    def found(part, floor: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast([(*r, floor.get(r[0], 0)) for r in rows])
        return needed.where(part).groupBy("shard").applyInArrow(_search(shared, k), "item long, doc_id long, score long")

    early = F.pmod(F.xxhash64("shard"), F.lit(first_part)) == 0
    _best(found(early, {}), k).drop("rank").write.parquet(path)
    head = spark.read.parquet(path)
    floors = head.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    return head.unionByName(found(~early, {r["item"]: r["floor"] for r in floors.collect()}))  # a number per item of the block


def search(docs: DataFrame, items: DataFrame, store: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", shard_bytes: int = 16 << 20, query_bytes: int = 16 << 20,
           first_part: int = 8) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every
    item.  The index and the queries are written below ``store``; one of
    ``first_part`` shards is searched first."""
    spark, store = docs.sparkSession, store.rstrip("/")
    n_docs, _ = build_index(docs, f"{store}/index", id_col, text_col, shard_bytes)
    index = spark.read.schema(POSTINGS).parquet(f"{store}/index")
    query_terms(items, item_id, item_text).write.parquet(f"{store}/terms")
    queries, n_blocks = weighted_queries(index, spark.read.parquet(f"{store}/terms"), n_docs, f"{store}/queries", query_bytes)
    found = None
    for b in range(n_blocks):
        part = _search_block(index, queries.where(F.col("block") == b), k, first_part, f"{store}/first-{b}")
        found = part if found is None else found.unionByName(part)
    return _best(found, k).join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
