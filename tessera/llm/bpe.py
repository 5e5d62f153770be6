"""Byte-level BPE through a minimal acyclic transducer lexicon.

Frequent words of the corpus are compiled with their ids into a minimal
automaton: equal suffixes share states, and the numbers on its transitions add
up to the word's number, which finds its ids.  The automaton is one file in
the shared folder; Spark hands it to every executor, which maps it into
memory.  Tasks split whole slices of text into words and walk all words
through the automaton at once (numpy); words that it does not have are merged
pair by pair in order of rank, which gives the same ids, so the choice of
words decides speed only.

The tokenizer file (its path is a parameter) gives vocabulary, merges and
added special tokens.

Defined cases: a null text counts as empty and has no ids; special tokens
standing in a text become their ids, as in the library's default; ids decode
to bytes, and invalid UTF-8 (never the case after encoding) to U+FFFD; rows
are encoded one by one, repeated or not; an empty table gives an empty lexicon.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import unicodedata
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.rows import text_slices, utf8
from tessera.session import scratch_path

LEXICON_WORDS = 1 << 17
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Words as the engine's own regular expressions find them; only for counting.
COUNT_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"


@cache
def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others count up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.single = [0] * 256
        for t, i in vocab.items():
            if len(t) == 1:
                self.single[chars[t]] = i

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged first, of equal
        ranks the leftmost."""
        ids = [self.single[b] for b in word]
        return self._merge_few(ids) if len(ids) <= 48 else self._merge_many(ids)

    def _merge_few(self, ids: list[int]) -> list[int]:
        ranks, none = self.ranks, (1 << 60, -1)
        while len(ids) > 1:
            found = [ranks.get(p, none) for p in zip(ids, ids[1:])]
            best = min(found)
            if best is none or best[1] < 0:
                break
            i = found.index(best)
            ids[i: i + 2] = [best[1]]
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked places, for long words."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heap = [(r, i, new, p) for r, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (p := (ids[left], ids[right])) in ranks:
                    r, made = ranks[p]
                    heapq.heappush(heap, (r, left, made, p))
        return [x for x in ids if x is not None]


def char_classes(path: str) -> np.ndarray:
    """Class of every code point.  Where this Python's Unicode tables have no
    entry but newer ones do, the file's own pre-tokenizer is asked."""
    import regex
    from tokenizers import Tokenizer

    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    fresh = regex.compile(r"[\p{L}\p{N}]")
    asked = []
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in kinds:
            out[c] = kinds[kind[0]]
        elif kind == "Cn" and fresh.match(chr(c)):
            asked.append(c)
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for c in asked:
        if len(split(f"a{chr(c)}")) == 1:
            out[c] = LETTER
        elif len(split(f"1{chr(c)}")) == 1:
            out[c] = NUMBER
    return out


def word_starts(codes: np.ndarray, classes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where words start, by the public splitting pattern ``'s|'t|'re|'ve|'m|
    'll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, for the code
    points of several texts at once; ``opens`` marks the first of each."""
    n = len(codes)
    kind = classes[codes]
    start = opens.copy()
    start[1:] |= kind[1:] != kind[:-1]  # runs of one class
    shut = np.append(opens[1:], True)  # last code point of a text
    # white space before a word: its last character is a word of its own, or,
    # if a blank, the head of the word
    white = kind == SPACE
    before_word = np.zeros(n, dtype=bool)
    before_word[:-1] = white[:-1] & ~white[1:]
    before_word &= ~shut
    start |= before_word
    head = before_word & (codes == 0x20)
    start[1:] &= ~head[:-1]
    # contractions: an apostrophe that is a whole run and starts a word, before
    # letters that begin with one of the endings
    single = start & (codes == 0x27)
    single[:-1] &= kind[1:] == LETTER
    at = np.flatnonzero(single & ~shut)
    if len(at):
        one = codes[at + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = np.full(len(at), -1, dtype=np.int64)
        long_ = ~shut[at + 1]
        two[long_] = codes[at[long_] + 2]
        pair = np.zeros(len(at), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        for hit, size in ((at[short], 2), (at[pair], 3)):
            start[hit + 1] = False
            rest = hit + size
            start[rest[rest < n]] = True  # what follows, be it the rest of the letters
    return start


class Automaton:
    """Arrays of the minimal automaton, kept in one file."""

    FIELDS = ("classes", "key", "target", "add", "final", "first", "ids")

    @staticmethod
    def compile(entries: list[tuple[bytes, list[int]]], classes: np.ndarray) -> dict[str, np.ndarray]:
        """``entries``: (word, ids) sorted by word, without repeats.  Words
        enter in order; the branch left behind is folded into equal states."""
        register: dict[tuple, int] = {}
        states: list[tuple[tuple[tuple[int, int], ...], bool]] = []

        def fold(node) -> int:
            key = (tuple(node[0]), node[1])
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path = [[[], False]]  # open branch: [transitions, final]
        last = b""
        for word, _ in [*entries, (None, None)]:
            common = 0 if word is None else len(os.path.commonprefix([last, word]))
            while len(path) > common + 1:
                node = path.pop()
                path[-1][0].append((last[len(path) - 1], fold(node)))
            if word is not None:
                path.extend([[], False] for _ in word[common:])
                path[-1][1] = True
                last = word
        root = fold(path[0])
        size = np.zeros(len(states), dtype=np.int64)  # words below a state
        for s, (steps, final) in enumerate(states):  # targets come first
            size[s] = final + sum(size[t] for _, t in steps)
        key, target, add = [], [], []
        for s, (steps, is_final) in enumerate(states):
            before = int(is_final)
            for b, t in steps:
                key.append(s << 8 | b)
                target.append(t)
                add.append(before)
                before += int(size[t])
        key, place = Automaton._scatter(np.array(key, dtype=np.int64))
        spread = {}
        for k, x in (("target", target), ("add", add)):
            spread[k] = np.zeros(len(key), dtype=np.int32)
            spread[k][place] = x
        first = np.zeros(len(entries) + 1, dtype=np.int64)
        first[1:] = np.cumsum([len(ids) for _, ids in entries])
        ids = np.array([i for _, x in entries for i in x], dtype=np.int32)
        final = np.array([f for _, f in states] + [root], dtype=np.int32)  # the root's number stands last
        return {"classes": classes, "key": key, **spread, "final": final, "first": first, "ids": ids}

    @staticmethod
    def _slot(key: np.ndarray, slots: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)

    @staticmethod
    def _scatter(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open hash table of the keys (-1: free) and the place of each."""
        slots = 1 << max(8, (3 * len(key)).bit_length())
        table, place = np.full(slots, -1, dtype=np.int64), np.zeros(len(key), dtype=np.int64)
        todo, at = np.arange(len(key)), Automaton._slot(key, slots)
        while len(todo):
            at[table[at] >= 0] += 1
            at &= slots - 1
            free = np.flatnonzero(table[at] < 0)
            got, who = np.unique(at[free], return_index=True)
            who = free[who]
            table[got], place[todo[who]] = key[todo[who]], got
            stay = np.ones(len(todo), dtype=bool)
            stay[who] = False
            todo, at = todo[stay], at[stay]
        return table, place

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Place of every key, -1 if it has none."""
        at = self._slot(key, len(self.key))
        have = self.key[at]
        while True:
            on = np.flatnonzero((have != key) & (have >= 0))
            if not len(on):
                return np.where(have == key, at, -1)
            at[on] = (at[on] + 1) & (len(self.key) - 1)
            have[on] = self.key[at[on]]

    @staticmethod
    def pack(arrays: dict[str, np.ndarray]) -> bytes:
        head, body, at = {}, [], 0
        for k in Automaton.FIELDS:
            x = np.ascontiguousarray(arrays[k])
            head[k] = (x.dtype.str, x.shape, at)
            pad = -x.nbytes % 64
            body += [x.tobytes(), bytes(pad)]
            at += x.nbytes + pad
        h = json.dumps(head).encode()
        return len(h).to_bytes(8, "little") + h + bytes(-(len(h) + 8) % 64) + b"".join(body)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        base = n + 8 + -(n + 8) % 64
        for k, (kind, shape, at) in json.loads(self.map[8: 8 + n]).items():
            count = int(np.prod(shape))
            setattr(self, k, np.frombuffer(self.map, dtype=kind, count=count, offset=base + at).reshape(shape)
                    if count else np.empty(shape, dtype=kind))

    def numbers(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of every word ``buf[start:start + size]``, -1 if unknown."""
        out = np.full(len(start), -1, dtype=np.int64)
        live, at, left = np.arange(len(start)), start.copy(), size.copy()
        state = np.full(len(start), self.final[-1], dtype=np.int64)
        total = np.zeros(len(start), dtype=np.int64)
        while len(live):
            ended = np.flatnonzero(left == 0)
            if len(ended):
                known = ended[self.final[state[ended]] > 0]
                out[live[known]] = total[known]
            place = np.full(len(live), -1, dtype=np.int64)
            on = np.flatnonzero(left > 0)
            place[on] = self._find(state[on] << 8 | buf[at[on]])
            go = np.flatnonzero(place >= 0)
            place, live, total, at, left = place[go], live[go], total[go], at[go] + 1, left[go] - 1
            state = self.target[place].astype(np.int64)
            total += self.add[place]
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes slices of texts in a task."""

    CACHE = 100_000  # words merged lately, so that a frequent stranger is merged once

    def __init__(self, automaton: str, tokenizer: str):
        self.auto = Automaton(automaton)
        self.vocab = Vocabulary(tokenizer)
        self.cache: dict[bytes, list[int]] = {}
        n = max(self.vocab.tokens) + 1
        words = [self.vocab.tokens.get(i, b"") for i in range(n)]
        self.token_size = np.array([len(w) for w in words], dtype=np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocab.special, key=len, reverse=True)))) if self.vocab.special else None

    def _strange(self, word: bytes) -> list[int]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            got = self.vocab.merge(word)
            if len(word) < 64:
                self.cache[word] = got
        return got

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        pieces, owner, marks = [], [], []  # marks: (index of the piece it precedes, id)
        for d, t in enumerate(texts):
            s = t.decode("utf-8")
            at = 0
            for m in self.special.finditer(s) if self.special else ():
                pieces.append(s[at: m.start()])
                owner.append(d)
                marks.append((len(pieces) - 1, self.vocab.special[m[0]]))
                at = m.end()
            pieces.append(s[at:])
            owner.append(d)
        chars = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
        buf = np.frombuffer("".join(pieces).encode("utf-8"), dtype=np.uint8)
        piece_at = np.cumsum(chars) - chars
        ids, of_piece = np.empty(0, dtype=np.int32), np.zeros(len(pieces), dtype=np.int64)
        if len(codes):
            opens = np.zeros(len(codes) + 1, dtype=bool)
            opens[piece_at] = True
            place = np.flatnonzero(word_starts(codes, self.auto.classes, opens[:-1]))
            byte_at = np.flatnonzero((buf & 0xC0) != 0x80)[place]
            size = np.diff(np.append(byte_at, len(buf)))
            number = self.auto.numbers(buf, byte_at, size)
            known = number >= 0
            count = np.zeros(len(place), dtype=np.int64)
            first = self.auto.first
            count[known] = first[number[known] + 1] - first[number[known]]
            strange = np.flatnonzero(~known)
            raw = buf.tobytes()
            made = [self._strange(raw[a: a + n]) for a, n in zip(byte_at[strange].tolist(), size[strange].tolist())]
            count[strange] = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            out_at = np.cumsum(count) - count
            ids = np.empty(int(count.sum()), dtype=np.int32)
            k = number[known]
            ids[_ranges(out_at[known], count[known])] = self.auto.ids[_ranges(first[k], count[known])]
            ids[_ranges(out_at[strange], count[strange])] = np.fromiter(
                (i for x in made for i in x), dtype=np.int32, count=int(count[strange].sum()))
            piece = np.searchsorted(piece_at + chars, place, side="right")
            of_piece = np.bincount(piece, weights=count, minlength=len(pieces)).astype(np.int64)
        if marks:
            ends = np.cumsum(of_piece)
            ids = np.insert(ids, [ends[p] for p, _ in marks], [i for _, i in marks])
            np.add.at(of_piece, [p for p, _ in marks], 1)
        return ids, np.bincount(np.array(owner, dtype=np.int64), weights=of_piece, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of every run of ids."""
        size = self.token_size[ids]
        raw = self.token_bytes[_ranges(self.token_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:])]


def frequent_words(docs: DataFrame, text_col: str, limit: int) -> DataFrame:
    """Words that occur more often than the ``limit``-th most frequent one
    (at most ``limit`` rows); counts cover the whole table."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(COUNT_PATTERN), F.lit(0))).alias("word"))
    path = scratch_path(docs.sparkSession, "words")
    (words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and octet_length(word) <= 64")
     .write.parquet(path))
    counts = docs.sparkSession.read.parquet(path)
    # numbers of words by count; rare counts come first, so the table is short
    by_count = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count(F.lit(1)).alias("words"))
    total, least_n = 0, 1 << 62
    for r in by_count.orderBy(F.desc("n")).collect():
        total += r["words"]
        if total > limit:
            break
        least_n = r["n"]
    return counts.where(F.col("n") >= least_n).select("word")


def _publish(spark: SparkSession, data: bytes) -> str:
    """Writes a file into the shared folder and has Spark hand it to every
    executor, later ones included; its name there."""
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = scratch_path(spark, "lexicon") + "/" + name
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        for at in range(0, len(data), 1 << 22):
            out.write(data[at: at + (1 << 22)])
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon of ``docs``; the name under which executors find it."""
    vocab = Vocabulary(tokenizer)
    words = sorted(r["word"].encode() for r in frequent_words(docs, text_col, limit).collect())
    entries = [(w, vocab.merge(w)) for w in words]
    return _publish(docs.sparkSession, Automaton.pack(Automaton.compile(entries, char_classes(tokenizer))))


@cache
def _encoder(lexicon: str, tokenizer: str) -> Encoder:
    return Encoder(SparkFiles.get(lexicon), tokenizer)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           limit: int = LEXICON_WORDS, decode: bool = True) -> DataFrame:
    """``(id_col, ids, decoded)`` of every row: the ids as little-endian
    unsigned 32-bit integers, and (with ``decode``) the text that they decode to."""
    lexicon = build_lexicon(docs, tokenizer, text_col, limit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = _encoder(lexicon, tokenizer)
        for b in text_slices(batches, 1 << 21):
            ids, counts = encoder.encode(utf8(b.column(1)))
            ends = np.cumsum(counts)
            raw = [ids[a:z].astype("<u4").tobytes() for a, z in zip(ends - counts, ends)]
            made = {"id": b.column(0), "ids": pa.array(raw, pa.binary())}
            if decode:
                made["decoded"] = pa.array(encoder.decode(ids, counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(made)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary" + ", decoded string" * decode).withColumnRenamed("id", id_col)

