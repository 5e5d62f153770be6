import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    rows = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = defaultdict(Counter)
    for item, text in set(items):
        asked[item].update(terms(text))
    out = []
    for item, q in asked.items():
        scores = []
        for i, c in rows:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, n in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def made(seed, n, words, longest):
    rnd = random.Random(seed)
    vocab = [f"W{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return rnd, [(i, rnd.choice([" ", "-", "\n"]).join(rnd.choices(vocab, weights, k=rnd.randint(0, longest)))) for i in range(n)]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "7 as shard", "'x' as term", "1 as item")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark, docs_of, tmp_path):
    for seed, words, longest, shard in ((1, 40, 30, 400), (2, 400, 200, 5000), (3, 12, 6, 1 << 20)):
        rnd, docs = made(seed, 900, words, longest)
        docs += [(5, docs[7][1])] * 3 + [(None, docs[7][1]), (None, "w1 w2"), (1000, None), (1001, ""), (1002, "--- ...")]
        items = [(i, " ".join(rnd.choices([f"w{j}" for j in range(words + 5)], k=rnd.randint(0, 25)))) for i in range(30)]
        items += [(0, items[0][1]), (1, "w0 w0 w3"), (None, "W1 w2"), (77, None), (78, "unheard"), (79, "")]
        out = lexical.search(docs_of(docs, extra=["id", "terms", "m"]), items_of(spark, items), str(tmp_path / str(seed)), k=7, shard_bytes=shard,
                             query_bytes=300 if seed == 2 else 1 << 20)
        assert got(out) == brute(docs, items, 7)


def test_terms():
    text = "Ab-C1_d\x00É ÉÀé\x7fz  1,000 don't ΑΩ"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


def test_pack_and_unpack():
    rnd = np.random.default_rng(0)
    sizes = [1, 128, 3, 128, 70]
    block = np.repeat(np.arange(len(sizes)), sizes)
    gaps, counts = rnd.integers(1, [200, 60000, 90, 1 << 20, 300], (330, 5))[np.arange(330), block], rnd.integers(1, 70000, 330)
    counts[block == 1] = 1
    data, begin = lexical.pack(gaps, counts, block, len(sizes))
    for i in range(len(sizes)):
        places, tf = lexical.unpack(data[begin[i]:begin[i + 1]].tobytes(), 10)
        assert places.tolist() == (10 + np.cumsum(gaps[block == i])).tolist() and tf.tolist() == counts[block == i].tolist()


def test_block_maxima_reject_candidates():
    """A rare term and a common one whose good places lie in few blocks."""
    rnd = np.random.default_rng(4)
    n = 40 * lexical.BLOCK
    m = rnd.integers(50, 200, n)
    common, tf = np.arange(n), np.where(np.arange(n) // lexical.BLOCK == 3, 9, 1)
    rare = np.flatnonzero(rnd.random(n) < 0.3)

    def postings(place, tf):
        part = lexical.score_part(tf, m[place])
        starts = np.arange(0, len(place), lexical.BLOCK)
        gaps = np.diff(place, prepend=-1)
        data, begin = lexical.pack(gaps, tf, np.arange(len(place)) // lexical.BLOCK, len(starts))
        ends = np.append(starts[1:], len(place)) - 1
        return lexical.PostingList(int(part.max()), place[ends], np.maximum.reduceat(part, starts),
                                   [data[a:b].tobytes() for a, b in zip(begin, begin[1:])])

    a, b = postings(rare, np.ones(len(rare), dtype=np.int64)), postings(common, tf)
    seen = Counter()
    places, scores = lexical.search_shard([(2000, a), (700, b)], m, 10, seen=seen)
    full = 700 * lexical.score_part(tf, m)
    full[rare] += 2000 * lexical.score_part(np.ones(len(rare), dtype=np.int64), m[rare])
    top = np.lexsort((np.arange(n), -full))[:10]
    assert places.tolist() == top.tolist() and scores.tolist() == full[top].tolist()
    assert seen["rejected"] > seen["candidates"] / 4 and len(b.open) < len(b.data)
    floor = int(scores[-1])
    again = lexical.search_shard([(2000, a), (700, b)], m, 10, floor=floor)
    assert again[0].tolist() == places.tolist()
    assert not len(lexical.search_shard([(2000, a), (700, b)], m, 10, floor=int(scores[0]) + 1)[0])


def test_empty_tables(spark, docs_of, tmp_path):
    assert lexical.search(docs_of([]), items_of(spark, [(1, "a")]), str(tmp_path / "a")).count() == 0
    assert lexical.search(docs_of([(1, "a")]), items_of(spark, []), str(tmp_path / "b")).count() == 0


def test_long_text(spark, docs_of, tmp_path):
    docs = [(1, "a b " * 300000), (2, "a"), (3, "c" * 2000000), (4, "b d")]
    items = [(1, "a b"), (2, "c" * 2000000), (3, "d " * 100000)]
    assert got(lexical.search(docs_of(docs), items_of(spark, items), str(tmp_path / "x"))) == brute(docs, items, 10)
