import random
from collections import Counter

from tessera.llm import decontam


def low(t):
    return (t or "").encode().lower().split()


def brute(docs, items):
    out = []
    for d, t in docs:
        w = low(t)
        for i, x in items:
            iw = low(x)
            if not iw or not w:
                continue
            k = min(5, len(iw))
            grams = lambda v: Counter(tuple(v[j:j + k]) for j in range(len(v) - k + 1))
            ig, m, best = grams(iw), min(len(iw), len(w)), None
            if not ig.keys() & grams(w).keys():
                continue  # no window can be similar
            for a in range(len(w) - m + 1):
                c = grams(w[a:a + m])
                s = sum((c & ig).values()) / max(1, sum((c | ig).values()))
                if s >= 0.8 and (best is None or s > best[0]):
                    best = (s, a, m)
            if best:
                out.append((d, i, *best))
    return sorted(out, key=str)


def check(spark, docs_of, docs, items, settings=decontam.Settings()):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(docs_of(docs, extra=["item_id", "hits", "doc", "id"]), bench, settings=settings).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    kept = decontam.drop_leaking(docs_of(docs), bench, settings=settings).collect()
    bad = Counter(d for d, t in docs if any(r[0] == 0 for r in brute([(0, t)], items)))
    assert Counter(r.doc_id for r in kept) == Counter(d for d, _ in docs) - bad


def test_planted(spark, docs_of):
    rnd = random.Random(8)
    word = lambda: f"v{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rnd.randint(14, 60)))) for i in range(60)]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rnd.randint(0, 200))]
        if d % 2:
            x = low(items[rnd.randrange(60)][1])
            x = [y.decode() for y in x]
            if d % 4 == 1:
                x = x[rnd.randint(0, 2):]  # shorter than the item
            if d % 6 == 3:
                x[0] = "Changed"
            at = rnd.randint(0, len(w))
            w = w[:at] + [y.upper() for y in x] + w[at:]
        docs.append((d, " ".join(w)))
    check(spark, docs_of, docs, items)
    check(spark, docs_of, docs, items, decontam.Settings(block_bytes=3000))  # several blocks


def test_cases(spark, docs_of):
    items = [(1, None), (2, ""), (3, "two words"), (4, "a b c d e f g h i j k l m n"), (4, "a b c d e f g h i j k l m n"), (None, "lone item of six words here")]
    docs = [(1, None), (2, ""), (3, "has TWO words inside"), (4, "x a b c d e f g h i j k l m n y"), (4, "x a b c d e f g h i j k l m n y"),
            (None, "lone item of six words here"), (5, "a b c d e f g h i j k l m"), (6, "a b c d e " * 20000), (7, "two")]
    items = [items[0], items[1], items[2], items[3], items[5]]
    check(spark, docs_of, docs, items)
    check(spark, docs_of, docs, [])
    check(spark, docs_of, [], items)
