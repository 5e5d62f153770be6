import random
import re

from tessera.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        if i is None:
            continue
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a:a + window])] < i:
                gone.update(range(a, a + window))
        out.append((i, len(w), " ".join(x for k, x in enumerate(w) if k not in gone), len(gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc.doc_id, r.n_words, r.kept, sum(s.end - s.start for s in r.spans)) for r in df.collect()), key=str)


def test_random_texts(docs_of):
    """Few distinct words, so windows repeat inside and across texts in every way."""
    rnd = random.Random(5)
    for vocab, window in ((2, 13), (3, 7), (40, 5)):
        pool = [[f"w{rnd.randrange(vocab)}" for _ in range(30)] for _ in range(4)]
        rows = []
        for i in range(60):
            w = []
            for _ in range(rnd.randint(0, 4)):
                p, a = rnd.choice(pool), rnd.randrange(20)
                w += p[a:a + rnd.randint(1, 25)]
                w += [f"w{rnd.randrange(vocab)}" for _ in range(rnd.randint(0, 6))]
            rows.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice([" ", "\n", "  \t"]).join(w)))
        df = substring.remove_repeats(docs_of(rows, extra=["id", "marks", "a", "place"]), window=window)
        assert got(df) == brute(rows, window)


def test_cases(docs_of):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (2, passage), (2, passage), (3, "x " + passage + " y"), (4, None), (5, ""), (6, "few words"),
            (None, passage), (7, " ".join(passage.split()[:12])), (8, passage.upper()), (9, "long " * 50000 + passage),
            (10, "long " * 60000)]
    assert got(substring.remove_repeats(docs_of(rows))) == brute(rows, 13)


def test_empty_table(docs_of):
    assert substring.remove_repeats(docs_of([])).count() == 0
