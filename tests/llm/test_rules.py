import random
import re

from tessera.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    cover = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
            len(lines), len(re.findall("[A-Z]", t))]


def test_measures(docs_of):
    rnd = random.Random(2)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a " * 400), (3, "a " * 400), (None, "b\nb\nb"), (4, "é" * 9 + "\u00a0x\x1cy")]
    for i in range(60):
        rows.append((10 + i, "".join(rnd.choice(["a ", "b ", "c\n", "D# ", "ee\t", "|\n", "ß ", "\n", "a b c d e f g h "]) for _ in range(rnd.randint(0, 60)))))
    book = rules.ledger(docs_of(rows, extra=["n_words", "t", "words", "wins"]), keep=["doc_id"]).collect()
    assert sorted(([r.doc_id, *[r[m] for m in rules.MEASURES]] for r in book), key=str) == sorted(([i, *brute(t)] for i, t in rows), key=str)


def test_bits_and_policies(docs_of):
    rows = [(1, "word " * 30), (2, " ".join(f"w{i}" for i in range(30))), (3, "few"), (4, " ".join(f"a{i}##" for i in range(30))),
            (5, " ".join(f"LOUD{i}" for i in range(30)))]
    book = rules.apply_policies(rules.ledger(docs_of(rows), keep=["doc_id"]))
    x = {r.doc_id: r for r in book.collect()}
    failed = {i: {n for n, b in rules.BIT.items() if x[i].fail_bits >> b & 1} for i in x}
    assert failed == {1: {"repeated_windows"}, 2: set(), 3: {"few_words"}, 4: {"symbols"}, 5: {"capitals"}}
    assert x[4].kept_base_v1 and not x[4].kept_web_v1 and x[5].kept_web_v1 and not x[5].kept_web_v2
    report = {r.rule: (r.n_failed, r.n_only) for r in rules.ablation(book, rules.POLICIES[-1]).collect()}
    assert report["symbols"] == (1, 1) and report["repeated_lines"] == (0, 0) and set(report) == set(rules.RULES)


def test_no_python_and_empty(docs_of):
    df = rules.ledger(docs_of([]), keep=["doc_id"])
    assert df.count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
