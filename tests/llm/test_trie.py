import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, place long, tid string, level int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 1) for r in rows], SCHEMA)


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(rows):
    convs, out = ordered(rows), {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[:len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p]
        ends = sorted(c for c in cs if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids(path)),
                    sum(not kids(p) for p in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n, texts, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        start = rnd.choice([0, 0, 1])
        for t in range(rnd.randint(1, longest)):
            rows.append((c, t if rnd.random() < 0.9 else rnd.choice([None, start]), rnd.choice(["user", "assistant", None]) if rnd.random() < 0.1
                         else ("user", "assistant")[t % 2], rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("width", [8, 3])
def test_rebuilt_conversations(spark, width):
    rows = made(width, 40, ["é", "ok", "", None, "a longer text"], 14)
    rows += rows[:30]  # repeated rows are turns of their own
    rows += [(None, 1, "user", "nobody"), (7777, 0, "user", "ok"), (-3, 0, "user", "ok"), (-5, 0, "user", "é")]
    rnd = random.Random(1)
    rnd.shuffle(rows)
    turns, sizes = trie.shared_heads(trie.placed_turns(conversations(spark, rows)))
    # % keeps the sign, as in SQL
    convs = ordered(rows)
    want = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        want[c] = convs.get(base, [])[:h] + own[h:]
    assert got(trie.prefix_trie(turns, sizes, width)) == plain_trie(want)


def test_long_conversations_share_a_long_beginning(spark, monkeypatch):
    """More blocks than a span of keys holds."""
    monkeypatch.setattr(trie, "SPAN", 4)
    base = [("user", f"t{i % 7}") for i in range(150)]
    convs = {1: base, 2: base[:140], 3: base[:70] + [("user", "x")] * 60, 4: base, 5: [], 6: base[:64], 7: [("user", "other")]}
    turns = spark.createDataFrame([(c, i + 1, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)],
                                  "conv_id long, place long, role string, text string").select("conv_id", "place", trie.turn_id("role", "text").alias("tid"))
    sizes = spark.createDataFrame([(c, len(ts)) for c, ts in convs.items()], "conv_id long, n_turns long")
    assert got(trie.prefix_trie(turns, sizes)) == plain_trie(convs)


def test_a_third_of_the_rows_in_one_conversation(spark):
    """No task of the range sort takes the hot conversation whole, and places are gapless."""
    rows = [(10, i, "user", f"m{i % 3}") for i in range(6000)] + [(c, t, "user", "m0") for c in range(3000) for t in range(4) if c != 10]
    placed = trie.placed_turns(conversations(spark, rows))
    hot = sorted(r.place for r in placed.where("conv_id = 10").collect())
    assert hot == list(range(1, 6001))


def test_many_conversations_end_at_one_node(spark):
    ids = list(range(0, 5000))
    random.Random(2).shuffle(ids)
    rows = [(c, 0, "user", "hi") for c in ids]
    turns = trie.placed_turns(conversations(spark, rows))
    sizes = turns.groupBy("conv_id").agg({"place": "max"}).toDF("conv_id", "n_turns")
    assert got(trie.prefix_trie(turns, sizes)) == plain_trie({c: [("user", "hi")] for c in ids})


def test_empty_and_long(spark):
    assert trie.prefix_trie(*trie.shared_heads(trie.placed_turns(conversations(spark, [])))).count() == 0
    rows = [(5, 0, "user", "x" * 3000000), (10, 0, "user", "x" * 3000000), (15, 0, "", ""), (15, 1, "a:b", "c"), (20, 0, "a", "b:c")]
    out = trie.prefix_trie(*trie.shared_heads(trie.placed_turns(conversations(spark, rows))))
    assert got(out) == plain_trie(rebuilt(rows))
