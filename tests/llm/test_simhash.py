import random

import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def brute_fp(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits):
    """ids -> smallest id reachable; fps: list of (id, fp)."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    keys = sorted({f for _, f in fps})
    for i, a in enumerate(keys):
        for b in keys[i:]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    best = {}
    for i, f in fps:
        if i is not None:
            best[find(f)] = min(best.get(find(f), i), i)
    return [(i, best.get(find(f))) for i, f in fps]


def test_fingerprint_equals_definition():
    rnd = random.Random(3)
    for _ in range(200):
        t = "".join(rnd.choice(["Ab", "é", " ", "\n", "\x1c", "\u00a0", "x", "  ", "\t", "Zz."]) for _ in range(rnd.randint(0, 40)))
        assert simhash.fingerprint(t.encode()) == brute_fp(t), t


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64("a b é".encode(), seed=42).intdigest()


def test_cases(spark, docs_of):
    rows = [(5, "one two three four"), (3, "ONE two\nthree four"), (9, None), (8, ""), (7, " \t"), (None, "one two three four"),
            (1, "alone"), (2, "Alone"), (4, "lone wolf"), (4, "lone wolf"), (6, "x " * 30000 + "end")]
    got = simhash.near_duplicates(docs_of(rows, extra=["fp", "id", "component_id", "root"])).collect()
    fps = [(i, brute_fp(t)) for i, t in rows]
    want = sorted(((i, format(f, "016x"), c) for (i, f), (_, c) in zip(fps, brute_components(fps, 2))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


def _linked(spark, fps, bits, crowd):
    signed = [((f ^ (1 << 63)) - (1 << 63),) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bits, crowd).collect()
    return [(e.src % (1 << 64), e.dst % (1 << 64)) for e in edges]


def test_links_keep_every_component(spark):
    """Random chains and balls of fingerprints, with crowded variants or not."""
    rnd = random.Random(11)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(rnd.randint(0, 3)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
            if rnd.random() < 0.2:
                x = y
    fps = sorted(fps)
    for bits in (1, 2):
        want = dict(brute_components([(f, f) for f in fps], bits))
        for crowd in (64, 3):
            edges = _linked(spark, fps, bits, crowd)
            assert all((a ^ b).bit_count() <= bits for a, b in edges)
            parent = {f: f for f in fps}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in edges:
                parent[max(find(a), find(b))] = min(find(a), find(b))
            assert {f: find(f) for f in fps} == want


def test_exploded_variants_are_not_broadcast(spark, monkeypatch):
    """64 variants of each fingerprint are sized as one row by Spark: under the
    threshold as it sees them, far above it in fact."""
    rnd = random.Random(5)
    fps = spark.createDataFrame([(rnd.getrandbits(63),) for _ in range(2000)], "fp long")
    plans, kind = [], type(fps)
    checkpoint = kind.checkpoint

    def noted(self, *a, **b):
        out = checkpoint(self, *a, **b)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(kind, "checkpoint", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 18))
    try:
        simhash.links(fps).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
