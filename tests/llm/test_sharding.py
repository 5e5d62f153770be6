import zlib
from collections import Counter, defaultdict

from tessera.llm import sharding


def test_cases(docs_of):
    rows = [(i, "t" * (i % 50)) for i in range(300)] + [(1, None), (1, None), (None, "x"), (None, "y"), (2, "é" * 100000), (3, "")]
    df = sharding.shard(docs_of(rows, extra=["size", "shard", "slot", "n", "place", "ahead"]), 8, n_slots=64)
    got = df.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(8))
    assert {r.law for r in got} == {"bytes"}


def test_empty_table(docs_of):
    assert sharding.shard(docs_of([]), 4).count() == 0


def test_first_map_is_even():
    sizes = [(i * 7919) % 1000 + 1 for i in range(4096)]
    m = sharding.first_map(sizes, 40)
    load = Counter()
    for slot, s in enumerate(m.shard_of):
        load[s] += sizes[slot]
    assert max(load.values()) - min(load.values()) <= max(sizes)


def test_grow_moves_into_the_new_shard_only():
    sizes = [(i * 7919) % 1000 for i in range(4096)]
    old = sharding.first_map(sizes, 40)
    new = sharding.grow(old, sizes)
    assert new.version == 2 and new.n_shards == 41
    assert all(b == a or b == 40 for a, b in zip(old.shard_of, new.shard_of))
    load = Counter()
    for slot, s in enumerate(new.shard_of):
        load[s] += sizes[slot]
    assert abs(load[40] - sum(sizes) / 41) < 2000 and max(load.values()) < 1.05 * sum(sizes) / 41


def test_rebalance_after_drift(spark, tmp_path):
    sizes = [100] * 1024
    old = sharding.first_map(sizes, 8)
    drifted = [300 if s == 3 else 100 for s in old.shard_of]
    new = sharding.rebalance(old, drifted)
    load = Counter()
    for slot, s in enumerate(new.shard_of):
        load[s] += drifted[slot]
    assert max(load.values()) <= 1.05 * min(load.values())
    assert sum(a != b for a, b in zip(old.shard_of, new.shard_of)) < 128
    for m in (old, new):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == new
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == old


def test_written_shards(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text {i}") for i in range(200)])
    m = sharding.first_map(sharding.slot_bytes(sharding.records(docs)), 5)
    sharding.write_shards(docs, m, str(tmp_path / "out"))
    got = {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.doc_id: m.shard_of[r.virtual_slot] for r in sharding.records(docs).collect()}
    assert got == want


def plain_slots(rows, n_slots):
    """Slots of a table by its rule, with Spark's hash as the only given."""
    from pyspark.sql import SparkSession, functions as F
    spark = SparkSession.getActiveSession()

    def hashed(values, *cols):
        df = spark.createDataFrame(list(values), cols[0])
        return {tuple(r)[:-1]: r["h"] for r in df.select("*", F.xxhash64(*df.columns).alias("h")).collect()}
    ids = hashed({(str(i),) for i, _ in rows if i is not None} | {("0",)}, "v string")
    texts = hashed({(t,) for i, t in rows if i is None} | {("",)}, "v string")
    groups = defaultdict(list)
    for i, t in rows:
        raw = (t or "").encode()
        groups[texts[(t,)] if i is None else ids[(str(i),)]].append((len(raw) + 16, zlib.crc32(raw), i))
    ranks = hashed({(k, n + 1) for k, g in groups.items() for n in range(1, len(g))} | {(0, 0)}, "k long, n long")
    return Counter((i, size, crc, (k if n == 0 else ranks[(k, n + 1)]) % n_slots)
                   for k, g in groups.items() for n, (size, crc, i) in enumerate(sorted(g, key=lambda r: r[:2])))


def test_slots_and_shards_equal_plain_ones(docs_of):
    rows = [(i, "t" * (i % 9)) for i in range(150)] + [(3, "x" * i) for i in range(40)] + [(None, None)] * 30 + [(None, "z")] * 3
    recs = sharding.records(docs_of(rows), n_slots=32).collect()
    want = plain_slots(rows, 32)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.virtual_slot) for r in recs) == want
    got = sharding.shard(docs_of(rows), 5, n_slots=32).collect()
    sizes = [0] * 32
    for (_, size, _, slot), n in want.items():
        sizes[slot] += size * n
    load, shard_of = [0] * 5, {}  # the largest slot first into the lightest shard
    for slot in sorted(range(32), key=lambda s: (-sizes[s], s)):
        to = min(range(5), key=lambda x: (load[x], sum(v == x for v in shard_of.values()), x))
        shard_of[slot] = to
        load[to] += sizes[slot]
    assert all(r.shard == shard_of[r.virtual_slot] for r in got)
    for s in range(5):  # places follow the slots, then id, size and CRC
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        key = [(r.virtual_slot, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in mine]
        assert [r.slot for r in mine] == list(range(len(mine))) and key == sorted(key)


def test_law_holds_with_a_hot_id(docs_of):
    for hot in [(7, "some text"), (None, None), (None, "same")]:
        rows = [(i, "t" * (i % 30)) for i in range(2000)] + [hot] * 2000
        load, slots = Counter(), Counter()
        for r in sharding.shard(docs_of(rows), 8, n_slots=512).collect():
            load[r.shard] += r.size
            slots[r.virtual_slot] += 1
        assert len(load) == 8 and max(load.values()) <= 1.02 * min(load.values())
        assert max(slots.values()) <= 40


def test_written_shards_with_a_hot_id(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text {i}") for i in range(100)] + [(5, "same")] * 100, extra=["shard", "lane", "doc"])
    recs = sharding.records(docs)
    m = sharding.first_map(sharding.slot_bytes(recs), 5)
    sharding.write_shards(docs, m, str(tmp_path / "out"))
    got = Counter((r.doc_id, r.text, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    load = Counter()
    for (_, text, s), n in got.items():
        load[s] += n * (len(text) + 16)
    want = Counter()
    for r in recs.collect():
        want[m.shard_of[r.virtual_slot]] += r["size"]
    assert sum(got.values()) == 200 and load == want
