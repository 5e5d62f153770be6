"""Conversation prefix trie by ROLLUP over positional turn-id columns.

A turn's id holds a digest of its role and text, and the text's bytes.  A
conversation is cut into blocks of ``width`` turns; a row per block has the turn
ids as columns, and the key of the node that the earlier blocks lead to.  One

    GROUP BY block, base, ROLLUP (t0, ..., t7)

makes all nodes of all blocks: ``grouping_id`` tells how deep in its block a node
lies.  A key is the XOR of a 128-bit hash of every (place, turn id) of the path,
so a block's base, a parent's key and the key of a conversation's end come from
each other without a walk; bases of long conversations are running XORs in two
levels of bounded windows.

A node is owned by its smallest member, which so owns its path from some depth
on (``owned_from``).  The first ROLLUP finds that depth; the second sums over
the members of a node what they add to its subtree:

    saved(v)  = sum over members other than the owner of
                (bytes of their turns before ``owned_from`` - bytes before v)
    leaves(v) = members that own a leaf

so nothing walks up the tree level by level, however deep it is.

Turns are placed by a range sort with offsets, so a conversation of any share of
the rows is spread.  SHA-256 is sequential: the ids of one node's ends are
joined in parallel into chunks, and only the digest runs over them in order.

Defined cases: rows of one turn number follow by role and text, nulls first;
rows without a conversation id belong to none and make no node; an id that
occurs with no other row than its own is a conversation like any other; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

WIDTH = 8
SPAN = 1024  # blocks in a window of running keys
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_id(role: str, text: str) -> Column:
    """16 bytes: 12 of a digest of role and text, 4 of the text's size."""
    both = F.concat_ws(":", F.length(role).cast("string"), role, text)
    return F.unhex(F.concat(F.substring(F.md5(both), 1, 24), F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def turn_bytes(t) -> Column:
    return F.conv(F.hex(F.substring(t, 13, 4)), 16, 10).cast("long")


def _place_hash(place, t) -> tuple[Column, Column]:
    return F.xxhash64(place, t), F.xxhash64(t, F.lit("place"), place)


# ---------------------------------------------------------------- turns
def placed_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, tid)``: turns with their 1-based place."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id())  # parts equal rows, whose order is free
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("row")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (c.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .select("conv_id", turn_id("role", "text").alias("tid"), F.monotonically_increasing_id().alias("at")))
    s = s.checkpoint()  # places survive a second reading
    sizes = dict(s.groupBy(F.shiftright("at", 33)).count().collect())  # a number per partition
    ahead, total = [], 0
    for p in sorted(sizes):
        ahead += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += sizes[p]
    base = F.element_at(F.create_map(*ahead), F.shiftright("at", 33)) if ahead else F.lit(0).cast("long")
    s = s.withColumn("at", base + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    starts = s.groupBy("conv_id").agg(F.min("at").alias("start"))
    return s.join(starts, "conv_id").select("conv_id", (F.col("at") - F.col("start") + 1).alias("place"), "tid")


def shared_heads(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilds conversations so that they share beginnings: conversation c
    takes its first h = crc32(c) % ``heads`` turns from c - c % ``every``, and
    its own from there on.  Returns the turns, and ``(conv_id, n_turns)`` of
    every conversation, the empty ones included."""
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    own = own.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    of_base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    info = own.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    tail = (turns.join(info.select("conv_id", "h", "taken"), "conv_id").where("place > h")
            .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "tid"))
    begun = turns.where(F.col("place") < heads).select(F.col("conv_id").alias("base"), "place", "tid")  # few of each
    head = begun.join(info.select("conv_id", "base", "h"), "base").where("place <= h").select("conv_id", "place", "tid")
    sizes = info.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return head.unionByName(tail), sizes


# ---------------------------------------------------------------- blocks
def blocks_of(turns: DataFrame, sizes: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(conv_id, n_turns, block, base1, base2, base_bytes, x1, x2, t0, t1, ...)``:
    a row per block of a conversation, the first one also of an empty one; the
    base is the key of the path before the block, x its own part of the key."""
    slot = (F.col("place") - 1) % width
    h1, h2 = _place_hash("place", "tid")
    b = turns.groupBy("conv_id", F.expr(f"(place - 1) div {width}").alias("block")).agg(
        *[F.max(F.when(slot == i, F.col("tid"))).alias(f"t{i}") for i in range(width)],
        F.bit_xor(h1).alias("x1"), F.bit_xor(h2).alias("x2"), F.sum(turn_bytes("tid")).alias("size"))
    path = scratch_path(turns.sparkSession, "trie-cut")
    b.join(sizes, "conv_id").write.parquet(path)
    b = turns.sparkSession.read.parquet(path)

    sums = [("x1", F.bit_xor), ("x2", F.bit_xor), ("size", F.sum)]
    names = ["base1", "base2", "base_bytes"]
    later = b.where(F.col("n_turns") > width).withColumn("span", F.expr(f"block div {SPAN}"))
    # keys of whole spans first, then of the blocks in each: no window holds more than a span's blocks, or a row per span
    whole = later.groupBy("conv_id", "span").agg(*[f(c).alias(c) for c, f in sums])
    over = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "span", *[F.coalesce(f(c).over(over), F.lit(0)).alias(f"_{n}") for (c, f), n in zip(sums, names)])
    inside = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = later.withColumns({n: F.coalesce(f(c).over(inside), F.lit(0)) for (c, f), n in zip(sums, names)}).join(whole, ["conv_id", "span"])
    later = later.withColumns({"base1": F.col("base1").bitwiseXOR(F.col("_base1")), "base2": F.col("base2").bitwiseXOR(F.col("_base2")),
                               "base_bytes": F.col("base_bytes") + F.col("_base_bytes")})
    none = {n: F.lit(0).cast("long") for n in names}
    ts = [f"t{i}" for i in range(width)]
    empty = sizes.where("n_turns = 0").withColumns(none | {c: F.lit(0).cast("long") for c in ("block", "x1", "x2")}
                                                   | {t: F.lit(None).cast("binary") for t in ts})
    columns = ["conv_id", "n_turns", "block", *names, "x1", "x2", *ts]
    return (later.select(columns).unionByName(b.where(F.col("n_turns") <= width).withColumns(none).select(columns))
            .unionByName(empty.select(columns)))


def _rollup(blocks: DataFrame, measures: str, width: int) -> DataFrame:
    """All nodes of all blocks with ``measures`` over their members: ``level`` turns of
    the block lead to a node, ``tids`` holds their ids."""
    ts = [f"t{i}" for i in range(width)]
    made = blocks.sparkSession.sql(
        f"select block, base1, base2, base_bytes, {', '.join(ts)}, grouping_id() as gid, {measures} from {{blocks}} "
        f"group by block, base1, base2, base_bytes, rollup({', '.join(ts)})", blocks=blocks)
    made = made.withColumn("level", width - F.bit_count("gid"))  # a bit per column that is rolled up
    # behind a conversation's end its columns are null and no node; a block's start is the node before it
    real = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(
        F.coalesce(*[F.when(F.col("level") == i + 1, F.col(t).isNotNull()) for i, t in enumerate(ts)]))
    return made.where(real)


def _keyed(nodes: DataFrame, width: int) -> DataFrame:
    """``depth``, own and parent's key, bytes of the turns before the last."""
    place = F.col("block") * width
    key, parent, before = [F.col("base1"), F.col("base2")], [F.lit(None).cast("long")] * 2, F.col("base_bytes")
    for i in range(width):
        t, none = F.col(f"t{i}"), F.lit(0).cast("long")
        for j, h in enumerate(_place_hash(place + (i + 1), t)):
            key[j] = key[j].bitwiseXOR(F.when(F.col("level") > i, h).otherwise(none))
            parent[j] = F.when(F.col("level") == i + 1, h).otherwise(parent[j])
        before = before + F.when(F.col("level") > i + 1, turn_bytes(t)).otherwise(none)
    made = nodes.withColumns({"depth": (place + F.col("level")).cast("long"), "k1": key[0], "k2": key[1],
                              "_last1": parent[0], "_last2": parent[1], "before": before})
    return made.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("_last1")), "p2": F.col("k2").bitwiseXOR(F.col("_last2"))})


# ---------------------------------------------------------------- digests of ends
def _chunks(batches, most: int = 1 << 16):
    """Of sorted ``(k1, k2, depth, conv_id)`` the runs of a node as joined text."""
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        rows, at = [], 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or i - at == most or any(c[i] != c[at] for c in cols[:3]):
                rows.append((cols[0][at], cols[1][at], cols[2][at], cols[3][at], ",".join(map(str, cols[3][at:i]))))
                at = i
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["k1", "k2", "depth", "first", "text"])


def _digests(batches):
    """Of sorted chunks the digest per node; a node may go on in the next batch."""
    names = ["k1", "k2", "depth", "ends_sha256"]
    key = state = None
    for b in batches:
        done = []
        for k1, k2, depth, _, text in zip(*(c.to_pylist() for c in b.columns)):
            if key != (k1, k2, depth):
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2, depth), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names)


def ends_digest(ends: DataFrame) -> DataFrame:
    """``(k1, k2, depth, ends_sha256)`` of ``(k1, k2, depth, conv_id)``."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["k1", "k2", "depth"]
    runs = ends.select(*key, "conv_id").repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunks = runs.mapInArrow(_chunks, "k1 long, k2 long, depth long, first long, text string")
    dealt = chunks.repartition(n, *key).sortWithinPartitions(*key, "first")
    return dealt.mapInArrow(_digests, "k1 long, k2 long, depth long, ends_sha256 string")


# ---------------------------------------------------------------- trie
def prefix_trie(turns: DataFrame, sizes: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of ``turns`` (``conv_id, place, tid``) of
    the conversations ``sizes`` (``conv_id, n_turns``): ``conv_id`` (the
    smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = turns.sparkSession
    path = scratch_path(spark, "trie-blocks")
    blocks_of(turns, sizes, width).write.parquet(path)
    blocks = spark.read.parquet(path)

    # where every conversation's own part of the tree begins, and whether it owns a leaf
    nodes = _rollup(blocks, "min(conv_id) as conv_id, max(n_turns) as longest", width)
    depth = F.col("block") * width + F.col("level")
    own = nodes.groupBy("conv_id").agg(F.min(depth).alias("owned_from"),
                                       F.max((F.col("longest") == depth).cast("long")).alias("leaf"))
    path = scratch_path(spark, "trie-owners")
    own.write.parquet(path)
    own = _before_owned(blocks, spark.read.parquet(path), width)

    members = blocks.join(own, "conv_id")
    nodes = _rollup(members, "min(conv_id) as conv_id, count(*) as n_convs, sum(leaf) as n_leaves, sum(extra) as extra, "
                             "min(struct(conv_id, extra)).extra as own_extra", width)
    path = scratch_path(spark, "trie-nodes")
    (_keyed(nodes, width).select("conv_id", "depth", "k1", "k2", "p1", "p2", "n_convs", "n_leaves",
                                 (F.col("extra") - F.col("own_extra") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"))
     .write.parquet(path))
    nodes = spark.read.parquet(path)

    key = ["k1", "k2", "depth"]
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    last = F.expr(f"greatest(n_turns - 1, 0) div {width}")
    ends = blocks.where(F.col("block") == last).select(
        "conv_id", F.col("n_turns").cast("long").alias("depth"), F.col("base1").bitwiseXOR(F.col("x1")).alias("k1"),
        F.col("base2").bitwiseXOR(F.col("x2")).alias("k2"))
    whole = nodes.join(children, key, "left").join(ends_digest(ends), key, "left")
    # as many nodes as there are first turns hang from the root, so its id goes to them as a constant
    root = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]
    parents = nodes.where("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"),
                                              F.col("conv_id").alias("parent_conv_id"))
    first = whole.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root).cast("long")))
    rest = whole.where("depth > 1").join(parents, ["p1", "p2", "depth"])
    every = first.unionByName(rest)
    return every.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
                        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def _before_owned(blocks: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """``(conv_id, extra, leaf)``: bytes of a conversation's turns before the
    depth from which it owns its path (all, if it owns nothing)."""
    b = blocks.join(own, "conv_id", "left")
    until = F.coalesce("owned_from", F.col("n_turns") + 1)
    parts = [F.when(F.col("block") * width + (i + 1) < until, F.coalesce(turn_bytes(f"t{i}"), F.lit(0))).otherwise(0) for i in range(width)]
    return b.groupBy("conv_id").agg(F.sum(sum(parts[1:], parts[0])).cast("long").alias("extra"), F.max(F.coalesce("leaf", F.lit(0))).alias("leaf"))
