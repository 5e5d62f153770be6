"""Ring of label mates in blocks against a plain version."""

import hashlib

import numpy as np
import pytest

from tessera.operators import builders as B


def plain(rows, window):
    """Positives of every key: the mates of all its rows, ranks first, each with all texts of its key."""
    texts, rings, found = {}, {}, {}
    for key, text, label in rows:
        texts.setdefault(key, []).append(text)
        if label is not None:
            rings.setdefault(label, []).append(key)
    for label, keys in rings.items():
        keys.sort(key=lambda k: ("" if k is None else hashlib.md5(f"0:ring:{k}".encode()).hexdigest(), k or 0))
        for r, key in enumerate(keys):
            for k in range(1, min(window, len(keys) - 1) + 1):
                mate = keys[(r + k) % len(keys)]
                if key is not None and mate is not None:
                    found.setdefault(key, []).extend((k, t is not None, t or "") for t in texts[mate])
    return sorted(((key, text, label, tuple(t if there else None for _, there, t in sorted(found.get(key, []))))
                   for key, text, label in rows), key=str)


@pytest.mark.parametrize("block", [8, 1024])
def test_mates_of_blocks_equal_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(B, "RING_BLOCK", block)  # a ring of 16 blocks, or a part of one
    rng = np.random.default_rng(block)
    rows = [(i, f"text {i}", "hot") for i in range(131)]
    rows += [(200 + i, f"t{i}", f"small{n}") for n in (1, 2, 5, 8, 9, 16, 17) for i in range(20 * n, 21 * n)]
    rows += [(900 + i, None if i == 2 else f"u{i}", None if i == 3 else "odd") for i in range(6)]
    for extra in (rows, rows + [(5, "again", "hot"), (5, "other ring", "small9"), (902, "v", None), (903, "w", None)]):
        extra = [extra[i] for i in rng.permutation(len(extra))]
        df = spark.createDataFrame(extra, "k long, t string, l string")
        got = B.classification_to_clustering(df, "t", "l", "k", window=8).collect()
        assert sorted(((r.k, r.query, r.cluster, tuple(r.positive)) for r in got), key=str) == plain(extra, 8)


def test_rows_without_a_key_have_no_mates_and_are_none(spark):
    df = spark.createDataFrame([(None, "a", "x"), (1, "b", "x"), (2, "c", "x"), (None, None, None)], "k long, t string, l string")
    got = {(r.k, r.query): sorted(r.positive) for r in B.classification_to_clustering(df, "t", "l", "k").collect()}
    assert got == {(None, "a"): [], (1, "b"): ["c"], (2, "c"): ["b"], (None, None): []}
