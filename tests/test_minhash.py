"""MinHash of every hash configuration against whole-number Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.operators import dedup as D

NON_WORD = re.compile(r"[^\w]")


def plain_hash(text: str, func: str, bits: int) -> int:
    size = min(bits, 32)
    if func == "xxh3":
        return xxhash.xxh3_64_intdigest(text.encode()) % (1 << size)
    digest = getattr(hashlib, func)(text.encode()).hexdigest()
    return int(digest[:size // 4], 16)


def plain_signature(text: str, cfg) -> list[int] | None:
    words = NON_WORD.split(text.lower())
    if len(words) < cfg.min_length:
        return None
    n = cfg.ngram
    grams = {" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} or {" ".join(words)}
    hs = [plain_hash(g, cfg.hash_func, cfg.hash_bits) for g in grams]
    prime, most = D.HASH_WIDTHS[cfg.hash_bits]
    a, b = D.permutations(cfg.num_perm, cfg.seed, cfg.hash_bits)
    return [min((int(x) * h + int(y)) % prime & most for h in hs) for x, y in zip(a, b)]


CONFIGS = [D.MinHashConfig(num_perm=40, hash_func=f, hash_bits=n) for f in D.HASH_FUNCS for n in (16, 32, 64)]
CONFIGS.append(D.MinHashConfig(num_perm=40))


@pytest.mark.parametrize("bits", [16, 32, 64])
def test_affine_equals_whole_numbers(bits):
    prime, most = D.HASH_WIDTHS[bits]
    rng = np.random.default_rng(bits)
    size = min(bits, 32)
    edge = [0, 1, prime - 1, prime - 2, 1 << 29, (1 << 32) - 1, 1 << 32]
    a = np.array([x for x in edge if 0 < x < prime] + [int(x) for x in rng.integers(1, prime, 300)], dtype=np.uint64)
    b = np.array([prime - 1] * 4 + [int(x) for x in rng.integers(0, prime, len(a) - 4)], dtype=np.uint64)
    h = np.array([0, 1, (1 << size) - 1, 1 << (size - 1)] + [int(x) for x in rng.integers(0, 1 << size, 200)], dtype=np.uint64)
    got = D._affine(a[:, None], h[None, :], b[:, None], bits)
    for i in range(len(a)):
        assert got[i].tolist() == [(int(a[i]) * int(x) + int(b[i])) % prime & most for x in h]


@pytest.mark.parametrize("cfg", CONFIGS, ids=lambda c: f"{c.hash_func}-{c.hash_bits}")
def test_signatures_equal_plain_ones(spark, cfg):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"Wört{j}" for j in rng.integers(0, 30, n)) for n in (5, 6, 9, 40, 400)]
    texts += [texts[3], "zu kurz", "", "a,b c--d", None]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, signature string").repartition(3)
    got = {r["id"]: list(r["signature"]) for r in D.minhash_signature(docs, "doc_id", "text", cfg).collect()}
    want = {i: plain_signature(t, cfg) for i, t in enumerate(texts) if t is not None}
    assert got == {i: s for i, s in want.items() if s is not None}


def test_big_rows_go_through_in_pieces():
    a, b = D.permutations(30, 1, 64)
    h = np.arange(5000, dtype=np.uint64) * np.uint64(858993)
    one = D._signature_block([h], a, b, 64)[0]
    cut = D._signature_block([h], a, b, 64, budget=3000)[0]
    assert one.tolist() == cut.tolist()


def test_unknown_configurations_are_refused():
    for func, bits in (("sha1", 28), ("md5", 24), ("crc", 32)):
        with pytest.raises(ValueError):
            D.MinHashConfig(hash_func=func, hash_bits=bits)


def test_near_duplicates_by_xxh3(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " end"), (4, " ".join(f"v{i}" for i in range(200)))],
                                 "doc_id long, text string")
    cfg = D.MinHashConfig(num_perm=250, threshold=0.7, hash_func="xxh3", hash_bits=64)
    got = {r["id"]: r["cluster"] for r in D.near_dup_clusters(docs, "doc_id", "text", cfg).clusters.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("cfg", CONFIGS, ids=lambda c: f"{c.hash_func}-{c.hash_bits}")
def test_signatures_of_many_sizes_leave_in_bounded_batches(cfg, monkeypatch):
    """Repeated hashes, rows longer than a piece, the ends of the range, null and
    empty lists; a worker hands on at most OUT_BYTES of signatures at a time."""
    monkeypatch.setattr(D, "OUT_BYTES", 1 << 18)
    rng = np.random.default_rng(11)
    top = (1 << min(cfg.hash_bits, 32)) - 1
    rows = [rng.integers(0, top + 1, n).astype(np.int64) for n in (0, 1, 7, 31, 32, 33, 300, 301, D.PIECE, 5 * D.PIECE + 3)]
    rows += [np.array([0] * 40 + [top] * 40), np.array([top, 0, 1, top - 1] * 20), np.repeat(rows[6], 3), np.arange(200)] * 3
    rows = [*rows, None] * 10
    a, b = D.permutations(250, 3, cfg.hash_bits)
    want = D._signature_block([np.asarray(x if x is not None else [], dtype=np.uint64) for x in rows[:53]], a, b, cfg.hash_bits)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.int64()))], ["id", "signature"])
    out = list(D._signed(250, 3, cfg.hash_bits)([batch.slice(5), batch.slice(0, 5)]))
    assert len(out) > 2 and max(x.num_rows * 250 * 8 for x in out) <= D.OUT_BYTES
    got = {i: v for x in out for i, v in zip(x.column("id").to_pylist(), x.column("signature"))}
    assert len(got) == len(rows)
    for i in range(53):
        assert got[i].values.to_numpy().tolist() == want[i].tolist(), i


@pytest.mark.parametrize("cfg", CONFIGS, ids=lambda c: f"{c.hash_func}-{c.hash_bits}")
def test_texts_are_hashed_a_few_at_a_time(cfg, monkeypatch):
    """However many rows a batch has, and however long a text is; null, empty
    and short texts; blanks at both ends are empty pieces."""
    monkeypatch.setattr(D, "TEXT_BYTES", 1 << 12)
    monkeypatch.setattr(D, "HASHED", 50)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"wört{j}" for j in rng.integers(0, 90, n)) for n in rng.integers(1, 60, 300)]
    texts += [None, "", "a b c", "    ", " a b c ", "a  b c d", " ".join(f"w{j}" for j in range(3000)), texts[0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "signature"])
    out = list(D._hashed(cfg)([batch.slice(3), batch.slice(0, 3)]))
    most = max(len(x.encode()) for x in texts[:300])
    assert len(out) > 10
    assert all(sum(len((texts[i] or "").encode()) for i in x.column("id").to_pylist()) <= max(D.TEXT_BYTES + most, 20_000) for x in out)
    got = {i: v for x in out for i, v in zip(x.column("id").to_pylist(), x.column("signature").to_pylist())}
    want = {}
    for i, t in enumerate(texts):
        words = t.split(" ") if t is not None else []
        if len(words) >= cfg.min_length:
            grams = {" ".join(words[k:k + cfg.ngram]) for k in range(len(words) - cfg.ngram + 1)}
            want[i] = sorted({plain_hash(g, cfg.hash_func, cfg.hash_bits) for g in grams})
    assert got == want


@pytest.mark.parametrize("bits", [16, 28, 32])
def test_scaled_words_keep_the_order_of_the_values(bits):
    """The ends of the range, where rounding is closest to the scale."""
    prime, most = D.HASH_WIDTHS[bits]
    signer = D.ScaledSigner(2, 1, bits)
    h = [0, 1, (1 << bits) - 1, (1 << bits) - 2, 1 << (bits - 1), *range(2, 40)]
    for a, b in [(1, 0), (1, prime - 1), (prime - 1, 0), (prime - 1, prime - 1), (prime // 2, 1), (prime - 2, prime // 2)]:
        signer.a[:] = (a << 64) // prime
        signer.b[:] = ((b << 64) // prime) + (1 << bits)
        for x in h:
            assert signer.sign([np.array([x], dtype=np.uint64)])[0, 0] == (a * x + b) % prime
        assert signer.sign([np.array(h, dtype=np.uint64)])[0, 0] == min((a * x + b) % prime for x in h)
    assert signer.sign([np.zeros(0, np.uint64)])[0, 0] == most
