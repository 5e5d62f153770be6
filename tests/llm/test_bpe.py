import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHA = ["a", "s", "t", "'", "'s", "'re", "'ll", "'ve", "'m", "'S", " ", "  ", "\n", "\t", "\x85", "　", " ", " é", "ß", "1", "23", "²", "Ⅷ",
         "漢", "😀", ".", "!!", "<|endoftext|>", "<|endo", "the", " things", "re", "กิ", "\x1c", "\x00", "﻿", "é", "\U0001c89a", "Ᲊ"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    vocab = bpe.Vocabulary(PATH)
    words = sorted(w.encode() for w in [" the", "the", " of", " things", " thing", "ing", "!", " é", "é", "\n", "'t", " a", " ab", "a", "abc", "bc"])
    at = tmp_path_factory.mktemp("lexicon") / "x.bin"
    at.write_bytes(bpe.Automaton.pack(bpe.Automaton.compile([(w, vocab.merge(w)) for w in words], bpe.char_classes(PATH))))
    return bpe.Encoder(str(at), PATH), words


def same(encoder, lib, texts):
    ids, counts = encoder.encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    for t, a, b, d, want in zip(texts, ends - counts, ends, encoder.decode(ids, counts), lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == want.ids, repr(t)
        assert d.decode() == lib.decode(want.ids, skip_special_tokens=False)


def test_random_texts(encoder, lib):
    rnd = random.Random(6)
    same(encoder[0], lib, ["".join(rnd.choice(ALPHA) for _ in range(rnd.randint(0, 30))) for _ in range(4000)])


def test_every_code_point(encoder, lib):
    for lo in range(0, 0x110000, 0x4000):
        same(encoder[0], lib, ["".join(f"a{chr(c)}1{chr(c)}.{chr(c)} " for c in range(a, a + 64) if not 0xD800 <= c < 0xE000)
                               for a in range(lo, lo + 0x4000, 64)])


def test_long_words(encoder, lib):
    rnd = random.Random(1)
    same(encoder[0], lib, ["a" * 3000, "ab" * 2000, " " * 500 + "x", "'s" * 200, "".join(rnd.choice("abcdef") for _ in range(5000)), "", "ü" * 999])


def test_automaton(encoder):
    enc, words = encoder
    rnd = random.Random(2)
    asked = words + [w + b"x" for w in words] + [w[:-1] for w in words] + [bytes(rnd.choice(b"abc the") for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    asked = [w for w in asked if w]
    buf = np.frombuffer(b"".join(asked), dtype=np.uint8)
    size = np.array([len(w) for w in asked])
    got = enc.auto.numbers(buf, np.cumsum(size) - size, size)
    assert got.tolist() == [words.index(w) if w in words else -1 for w in asked]


def test_suffixes_are_shared():
    words = sorted(a + b for a in (b"un", b"re", b"out") for b in (b"do", b"doing", b"done"))
    arrays = bpe.Automaton.compile([(w, [i]) for i, w in enumerate(words)], np.zeros(4, np.uint8))
    trie = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(arrays["final"]) - 1 < len(trie) / 2
    assert bpe.Automaton.compile([], np.zeros(4, np.uint8))["ids"].size == 0


def test_cases_on_spark(spark, docs_of, lib):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "copy it"), (3, "copy it"), (4, "the <|endoftext|> 'tis é"), (5, "word " * 100000), (6, "z" * 20000)]
    got = bpe.encode(docs_of(rows, extra=["ids", "id", "decoded", "word", "n"]), PATH, limit=2).collect()
    want = sorted((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in [(i or 0, t) for i, t in rows])
    assert sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in rows)
    assert bpe.encode(docs_of([]), PATH).count() == 0


def test_frequent_words_are_bounded(docs_of):
    docs = docs_of([(1, "aa aa aa bb bb bb cc cc dd dd ee")])
    words = lambda n: {r.word for r in bpe.frequent_words(docs, "text", n).collect()}
    assert words(0) == set() and words(1) == words(3) == {" bb"} and words(4) == words(9) == {" aa", " bb", " cc", " dd"}
