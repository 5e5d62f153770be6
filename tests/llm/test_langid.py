import random

import numpy as np
import pytest

from tessera.llm import langid
from tessera.llm.catalog import QUERIES, load_all
from tests.llm.conftest import SF


def plain_phrases(body: bytes, text: bytes) -> int:
    """Greedy longest matches by string search, in pieces."""
    n = 0
    for at in range(0, len(body), langid.PIECE):
        piece, i = body[at:at + langid.PIECE], 0
        while i < len(piece):
            j = i + 1
            while j < len(piece) and piece[i:j + 1] in text:
                j += 1
            i, n = j, n + 1
    return n


def test_phrases_equal_a_plain_parse():
    rnd = random.Random(3)
    for letters in ("ab", "abcd", "abcdefghij"):
        pieces = ["".join(rnd.choices(letters, k=rnd.randint(1, 60))).encode() for _ in range(5)]
        x = langid.learn("x", pieces)
        bodies = ["".join(rnd.choices(letters + "z", k=rnd.choice([0, 1, 7, 50, 300]))).encode() for _ in range(40)]
        bodies += [b"".join(pieces), pieces[0] * 200]
        got = langid.phrase_counts(bodies, [x, langid.learn("y", [b"z"])])
        assert got[:, 0].tolist() == [plain_phrases(b, b"\0".join(pieces)) for b in bodies]
        assert got[:, 1].tolist() == [plain_phrases(b, b"z") for b in bodies]


def test_automaton_accepts_substrings_only():
    text = [1, 2, 1, 1, 2, 2, 1, 2, 1]
    edges = langid.automaton(text)
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    found, todo = set(), [((), 0)]
    while todo:
        word, state = todo.pop()
        for c, to in edges[state].items():
            found.add(word + (c,))
            todo.append((word + (c,), to))
    assert found == subs


def _labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, best string, step int")


def _out(df):
    return sorted(((r.doc_id, r.lang_pred, round(r.score, 6)) for r in df.collect()), key=str)


def test_cases(spark, tmp_path):
    rnd = random.Random(1)
    word = {"aa": "abcde", "bb": "fghij"}
    rows = [(i, " ".join("".join(rnd.choices(word[k], k=5)) for _ in range(60)), k, None, 1)
            for i, k in enumerate(["aa", "bb"] * 20)]
    model = langid.fit(_labelled(spark, rows)).cache()
    assert {r["name"] for r in model.collect()} == {"aa", "bb"}
    asked = [(1, "ABCD eab", None, None, 1), (1, "ABCD eab", None, None, 1), (2, "fgh ij! fghi", "aa", None, 1), (3, None, "aa", None, 1),
             (4, "", "aa", None, 1), (5, "12 34 ... ²", "aa", None, 1), (None, "jihgf " * 40000, None, None, 1)]
    got = {(r.doc_id, r.lang_pred, 0.5 <= r.score <= 1) for r in langid.predict(_labelled(spark, asked), model).collect()}
    assert got == {(1, "aa", True), (2, "bb", True), (3, "und", False), (4, "und", False), (5, "und", False), (None, "bb", True)}
    assert langid.predict(_labelled(spark, asked), model).count() == len(asked)
    nothing = langid.predict(_labelled(spark, asked), langid.fit(_labelled(spark, [])))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.predict(_labelled(spark, []), model).count() == 0


def test_a_tie_goes_by_name(spark):
    same = [(i, "one two three", k, None, 1) for i in range(60) for k in ("q", "p")]
    got = langid.predict(_labelled(spark, [(1, "two one", None, None, 1)]), langid.fit(_labelled(spark, same))).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("p", 0.5)]


def test_blocks_of_languages_agree(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choices(f"abcdefgh{k} ", k=400)), k, None, 1) for i, k in enumerate("uvwxyz" * 10)]
    model = langid.fit(_labelled(spark, rows)).cache()
    whole = langid.predict(_labelled(spark, rows), model, settings=langid.Settings(block_langs=10))
    parts = langid.predict(_labelled(spark, rows), model, settings=langid.Settings(block_langs=1))
    assert _out(whole) == _out(parts)


def test_sample_is_bounded_and_counts_copies_once(spark):
    rows = [(i, "same text " * 100, "en", None, 1) for i in range(50)] + [(99, "other words here", "en", None, 1)]
    s = langid.Settings(segments=3, segment_bytes=64)
    got = [bytes(r.piece) for r in langid.sample(_labelled(spark, rows), s).collect()]
    assert len(got) == len(set(got)) == 3


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark, tmp_path):
    rows = [(i, "abc abd " * 20 if i % 2 else "xyz xyw " * 20, "p" if i % 2 else "q", None, 1) for i in range(60)]
    from zlib import crc32
    turned = [(i, t, ("q" if k == "p" else "p") if crc32(str(i).encode()) % 4 == 2 else k, b, n) for i, t, k, b, n in rows]
    a, b = (langid.identify(_labelled(spark, x), str(tmp_path / n)) for x, n in ((rows, "a"), (turned, "b")))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in a.collect())


def test_held_out_accuracy(spark):
    load_all()
    out = QUERIES["op13_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
