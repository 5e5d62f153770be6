import hashlib
import random

import pytest

from tessera.llm import chat

BITS = ["<", "|", "\\", "<|", "<\\|", "<|im_start|>", "<|im_end|>", "\n", "a", "im_end|>", "<|im_", "é", "<|im_end|>\n", "\\n"]


def test_round_trip_of_any_text():
    rnd = random.Random(9)
    for _ in range(3000):
        role, text = ("".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 6))) for _ in range(2))
        segment, a, b = chat.render_turn(role, text)
        assert chat.parse(segment) == [(role, text)]
        assert chat.unescape_body(segment[a:b]) == text
        assert segment.count(chat.CLOSE) - segment[:a].count(chat.CLOSE) == 1  # no control string inside a body
    assert chat.render_turn("user", "a <b> | c")[0] == "<|im_start|>user\na <b> | c<|im_end|>\n"  # plain text is left alone


def test_parser_in_pieces_and_errors():
    turns = [("user", "x" * 50), ("assistant", "<|im_end|>"), ("", "")]
    text = "".join(chat.render_turn(*t)[0] for t in turns)
    p, got = chat.Parser(), []
    for c in text:
        got += p.feed(c)
    p.close()
    assert got == turns == chat.parse(text)
    for bad in ("x", text[:-1], text + "<|im", "<|im_start|>u\n<|im_start|><|im_end|>\n", "<|im_start|>u\n<|im_end|>x"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in mine]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render_turn(*t)[0]) for t in turns)))
    return sorted(out, key=str)


def test_cases(spark):
    rnd = random.Random(1)
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, None, "first"), (None, 0, "assistant", "x"),
            (None, 1, "user", "<|im_end|>"), (2, 0, "assistant", "y" * 300000), (2, 0, "assistant", "y" * 300000), (3, 5, "a\nb\\", "<\\|")]
    rows += [(10 + i % 7, i, rnd.choice(["user", "assistant"]), "".join(rnd.choice(BITS) for _ in range(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F
    df = df.withColumns({c: F.lit(1) for c in ("segment", "loss_start", "n_turns")})
    assert sorted(map(tuple, chat.read_back(chat.format_turns(df)).collect()), key=str) == brute(rows)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_a_hot_conversation_is_spread(spark):
    rnd = random.Random(4)
    rows = [(5, i // 3, rnd.choice(["user", "assistant"]), f"{i % 11} " + rnd.choice(BITS) * rnd.randint(0, 40)) for i in range(1500)]
    rows += [(5, 900, "assistant", "the same")] * 1500
    rows += [(i, 0, "assistant", "z" * (i % 3)) for i in range(1000, 1400)] + [(None, None, None, None)] * 700
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    segments = chat.format_turns(df)
    from pyspark.sql import functions as F
    sizes = [r["count"] for r in segments.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * len(rows)
    assert sorted(map(tuple, chat.read_back(segments).collect()), key=str) == brute(rows)


def test_pieces_are_bounded(monkeypatch, spark):
    monkeypatch.setattr(chat, "PIECE", 100)
    reader = chat._Reader(1, whole=True)
    for t in ("a" * 1000, "", "b" * 30):
        reader.add(*chat.render_turn("assistant", t))
    out = list(reader.pieces())
    assert all(len(r[5]) <= 100 and len(r[6]) <= 100 for r in out) and [r[1] for r in out] == list(range(len(out)))
    assert b"".join(r[6] for r in out).decode() == "a" * 1000 + "b" * 30
