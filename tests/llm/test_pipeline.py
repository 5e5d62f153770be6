"""Every stage against a plain version on the same input, and the queries
against their SQL."""

import hashlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from . import test_decontam, test_rules, test_simhash, test_substring
from .conftest import SF
from tessera.llm import catalog

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "benchmark")}


def plain_rules(rows):
    out = []
    for r in rows:
        n, chars, symbols, dup, rep, lines, upper = test_rules.brute(r[1])
        if not (n < 20 or 100 * rep > 30 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 20 * n or 3 * upper > chars):
            out.append(r)
    return out


def plain_near(rows):
    comp = test_simhash.brute_components([(r[0], test_simhash.brute_fp(r[1])) for r in rows], 2)
    return [r for r, (i, c) in zip(rows, comp) if i == c]


def plain_cut(rows):
    new = {i: (kept, gone) for i, _, kept, gone in test_substring.brute([(r[0], r[1]) for r in rows], 13)}
    return [(r[0], new[r[0]][0], r[2], r[3], len(new[r[0]][0])) if new[r[0]][1] else r for r in rows]


def plain_clean(rows, items):
    bad = {x[0] for x in test_decontam.brute([(r[0], r[1]) for r in rows], items)}
    return [r for r in rows if r[0] not in bad]


def test_run(spark, tables):
    rows = [tuple(r) for r in tables["documents"][DOCS].itertuples(index=False)]
    items = list(tables["benchmark"][["item_id", "text"]].itertuples(index=False, name=None))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [plain_rules, plain_near, plain_cut, lambda x: plain_clean(x, items)]
    for (_, stage), by_hand in zip(corpus_pipeline.STAGES, plain):
        docs, rows = stage(spark, docs, SF), by_hand(rows)
        assert docs.columns == DOCS
        got = [tuple(r) for r in docs.collect()]
        assert sorted(got) == sorted(rows)
        docs = spark.createDataFrame(got, docs.schema)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r[0], len(e.ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e.ids)).hexdigest())
                  for r, e in zip(rows, lib.encode_batch([r[1] for r in rows], add_special_tokens=False)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest()) for r in got) == want


def test_stages_take_hard_rows(spark, docs_of):
    """Nulls, empty and long texts, repeated rows, other columns, no rows."""
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None), (2, ""), (None, good), (None, good), (3, good + " end"), (3, good + " end"), (4, good), (5, "long " + " ".join(f"x{i}" for i in range(50000)))]
    for given in (rows, []):
        docs = docs_of(given, extra=["id", "doc", "fp", "kept", "marks", "hits", "words"])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(got, docs.schema)
        assert bool(got) == bool(given)


def test_near_dedup_keeps_every_distinct_text(spark, docs_of):
    """Ids may repeat or be missing: what stays is a row per component."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "twelve red blue green yellow")
    stage = corpus_pipeline.simhash_near_dedup
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in stage(spark, docs_of(rows), SF).collect()), key=str)
    assert kept([(1, a), (5, a), (5, b), (9, c)]) == [(1, a), (5, b), (9, c)]
    assert kept([(None, a), (None, a), (None, b), (3, b), (None, c)]) == [(3, b), (None, a), (None, c)]
    assert kept([(7, a), (7, a), (7, a)]) == [(7, a)]
    assert kept([(i % 3, [a, b, c][i % 3]) for i in range(300)] + [(None, a)] * 100) == [(0, a), (1, b), (2, c)]


catalog.load_all()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    rows = lambda df: sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).where(
        df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_covers_its_table(spark, name):
    n = catalog.QUERIES[name](spark, SF).count()
    assert n == spark.read.parquet(f"{SF}/documents.parquet").count() or name == "op9_benchmark_decontamination" and n > 0
