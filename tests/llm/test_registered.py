"""The registered corpus queries on the smallest sample: against their SQL or brute force, or one row for each document."""

import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_exact_and_near import components_expected, fingerprint
from tests.llm.test_models_and_packing import lm_expected
from tickloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, tables, name):
    got = queries.queries()[name](spark, SF)
    want = tables.execute(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(c[0] for c in want.description) == columns
    order = [c[0] for c in want.description]
    rows = [tuple(r[order.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(rows, key=repr)


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall())


@pytest.mark.parametrize("name", ["op3_order_minhash", "op4_quality", "op7_toxicity", "op9_mixing"])
def test_query_gives_a_row_for_each_document(spark, texts, name):
    assert sorted(r.doc_id for r in queries.queries()[name](spark, SF).select("doc_id").collect()) == list(texts)


def test_simhash_query(spark, texts):
    prints = [(i, fingerprint(t)) for i, t in texts.items()]
    comp = components_expected(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {i: (format(p, "016x"), comp[i]) for i, p in prints}


def test_lm_query(spark, texts):
    want, total = lm_expected(list(texts.items()))
    got = {r.doc_id: r for r in queries.op6_lm_scores(spark, SF).collect()}
    assert len(got) == len(want)
    for i, n, known, base, score in want:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base) and abs(r.score - score) / n < 0.02


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_file())
    pieces, sequences = {}, {}
    for r in queries.op10_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert list(texts) == sorted(pieces)
    for i, text in texts.items():
        ids, at = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        ends = [o + n for o, n in sorted(held)]
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
