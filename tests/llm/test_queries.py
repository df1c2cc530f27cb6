"""Queries as they are registered, over the smallest tables."""

import zlib

import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry
from colloquary.llm.vocabularies import path_of
from tests.llm import test_language_model, test_prefix_trie, test_whitening

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def test_op1(run, table):
    library = sentencepiece.SentencePieceProcessor(model_file=path_of("piece_bpe_32k.model"))
    want = {}
    for doc, text, *_ in table("documents"):
        n = len(library.encode(text or ""))
        want[doc] = (len((text or "").encode()), n, n > 4096)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"])
            for r in run("op1_token_counts")} == want


def test_op7(run, table):
    found = run("op7_toxicity")
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in table("documents"))
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_op10(run, table):
    vectors = {i: np.array(v, dtype=float) for i, v, *_ in table("embeddings")
               if v is not None and None not in v}
    vectors = {i: v for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    found = {}
    for r in sorted(run("op10_vector_lists"), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["rank"], r["score"]))
    assert sorted(found) == sorted(i for i in vectors if i % 100 == 0)
    hit = 0
    for query, rows in found.items():
        apart = sorted((np.linalg.norm(vectors[query] - v), i) for i, v in vectors.items()
                       if i != query)[:10]
        assert [rank for _, rank, _ in rows] == list(range(1, 11))
        for vec, _, score in rows:
            assert score == pytest.approx(np.linalg.norm(vectors[query] - vectors[vec]), rel=1e-12)
        hit += len({i for _, i in apart} & {i for i, _, _ in rows})
    assert hit >= 9 * len(found)


def test_op11(run, table):
    order = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((*r[:5], round(r[5], 6), r[6]) for r in run("op11_language_model")), key=order)
    want = sorted(test_language_model.plain(table("documents")), key=order)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    # probabilities are quantised, to within 0.0005 of a logarithm
    assert all(abs(a[6] - b[6]) <= 5e-4 * b[2] for a, b in zip(got, want))
    apart = [r for r in got if r[1]]
    assert sum(r[6] for r in apart) > sum(r[5] for r in apart)


def test_op12(run, table):
    order = lambda r: (r[0], r[1], r[3])
    got = sorted(run("op12_whitening"), key=order)
    want = sorted(test_whitening.plain([r[:2] for r in table("embeddings")]), key=order)
    assert [tuple(r[:4]) for r in got] == [r[:4] for r in want]
    assert np.allclose([(abs(r[4]), r[5]) for r in got], [r[4:] for r in want],
                       rtol=1e-7, atol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_op13(run, table):
    order = lambda r: (r[1], r[0], r[7])
    assert sorted(map(tuple, run("op13_prefix_trie")), key=order) == sorted(
        test_prefix_trie.plain(table("conversations")), key=order)
