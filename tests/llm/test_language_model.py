"""The language model against a plain one, and tries against sorted lists."""

import zlib
from bisect import bisect_left
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquary.llm import language_model
from colloquary.llm.elias_fano import ABSENT, Monotone, Trie, quantise, restore
from tests.llm.helpers import documents, odd_rows, prose, words

U = np.uint64


def test_monotone():
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (1, 5), (5, 3), (1000, 100), (1000, 1000), (3000, 2**63)):
        values = np.sort(rng.integers(0, u, n, dtype=U))
        coded = Monotone(Monotone.encode(values))
        assert coded[np.arange(n)].tolist() == values.tolist()
        asked = np.concatenate([values, rng.integers(0, u, 500, dtype=U),
                                np.array([0, u, 2**64 - 1], dtype=U)])
        assert coded.successor(asked).tolist() == [
            bisect_left(values.tolist(), x) for x in asked.tolist()]
        distinct = np.unique(values)
        place = {x: i for i, x in enumerate(distinct.tolist())}
        assert Monotone(Monotone.encode(distinct)).index(asked).tolist() == [
            place.get(x, -1) for x in asked.tolist()]


def test_monotone_is_small():
    values = np.sort(np.random.default_rng(2).integers(0, 2**40, 100_000, dtype=U))
    bits = 8 * len(Monotone.encode(values)) / len(values)
    assert bits < 2 + np.log2(2**40 / len(values)) + 1


def test_trie():
    rng = np.random.default_rng(3)
    told = np.stack([rng.integers(0, 300, 20_000).astype(U) ** 3 * U(10**10),
                     rng.integers(0, 2000, 20_000).astype(U) ** 2 * U(999)], axis=1)
    pairs, n = np.unique(told, axis=0, return_counts=True)
    trie = Trie(Trie.build(pairs[:, 0], pairs[:, 1], n, {}))
    asked = np.stack([rng.permutation(told[:, 0]), rng.permutation(told[:, 1]) + U(0)], axis=1)
    asked = np.concatenate([asked, asked[:50] + U(1)])
    place = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    found = trie.find(trie.contexts.index(asked[:, 0]), trie.words.index(asked[:, 1]))
    assert found.tolist() == [place.get(tuple(a), -1) for a in asked.tolist()]
    counts = Counter()
    for (c, _), k in zip(pairs.tolist(), n.tolist()):
        counts[c] += k
    share = [k / counts[c] for (c, _), k in zip(pairs.tolist(), n.tolist())]
    assert np.allclose(restore(trie.shares), share, rtol=6e-4)


def test_quantised():
    p = np.array([1.0, 0.5, 1e-9, 1e-40])
    assert np.allclose(restore(quantise(p))[:3], p[:3], rtol=6e-4)
    assert quantise(p).max() < ABSENT


def plain(rows):
    def tokens(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [*words(lower), None]

    apart = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, *_ in rows]
    one, two, begins = Counter(), Counter(), 0
    for (_, text, *_), out in zip(rows, apart):
        if not out:
            said = tokens(text)
            begins += 1
            one.update(said)
            two.update(zip([0, *said], said))
    kinds = Counter(v for v, _ in two)
    n, known = sum(one.values()), len(one)
    for (doc, text, *_), out in zip(rows, apart):
        said, base, score = tokens(text), 0.0, 0.0
        for v, w in zip([0, *said], said):
            p = (one[w] + 1) / (n + known + 1)
            base += log10(p)
            c = begins if v == 0 else one[v]
            t = c / (c + kinds[v]) if c else 0.0
            score += log10(t * (two[v, w] / c if c else 0.0) + (1 - t) * p)
        yield (doc, out, len(said), sum(one[w] > 0 for w in said), n, round(base, 6), score)


def check(spark, rows, **how):
    found = language_model.learn_and_score(documents(spark, rows), **how)[1].collect()
    order = lambda r: (str(r[0]), r[2], r[5])
    want = sorted(plain(rows), key=order)
    got = sorted(((*r[:5], round(r[5], 6), r[6]) for r in found), key=order)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    for a, b in zip(got, want):
        assert a[6] == pytest.approx(b[6], abs=4e-4 * b[2] + 1e-9)


@pytest.mark.parametrize("shard", [10**9, 3000, 300])
def test_scores(spark, shard):
    check(spark, odd_rows() + [(200 + i, prose(i % 9, 150, 80), "en", "s", 0) for i in range(60)],
          shard_tokens=shard)


def test_long_texts_go_on(spark, monkeypatch):
    """In several blocks, each of which knows what came before."""
    blocks = language_model._cut
    monkeypatch.setattr(language_model, "BLOCK", 100)
    monkeypatch.setattr(language_model, "SLICE", 64)
    texts = [prose(5, 450), None, "", prose(6, 99), prose(7, 101), "a" * 300]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6)), pa.array([t and t.encode() for t in texts], pa.binary()),
         pa.array([True, False] * 3)], names=["doc_id", "text", "trains"])
    read = [language_model._Read.of(b.column("data")[0].as_py()) for b in blocks(iter([batch]))]
    assert len(read) > 5
    said: dict = {}
    for block in read:
        ids, _, _, _, lengths = block.pieces
        for doc, start, n in zip(ids, block.starts, lengths):
            tokens = block.hashes[block.tokens[start:start + n]].tolist()
            before = int(block.hashes[block.contexts[start]])
            assert before == (said[doc][-1] if doc in said else language_model.BEGIN)
            said.setdefault(doc, []).extend(tokens)
    for i, text in enumerate(texts):
        want = [xxhash.xxh64_intdigest(w.encode()) for w in words((text or "").lower())]
        assert said[i] == [*want, language_model.END]


def test_busy_contexts(spark):
    """One pair holds most of the table; its context is dealt over the shards by pair."""
    rows = [(i, "so so it is " * 40 + prose(i, 20, 50), "en", "s", 0) for i in range(40)]
    model, _ = language_model.learn_and_score(documents(spark, rows), shard_tokens=500)
    assert model.totals.busy
    check(spark, rows, shard_tokens=500)


def test_nothing(spark):
    check(spark, [])
    check(spark, [(1, None, None, None, None)])
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    check(spark, [(i, "never learnt from", "en", "s", 0) for i in out])


def test_other_columns(spark):
    df = documents(spark, clashing=True)
    for name in ("row", "trains", "shard", "data", "held_out"):
        df = df.withColumn(name, F.lit("x"))
    assert language_model.learn_and_score(df)[1].count() == len(odd_rows())


def test_sums_to_one(spark):
    """Over the known words and one unknown, after each context."""
    rows = [(i, prose(i % 5, 40, 15), "en", "s", 0) for i in range(12)]
    model, _ = language_model.learn_and_score(documents(spark, rows), apart=F.lit(False))
    levels = {r["name"]: r["data"] for r in model.levels.collect()}
    trie = Trie({k: bytes(v) for k, v in levels.items()})
    first = trie.pointers[np.arange(trie.pointers.n)].astype(int)
    shares = [restore(trie.shares[a:b]).sum() for a, b in zip(first, first[1:])]
    assert np.allclose(shares, 1, rtol=1e-3)
