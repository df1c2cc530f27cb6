"""SimHash groups against every pair."""

import random

import numpy as np
import xxhash

from colloquary.llm import simhash
from colloquary.llm.components import components
from tests.llm.helpers import documents, odd_rows, prose, words


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """smallest id per row from (id, fingerprint)"""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    nodes = sorted({f for _, f in prints})
    for i, a in enumerate(nodes):
        for b in nodes[i:]:
            if (a ^ b).bit_count() <= 4:
                parent[find(("f", b))] = find(("f", a))
    for doc, f in prints:
        parent[find(("d", doc))] = find(("f", f))
    least = {}
    for doc, _ in prints:
        r = find(("d", doc))
        least[r] = min(least.get(r, doc), doc)
    return {doc: least[find(("d", doc))] for doc, _ in prints}


def test_any_four_bytes_hold_a_triple():
    from itertools import combinations
    assert len(simhash.TRIPLES) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.TRIPLES)


def test_shared_bytes():
    rng = random.Random(1)
    for _ in range(1000):
        x = sum(rng.choice([0, 0, 1, 128, 255]) << 8 * i for i in range(8))
        assert simhash.shared_bytes(np.array([x], dtype=np.uint64))[0] == sum(
            (x >> 8 * i & 255) == 0 for i in range(8))


def test_documents(spark):
    rows = odd_rows()
    for s in range(30):
        text = prose(s, 200)
        rows.append((200 + s, text, "en", "s", 0))
        w = text.split(" ")
        for k in range(s % 4):
            w[k * 7] = "changed"
            rows.append((300 + 10 * s + k, " ".join(w), "en", "s", 0))
    df = documents(spark, rows, clashing=True)
    got = simhash.near_duplicates(df).withColumn("hex", simhash.hexadecimal()).collect()
    want = groups([(d, plain_fingerprint(t)) for d, t, *_ in rows if d is not None])
    assert len(got) == len(rows)
    texts = sorted((repr(d), f"{plain_fingerprint(t):016x}") for d, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.hex) for r in got) == texts
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 2


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_first(documents(spark, [])).count() == 0


def _linked(spark, prints):
    rows = [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(prints)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp bigint, low bigint")).collect()
    for a, b in links:
        assert (prints[a] ^ prints[b]).bit_count() <= 4
    found = {r.node: r.root for r in components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()} if links else {}
    want = groups(list(enumerate(prints)))
    assert {i: found.get(i, i) for i in range(len(prints))} == want


def _crowd(n=700):
    rng = random.Random(2)
    centre, prints = rng.getrandbits(64), set()
    while len(prints) < n:
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    return sorted(prints) + [rng.getrandbits(64) for _ in range(300)]


def test_a_crowd_of_near_prints(spark):
    _linked(spark, _crowd())


def test_crowded_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 100)
    _linked(spark, _crowd())


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(900, 960)]
    edges += [(5, 5), (70, 71), (71, 70), (70, 71), (60, 2)]
    got = {r.node: r.root for r in components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 0, 1000: 900,
                   **{i: 900 for i in range(900, 960)}, 70: 70, 71: 70}
