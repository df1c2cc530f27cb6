"""Line dedup against every pair."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import spark_partition_id

from colloquary.llm import line_dedup
from tests.llm.helpers import documents, odd_rows, prose, same_rows, simple


def brute(rows, t=0.8):
    """rows of doc_id, text → texts, by comparing each line with all earlier ones"""
    lines = []
    for doc, text in {(d, x) for d, x in rows if d is not None and x}:
        for n, line in enumerate(text.encode().split(b"\n")):
            if line.split():
                lines.append((doc, n, frozenset(line.split())))
    lost = set()
    for doc, n, mine in lines:
        if any((d, m) < (doc, n) and len(mine & s) >= t * len(mine | s) - 1e-9
               for d, m, s in lines):
            lost.add((doc, n, mine))
    return [(d, x if d is None or x is None else "\n".join(
        line for n, line in enumerate(x.split("\n"))
        if (d, n, frozenset(line.encode().split())) not in lost)) for d, x in rows]


def check(spark, rows, clashing=False):
    full = [(d, x, "en", "s", 0) for d, x in rows]
    df = documents(spark, full, clashing)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
    assert same_rows(got, brute(rows))


def test_odd_texts(spark):
    check(spark, [(d, t) for d, t, *_ in odd_rows() if t is None or len(t) < 20_000], True)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_near_lines_of_all_kinds(spark):
    rng, rows = random.Random(5), []
    known = [prose(9, 3000, 300).replace("\n", " ").split()[i * 40:(i + 1) * 40]
             for i in range(40)]
    for doc in range(120):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(known))[:rng.choice([1, 2, 3, 5, 9, 10, 11, 20, 40])]
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(["new", "other", "more", "x", "y"])
            rng.shuffle(line)
            lines.append(" ".join(line))
        rows.append((rng.randint(0, 10_000) * 2 + doc % 2, "\n".join(lines)))
    check(spark, rows)


def test_a_nearest_that_does_not_match(spark):
    # long sets saturate the bitmap, so candidates are many and some of them fail
    rng, rows = random.Random(6), []
    base = [f"w{i}" for i in range(900)]
    for doc in range(60):
        line = list(base)
        for i in rng.sample(range(900), rng.choice([60, 90, 100, 110, 130])):
            line[i] = f"d{doc}x{i}"
        rows.append((doc, " ".join(line)))
    check(spark, rows)


def test_a_large_group_and_a_common_line(spark):
    rng, base = random.Random(7), [f"word{i}" for i in range(50)]
    rows = []
    for doc in range(400):
        line = list(base)
        for i in rng.sample(range(50), rng.randint(0, 2)):
            line[i] = f"edit{rng.randint(0, 30)}"
        rows.append((doc, "the common line\n" + " ".join(line) + "\n\nown" + str(doc)))
    check(spark, rows)


def test_prefix_sizes_are_never_short():
    import numpy as np
    for t in (0.5, 0.8, 0.9, 1.0):
        for n in range(1, 2000):
            p = int(line_dedup.prefix_size(np.array(n), t))
            # two sets without a common word among these can share n - p at most
            assert n - p < t * n or n - p < np.ceil(t * n)
            assert 1 <= p <= n


def test_shared_words_of_one_letter(spark):
    got = line_dedup.dedup_lines(simple(spark, ["a b c d\ne", "a b c d e", "d c b a", "e e e"]))
    assert sorted(map(tuple, got.select("doc_id", "text").collect())) == [
        (0, "a b c d\ne"), (1, ""), (2, ""), (3, "")]


def test_template_lines_are_screened_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 64)
    rng, rows = random.Random(12), []
    for doc in range(500):
        line = [f"t{i}" for i in range(20 + doc % 3)]
        for i in rng.sample(range(20), 3):
            line[i] = f"own{doc}x{i}" if doc % 4 else f"own{rng.randint(0, 40)}"
        rows.append((doc, " ".join(line) + "\nrest of " + str(doc)))
    texts = documents(spark, [(d, x, "en", "s", 0) for d, x in rows]).select("doc_id", "text")
    rarity = np.arange(line_dedup.CELLS, dtype=np.uint64)
    lists = line_dedup._lists(texts, rarity, 0.8)
    crowded = line_dedup.crowded_words(texts, rarity, 0.8, 1000).cache()
    assert max(r["count"] for r in lists.groupBy("word").count().collect()) > 128
    cut = line_dedup._in_blocks(lists, crowded)
    assert max(r["count"] for r in cut.groupBy("word").count().collect()) <= 128
    check(spark, rows)


def test_screening_holds_few_pairs():
    n, rng = 5000, np.random.default_rng(2)
    columns = [np.full(n, 7), np.arange(n), np.zeros(n), np.full(n, 20), np.zeros(n),
               rng.integers(0, 4, n), np.zeros(n)]
    kind = line_dedup.arrow_schema(line_dedup._POSTING)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64), pa.int64()).cast(f.type) for c, f in zip(columns, kind)],
        schema=kind)
    tracemalloc.start()
    [out] = line_dedup._candidates(iter([batch]), 0.8)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    near = {}
    for i, bits in enumerate(columns[5].tolist()):
        best = min(range(i), key=lambda j: (bin(bits ^ int(columns[5][j])).count("1"), j),
                   default=None) if i < 300 else near.get(i)
        near[i] = best
    first = {}
    for doc, other in zip(out.column(0).to_pylist(), out.column(2).to_pylist()):
        first.setdefault(doc, other)
    assert all(first.get(i) == near[i] for i in range(300))
    assert peak < 150, peak


def test_long_texts_are_cut_a_portion_at_a_time():
    # 256 texts of 40 kB each, of which every line is looked at
    texts = [prose(i, 6000, 300) for i in range(4)] * 64
    array, lines = pa.array(texts), []
    for start in range(4):
        own = line_dedup.Lines(pa.array([start]), array.slice(start, 1))
        lines.append([(n, s1) for n, s1 in zip(own.line.tolist(), own.digests()[0].tolist())])
    numbers = pd.Series([[n for n, _ in lines[i % 4]] for i in range(256)])
    digests = pd.Series([[s1 for _, s1 in lines[i % 4][:-1]] + [0] for i in range(256)])
    want = pd.Series([t.split("\n")[lines[i % 4][-1][0]] for i, t in enumerate(texts)])
    tracemalloc.start()
    out = list(line_dedup._without(iter([(pd.Series(texts), numbers, digests)])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert [t.strip() for t in out[0]] == [t.strip() for t in want]
    assert peak < 120, peak


def test_lists_travel_in_few_rows_and_come_back_whole():
    texts = [prose(i, 400, 300) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["d", "t"])
    rarity = np.arange(line_dedup.CELLS, dtype=np.uint64)
    entries = list(line_dedup._entries(iter([batch]), rarity, 0.8))
    want = {}
    for e in entries:
        for word, *rest in zip(*[c.tolist() for c in line_dedup._unfolded(e)]):
            want.setdefault(word, []).append(tuple(rest))
    # dealt by two tasks, met in one
    none = np.zeros(0, dtype=np.int32)
    parcels = [p for part in (entries[:1], entries[1:])
               for p in line_dedup._parcels(line_dedup._of_others(iter(part), none), 4)]
    assert sum(p.num_rows for p in parcels) <= 8 < sum(map(len, want.values())) / 20
    whole = pa.Table.from_batches(parcels).sort_by("parcel").to_batches()
    got, order = {}, []
    for out in line_dedup._unpacked(iter(whole)):
        for word, *rest in zip(*[c.to_pylist() for c in out.columns]):
            got.setdefault(word, []).append(tuple(rest))
            order.append((word, rest[2]))
    assert order == sorted(order)
    assert {w: sorted(x) for w, x in got.items()} == {
        w: sorted(x) for w, x in want.items() if len(x) > 1}


def test_copies_of_a_common_line_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUSY", 50)
    rows = [(1, 1, d, 0) for d in range(1, 900)] + [(1, 1, 0, 7), (1, 1, 0, 3), (9, 9, 5, 5)]
    rows += [(2, s2, d, n) for s2 in (1, 2) for d, n in [(8, 4), (6, 5), (6, 2), (7, 0)]]
    again = spark.createDataFrame(rows, "s1 long, s2 long, doc long, line long").repartition(8)
    several = spark.createDataFrame([(1, 1, 901, 0), (2, 1, 4, 6), (2, 2, 4, 6)],
                                    "s1 long, s2 long, n long, first long")
    got = line_dedup._copies(again, several).select(
        "*", spark_partition_id().alias("part")).collect()
    want = [(d, 0, 1) for d in range(1, 900)] + [(0, 7, 1)]
    want += [(8, 4, 2), (6, 5, 2), (7, 0, 2)] * 2
    assert same_rows([(r.doc, r.line, r.s1) for r in got], want)
    assert max(Counter(r.part for r in got).values()) < 300


def test_digests_are_looked_at_only_where_ids_are_shared(spark):
    [out] = line_dedup._without(iter([(pd.Series(["a b\nc\r\n\nd", "a b\nc", None]),
                                       pd.Series([[0, 2], None, [1]]), pd.Series([None] * 3))]))
    assert list(out) == ["c\r\nd", "a b\nc", None]
    check(spark, [(1, "a b c\nx"), (2, "a b c\ny"), (2, "z\na b c"), (2, "a b c\ny"), (3, "z\ny")])


def workers_of_a_task(df):
    """the most Python steps that one task of ``df`` runs at once"""
    most, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        while above and above[-1][0] >= depth:
            above.pop()
        n = above[-1][1] if above else 0
        n = 0 if "Exchange" in line.split("[")[0] else n + (
            "MapInArrow" in line or "ArrowEvalPython" in line)
        above.append((depth, n))
        most = max(most, n)
    return most


def test_no_task_needs_two_workers(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 16)
    in_batches, found, kept = line_dedup.in_batches, [], []

    def watched(df, work, schema):
        found.append(workers_of_a_task(in_batches(df, work, schema)))
        return in_batches(df, work, schema)

    def named(df, name, keep=line_dedup.keep):
        kept.append(name)
        return keep(df, name)

    monkeypatch.setattr(line_dedup, "in_batches", watched)
    monkeypatch.setattr(line_dedup, "keep", named)
    rng, rows = random.Random(6), []
    for doc in range(40):
        line = [f"w{i}" for i in range(900)]
        for i in rng.sample(range(900), rng.choice([60, 90, 100, 110, 130])):
            line[i] = f"d{doc}x{i}"
        rows.append((doc, " ".join(line)))
    texts = documents(spark, [(d, x, "en", "s", 0) for d, x in rows]).select("doc_id", "text")
    out = line_dedup.dedup_lines(texts)
    assert same_rows([tuple(r) for r in out.collect()], brute(rows))
    assert {"crowded", "pairs"} <= set(kept)  # all steps were taken
    assert max(found) == workers_of_a_task(out) == 1, found
