"""Mixing: targets against plain water-filling, rounding against its promises."""

import collections
import random

import pytest

from colloquary.llm import mixing
from tests.llm.helpers import documents, odd_rows, prose, words


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        given = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if given[s] > most * sizes[s]}
        if not over:
            return given | {s: most * sizes[s] for s in full}
        full |= over


def rows_of(n=900, seed=1):
    rng, rows = random.Random(seed), []
    names = ["a", "B", "é", "z", "日", "🙂", "aa", "", None]
    for i in range(n):
        source = names[min(int(rng.expovariate(0.5)), 8)] if i % 3 else "hot"
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), "en", source, 0))
    return rows


def check(spark, rows):
    out = mixing.mix(documents(spark, rows, clashing=True)).collect()
    sizes, held = collections.Counter(), collections.Counter()
    for d, t, _, s, _ in rows:
        sizes[s] += len(words(t))
        held[d, s, len(words(t))] += 1
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in out) == held
    if sum(sizes.values()):
        want = plain_targets(dict(sizes))
        for r in out:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    taken, partial = collections.Counter(), collections.Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        partial[r.source] += bool(r["size"] and r.taken % r["size"])
        if r["size"]:
            assert abs(r.taken / r["size"] - r.target / r.source_size) < 1
    for r in out:
        assert abs(taken[r.source] - r.target) <= 1 and partial[r.source] <= 1
    return out


def test_targets_and_sums(spark, monkeypatch):
    first = check(spark, rows_of())
    monkeypatch.setattr(mixing, "BLOCK", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    some = check(spark, rows_of())
    again = mixing.mix(documents(spark, rows_of()[::-1]).repartition(7)).collect()
    assert sorted(map(repr, some)) == sorted(map(repr, again))
    assert len(first) == len(some)


def test_large_and_many_small_sources(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), "en",
             "hot" if i % 3 == 0 else f"s{rng.randrange(400)}" if i % 50 else None, 0)
            for i in range(1500)]
    rows += [(7, "a b c", "en", "s1", 0)] * 60  # one id, more rows than a block
    monkeypatch.setattr(mixing, "BLOCK", 30)
    monkeypatch.setattr(mixing, "FAN", 4)
    groups = []
    frame = type(spark.range(1))
    group_by = frame.groupBy

    def counted(df, *by):
        if len(by) == 3 and not isinstance(by[0], str):  # that of the rounding
            groups.append((df.count(), df.select(*[c.alias(str(i)) for i, c in enumerate(by)])
                           .distinct().count()))
        return group_by(df, *by)

    monkeypatch.setattr(frame, "groupBy", counted)
    some = check(spark, rows)
    monkeypatch.undo()
    assert len({r.source for r in some}) > 300
    # a group holds some thirty rows, however many sources there are
    assert groups[0][1] < 3 * groups[0][0] / 30 and len(groups) > 1


def test_odd_rows(spark):
    check(spark, odd_rows())
    check(spark, [])
    check(spark, [(1, None, None, None, None), (2, "", None, "s", 0)])
    check(spark, [(1, "a b c", None, "s", 0)])
    check(spark, [(1, "a b c", None, "s", 0)] * 50 + [(2, "x", None, "t", 0)])


def test_nobody_is_favoured():
    total = collections.Counter()
    for seed in range(4000):
        out, held = mixing.pivot([1, 2, 3, 10], [0.2, 0.5, 0.7, 0.4], ["a", "b", "c", "d"], seed)
        assert sum(0 < f < 1 for f in out) <= 1
        assert sum(s * f for s, f in zip([1, 2, 3, 10], out)) == pytest.approx(7.3)
        total.update({i: f for i, f in enumerate(out)})
    for i, f in enumerate([0.2, 0.5, 0.7, 0.4]):
        assert total[i] / 4000 == pytest.approx(f, abs=0.03)


def test_taking(spark):
    rows = [(i, prose(i, 20 + i), "en", "ab"[i % 3 == 0], 0) for i in range(60)] + odd_rows()
    df = documents(spark, rows, clashing=True)
    mixed = mixing.mix(df)
    out = mixing.take(df, mixed)
    assert out.columns == df.columns
    got = collections.Counter()
    for r in out.collect():
        got[r.doc_id, r.source] += len(words(r.text))
    want = collections.Counter()
    for r in mixed.where("taken > 0").collect():
        want[r.doc_id, r.source] += r.taken
    assert got == want
    whole = {(d, t) for d, t, *_ in rows}
    assert sum((r.doc_id, r.text) not in whole for r in out.collect()) <= 6
