"""Quality rules, the quality classifier and toxicity."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from colloquary.llm import quality_classifier, quality_rules, toxicity
from tests.llm.helpers import BLANKS, ODD_TEXTS, documents, odd_rows, prose, simple, words


def plain_counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    repeat = sum(any(seen[windows[k]] > 1 for k in range(max(0, i - 4), min(i + 1, len(windows))))
                 for i in range(len(w)))
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in earlier
            earlier.add(line)
    failed = len(w) < 10 or 100 * repeat > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeat, failed)


def test_base_counts(spark):
    rng, rows = random.Random(1), odd_rows()
    for i in range(40):
        some = [rng.choice("abcdefgh") for _ in range(rng.choice([4, 5, 6, 9, 30, 200]))]
        rows.append((500 + i, rng.choice([" ", "\n", "\t "]).join(some) + "#" * (i % 3), "", "", 0))
    rows.append((600, " ".join(f"u{i}" for i in range(9000)) + " " + " ".join(
        f"u{i}" for i in range(5)), "", "", 0))
    got = quality_rules.judge_texts(documents(spark, rows, clashing=True)).collect()
    want = [(d, *plain_counts(t)) for d, t, *_ in rows]
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge_texts(documents(spark, [])).count() == 0


def test_bands(spark):
    rng = random.Random(3)
    clean = [prose(s, 30 * (s + 1), 2000) for s in range(30)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/ABCDEFGHIJKLMNOPQRSTUVWXYZ")
                     if rng.random() < 0.95 else " " for _ in range(4000)) for _ in range(5)]
    template = [" ".join(f"item {rng.randint(0, 99)} is {rng.randint(0, 99)} of sort a."
                         for _ in range(200)) for _ in range(5)]
    # good at the ends, nothing but noise between
    hidden = [clean[10] + " " + n + n[::-1] + n[1::2] + n[::2] for n in noise]
    got = {r.doc_id: r for r in quality_rules.judge_texts(
        simple(spark, clean + noise + template + hidden)).collect()}
    assert all(got[i].kept for i in range(30))
    assert not any(got[i].kept for i in range(30, 45) if not got[i].base_failed)
    for i, text in enumerate(clean):
        raw = text.encode()
        assert got[i].ratio == len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))


def _corpus(n=600):
    rng, rows = random.Random(4), []
    for i in range(n):
        text, kind = prose(i, rng.randint(30, 300), 800), i // 2 % 10
        good = kind < 7
        if kind == 7:
            text = text.upper().replace(" ", "!! ")
        elif kind == 8:
            text = (text.split()[0] + " ") * 80
        elif kind == 9:
            text = text.replace(" ", "$$$ ").replace(",", "***")
        rows.append((i, text, "en", "s", good))
    return rows


def test_labellers_are_estimated():
    rng = np.random.default_rng(1)
    n, m = 20_000, len(quality_classifier.LABELLERS)
    truth = rng.random(n) < 0.8
    right = np.array([rng.uniform(0.2, 0.4, m), np.full(m, 0.9993)])
    says = rng.random((n, m)) < 0.8
    correct = rng.random((n, m)) < right[truth.astype(int)]
    votes = np.where(says, np.where(correct == truth[:, None], 1, -1), 0)
    patterns = {}
    for v in votes:
        p = quality_classifier.pattern_of(v.tolist())
        assert quality_classifier.votes_of(p) == v.tolist()
        patterns[p] = patterns.get(p, 0) + 1
    good, found, share = quality_classifier.fit_labellers(patterns)
    assert abs(found - right).max() < 0.05 and abs(share - 0.8) < 0.02
    told = [good.get(quality_classifier.pattern_of(v.tolist()), 0.5) > 0.5 for v in votes]
    assert np.mean(np.array(told) == truth) > 0.95


def _drawn(seed, right, share=0.7, n=20_000):
    rng, m = np.random.default_rng(seed), len(quality_classifier.LABELLERS)
    truth = rng.random(n) < share
    correct = rng.random((n, m)) < right[truth.astype(int)]
    votes = np.where(rng.random((n, m)) < 0.8, np.where(correct == truth[:, None], 1, -1), 0)
    return Counter(quality_classifier.pattern_of(v.tolist()) for v in votes)


def test_accuracies_between_chance_and_certainty_are_found():
    m = len(quality_classifier.LABELLERS)
    right = np.random.default_rng(5).uniform(0.55, 0.95, (2, m))
    right[:, 3] = 0.5  # one that knows nothing
    _, found, share = quality_classifier.fit_labellers(_drawn(6, right))
    assert abs(found - right).max() < 0.05 and abs(share - 0.7) < 0.02


def test_a_noisy_labeller_does_not_condemn_clean_texts():
    m = len(quality_classifier.LABELLERS)

    def of(*bad):
        return quality_classifier.pattern_of([-1 if j in bad else 1 for j in range(m)])

    good, found, share = quality_classifier.fit_labellers({of(): 780, of(3): 195, of(0, 1): 25})
    assert good[of()] > 0.99 and good[of(3)] > 0.99 and good[of(0, 1)] < 0.01
    assert abs(found[1][3] - 0.8) < 0.02 and abs(share - 0.975) < 0.01


def test_each_kind_of_fault_is_a_kind_of_bad_text():
    m = len(quality_classifier.LABELLERS)
    rng, patterns, truth = np.random.default_rng(7), Counter(), Counter()
    for _ in range(20_000):
        # two faults, four labellers see each: fewer than three leave the rates undetermined
        kind = rng.choice(3, p=[0.85, 0.1, 0.05])
        sees = [0.02 if kind == 0 or not 4 * kind > j >= 4 * kind - 4 else 0.7 for j in range(m)]
        p = quality_classifier.pattern_of(np.where(rng.random(m) < sees, -1, 1).tolist())
        patterns[p] += 1
        truth[p] += kind == 0
    good, found, share = quality_classifier.fit_labellers(patterns)
    assert abs(share - 0.85) < 0.01 and abs(found[1] - 0.98).max() < 0.01
    hit = sum(truth[p] if good[p] > 0.5 else patterns[p] - truth[p] for p in patterns)
    assert hit > 0.98 * 20_000


def test_estimate_equals_a_plain_one():
    m = len(quality_classifier.LABELLERS)
    patterns = _drawn(8, np.random.default_rng(9).uniform(0.6, 0.9, (2, m)), n=400)
    keys = sorted(p for p in patterns if any(quality_classifier.votes_of(p)))
    good = {p: 0.8 if sum(quality_classifier.votes_of(p)) >= 0 else 0.3 for p in keys}
    table = np.array([quality_classifier.votes_of(p) for p in keys])
    start = np.array([[good[p], 1 - good[p]] for p in keys])
    _, got, vote, share = quality_classifier._climb(
        table, np.array([patterns[p] for p in keys], dtype=float), start, 12)
    for _ in range(12):  # one text, one labeller after another
        part = [1.0, 1.0]
        says = [[[prior, 2 - prior] for _ in range(m)] for prior in (1.8, 1.0)]
        for p in keys:
            for kind, belongs in enumerate((good[p], 1 - good[p])):
                part[kind] += patterns[p] * belongs
                for j, v in enumerate(quality_classifier.votes_of(p)):
                    if v:
                        says[kind][j][v < 0] += patterns[p] * belongs
        for p in keys:
            both = []
            for kind in (0, 1):
                chance = part[kind] / sum(part)
                for j, v in enumerate(quality_classifier.votes_of(p)):
                    if v:
                        chance *= says[kind][j][v < 0] / sum(says[kind][j])
                both.append(chance)
            good[p] = both[0] / sum(both)
    assert np.allclose(got[:, 0], [good[p] for p in keys], atol=1e-9)
    assert np.allclose(vote[0], [a / (a + b) for a, b in says[0]]) and np.isclose(
        share[0], part[0] / sum(part))


def test_an_id_with_many_rows_does_not_swell_the_sample(spark, monkeypatch):
    sizes = []
    fit = quality_classifier.in_batches

    def counted(df, work, schema):
        if schema.startswith("weights"):
            sizes.append(df.count())
        return fit(df, work, schema)

    monkeypatch.setattr(quality_classifier, "in_batches", counted)
    same = prose(0, 20, 300)
    ids = spark.range(5000).withColumn("text", F.lit(same))
    for of, texts in ((["id"], False), (["id", "text"], True)):  # ids that are sure to be drawn
        busy = ids.orderBy(F.pmod(F.xxhash64(*of), F.lit(1 << 32))).first().id
        rows = [(busy if i % 3 == 0 else 10_000 + i, same if texts and i % 3 == 0
                 else prose(i, 20, 300), "en", "s", 0) for i in range(3000)]
        quality_classifier.train(documents(spark, rows), 200)
    assert max(sizes) < 400


def test_clean_texts_of_other_scripts_draw_no_bad_vote():
    rng = random.Random(8)
    for first, size, end in ((0x430, 32, "."), (0x905, 50, "\u0964"), (0x561, 38, "\u0589"),
                             (0x621, 26, "\u06d4"), (0x4e00, 3000, "\u3002"), (0xe01, 46, "")):
        known = ["".join(chr(first + rng.randrange(size)) for _ in range(rng.randint(5, 11)))
                 for _ in range(500)]
        text = " ".join(rng.choice(known) + end * (i % 9 == 8) for i in range(200))
        assert min(quality_classifier.votes(text)) >= 0
        if end:
            assert min(quality_classifier.votes(text.replace(" ", ""))) >= 0


def test_all_of_a_long_text_is_looked_at():
    calm = prose(11, 20_000, 3000)
    assert len(calm) > 100_000
    for a in ("", "\u00e9 "):
        loud = quality_classifier.votes(a + calm + "\n" + calm.upper() * 2)
        assert loud[0] == -1 and quality_classifier.votes(a + calm)[0] == 1
        told = quality_classifier.facts(a + calm.title())
        assert told["upper"] == (sum(map(str.isupper, a + calm.title()))
                                 / sum(map(str.isalpha, a + calm.title())))
    ones = [quality_classifier.cells_of(b"a1" * 20 + end)[1] for end in (b"", b"-", b"A")]
    assert len(set(ones)) == 3


def test_classifier_on_texts_it_has_not_seen(spark):
    rows = _corpus()
    df = documents(spark, [(d, t, a, b, 0) for d, t, a, b, _ in rows], clashing=True)
    model = quality_classifier.train(df.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(df, model).collect()}
    kept = {good: [got[d] >= quality_classifier.THRESHOLD for d, *_, g in rows
                   if d % 2 and g == good] for good in (True, False)}
    assert all(kept[True]) and np.mean(kept[False]) < 0.1
    kept = quality_classifier.keep_good(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {
        d for d, s in got.items() if s >= quality_classifier.THRESHOLD}
    again = quality_classifier.train(df.where("doc_id % 2 = 0").repartition(7))
    assert (again[0] == model[0]).all() and again[1] == model[1]


def test_classifier_on_odd_and_empty_tables(spark):
    for rows in ([], [(1, None, None, None, None)], odd_rows()):
        df = documents(spark, rows)
        model = quality_classifier.train(df)
        got = quality_classifier.score_quality(df, model).collect()
        assert len(got) == len(rows)
        for r in quality_classifier.keep_good(df, model).collect():
            assert words(r.text)
    assert quality_classifier.Scorer(*model)(" \n") == 0.0


def plain_segments(values):
    """Ruzzo and Tompa's definition, by recursion over the best segment"""
    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += values[b]
                if total > 0 and (top is None or total > top[2] + 1e-12):
                    top = (a, b + 1, total)
        return top

    def walk(lo, hi):
        top = best(lo, hi)
        return [] if top is None else walk(lo, top[0]) + [top] + walk(top[1], hi)
    return walk(0, len(values))


def test_segments_of_a_scan():
    rng = random.Random(5)
    for _ in range(400):
        values = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 97
                  for _ in range(rng.randint(0, 40))]
        got, want = toxicity.maximal_segments(values), plain_segments(values)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert len(toxicity.maximal_segments([1.0, -2.0] * 100_000)) == 100_000


def test_decay_solves_its_equation():
    values, share = np.array([-1.0, 0.5, 3.0]), np.array([0.9, 0.07, 0.03])
    x = toxicity.decay_of(values, share)
    assert x > 0 and (share * np.exp(x * values)).sum() == pytest.approx(1.0, abs=1e-6)


def _toxic_corpus(n=1500):
    rng, rows = random.Random(6), []
    known = prose(0, 4000, 3000).split()
    bad = ["scumbag", "worthless", "pathetic"] + [f"vile{chr(97 + i)}" for i in range(20)]
    for i in range(n):
        w, label = rng.choices(known, k=rng.randint(20, 400)), int(i % 7 == 0)
        if label:
            for _ in range(rng.randint(3, 8)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), label))
    return rows


def test_toxicity_on_texts_it_has_not_seen(spark):
    rows = _toxic_corpus()
    df = documents(spark, [(d, t, "en", "s", 0) for d, t, _ in rows], clashing=True)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d % 4], "doc_id long, label int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    held = [(got[d].score, y) for d, _, y in rows if d % 4 == 0]
    hits = sum(s >= 0.3 and y for s, y in held)
    assert hits >= 0.9 * sum(y for _, y in held)
    assert sum(s >= 0.3 and not y for s, y in held) <= 0.1 * hits
    assert all(0 <= r.score <= 1 for r in got.values())
    text = "Nothing to see here. " * 5 + "You scumbag, worthless vilea pathetic one! " + "Fine. " * 9
    spans = toxicity.passages(model, text)
    assert spans and text[spans[0][0]:spans[0][1]].startswith("scumbag")


def test_toxicity_equals_a_plain_fit(spark):
    rows = _toxic_corpus(300)
    rows += [(0, *rows[0][1:])] * 150  # one id with a third of all rows
    df = documents(spark, [(d, t, "en", "s", 0) for d, t, *_ in rows])
    labels = spark.createDataFrame(sorted({(r[0], int(r[-1])) for r in rows}),
                                   "doc_id int, label int")
    model = toxicity.train(df, labels)
    told = dict(sorted({(r[0], int(r[-1])) for r in rows}))
    clean = [toxicity.words_of(t) for d, t, *_ in rows if not told[d]]
    best = [max([0.0] + [s for *_, s in toxicity.maximal_segments(model.values(w))]) for w in clean]
    mean = sum(len(w) * np.exp(-model.decay * b) for w, b in zip(clean, best)) / len(clean)
    assert np.isclose(model.rate, 1 / mean, rtol=1e-5)
    x = np.array([toxicity.features(*toxicity.describe(model, t)[:2]) for _, t, *_ in rows])
    y = np.array([told[d] for d, *_ in rows], dtype=float)
    w = np.zeros(3)
    for _ in range(20_000):  # steepest descent, row by row
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.002 * (x.T @ (p - y) + [0.0, *w[1:]])
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    for (d, *_), score in zip(rows, 1 / (1 + np.exp(-x @ w))):
        assert abs(got[d] - score) < 0.02


def test_toxicity_without_labels_or_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, label int")
    odd = documents(spark, odd_rows(), clashing=True)
    one = spark.createDataFrame([(3, 1), (100, 1), (None, 0), (5, None)], "doc_id long, label int")
    for labels, want in ((empty, 0.0), (one, 1.0)):
        model = toxicity.train(odd, labels)
        got = toxicity.score_toxicity(odd, model).collect()
        assert len(got) == len(odd_rows()) and {r.score for r in got} == {want}
    both = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    model = toxicity.train(odd, both)
    got = toxicity.score_toxicity(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(documents(spark, []), model).count() == 0
    assert toxicity.train(documents(spark, []), both).constant == 0.0
