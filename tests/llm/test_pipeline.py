"""The pipeline's stages hand on documents, and each does its work."""

import collections

import corpus_pipeline
from colloquary.llm import mixing, quality_classifier
from tests.llm.helpers import documents, odd_rows, prose, words
from tests.llm.test_lines import brute
from tests.llm.test_simhash import groups, plain_fingerprint


def rows_of():
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 20_000]
    for i in range(80):
        text = prose(i % 60, 150 + i % 60, 3000)
        if i % 9 == 8:
            text = text.upper().replace(" ", "!! ")
        rows.append((1000 + i, text, "en", f"s{i % 4}", len(text)))
    return rows


def test_stage_by_stage(spark):
    docs = documents(spark, rows_of(), clashing=True)
    names = docs.columns
    for (name, stage) in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == names and out.dtypes == docs.dtypes
        got = spark.createDataFrame(out.collect(), out.schema)
        after = got.collect()
        if name == "quality classifier":
            scorer = quality_classifier.Scorer(*quality_classifier.train(docs))
            want = [(d, t) for d, t, _ in before if scorer(t) >= quality_classifier.THRESHOLD]
            assert 60 < len(want) < len(before)
        elif name == "line dedup":
            want = [(d, t) for d, t in brute([b[:2] for b in before]) if words(t)]
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "SimHash near-dedup":
            of = groups([(d, plain_fingerprint(t)) for d, t, _ in before if d is not None])
            seen, want = set(), []
            for d, t, _ in before:
                if d is None or of[d] == d and d not in seen:
                    want.append((d, t))
                seen.add(d)
        elif name == "mixing":
            taken = collections.Counter()
            for r in mixing.mix(docs).collect():
                taken[r.doc_id] += r.taken
            mine = collections.Counter()
            for r in after:
                mine[r.doc_id] += len(words(r.text))
            assert +taken == +mine
            want = [(r.doc_id, r.text) for r in after]
        else:
            assert sum(r.length for r in after) == sum(
                r.doc_tokens for r in after if r.start == 0)
            continue
        assert sorted((repr((r.doc_id, r.text)) for r in after)) == sorted(map(repr, want)), name
        docs = got


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
