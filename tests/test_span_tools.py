"""Validity and overlap, counted differences, daily sketches, exports of any shape."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquary.operators import compare, intervals, sketches
from colloquary.plans.skew import HotSplit
from colloquary.sources import any_export
from tests.helpers import at, captures, rows

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("split", [HotSplit(), HotSplit(share=1000, min_rows=1)])
def test_validity(spark, split):
    df = captures(spark, (1, 1, "2024-01-01", "a"), (1, 2, "2024-01-02", "a"),
                  (1, 3, "2024-01-03", "b"), (1, 4, "2024-01-03", "a"), (2, 5, "2024-01-01", "x"),
                  (2, 6, None, "y"))
    found = intervals.validity(df, ["state"], split=split)
    assert rows(found.select("key", "capture_id", "valid_from", "valid_to")) == [
        (1, 1, at("2024-01-01"), at("2024-01-03")), (1, 3, at("2024-01-03"), at("2024-01-03")),
        (1, 4, at("2024-01-03"), None), (2, 5, at("2024-01-01"), None)]


def spans(seed, n, far):
    """Lengths from a microsecond to centuries, ends missing or before the start now and then."""
    rng = random.Random(seed)
    for i in range(n):
        start = START + dt.timedelta(minutes=rng.randrange(far))
        length = dt.timedelta(microseconds=rng.choice([1, 10**6, 3600 * 10**6, 10**11, 10**13,
                                                       10**15]) * rng.randint(-1, 3))
        yield (i % 3, i, rng.choice([start] * 9 + [None]), rng.choice([start + length] * 9 + [None]))


@pytest.mark.parametrize("on", [["room"], []])
def test_overlapping_is_what_comparing_all_gives(spark, on):
    a, b = list(spans(1, 120, 10**5)), list(spans(2, 90, 10**5))
    held = spark.createDataFrame(a, "room int, a int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    asked = spark.createDataFrame(b, "room int, b int, span_from timestamp_ntz, span_to timestamp_ntz")
    if not on:
        asked = asked.drop("room")
    found = intervals.overlapping(held, asked, on)
    never = dt.datetime(9999, 12, 31)
    want = [(x[1], y[1]) for x in a for y in b if (x[0] == y[0] or not on)
            and x[2] and y[2] and max(x[2], y[2]) < min(x[3] or never, y[3] or never)]
    assert sorted(map(tuple, found.select("a", "b").collect())) == sorted(want)
    assert len(want) > 500


def test_long_rows_have_few_copies(spark):
    df = spark.createDataFrame([(START, START + dt.timedelta(days=365 * 200)),
                                (START, START + dt.timedelta(seconds=1)), (START, None)],
                               "valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert intervals._binned(df, "valid_from", "valid_to", "a").count() <= 3 * 2 * intervals.LEVELS


def test_counted_difference(spark):
    schema = "a int, b string, c double"
    x = [(1, "x", 1.0)] * 5 + [(2, None, None)] * 2 + [(3, "only here", 0.5)]
    y = [(1, "x", 1.0)] * 2 + [(2, None, None)] * 4 + [(4, "only there", None)]
    a, b = spark.createDataFrame(x, schema), spark.createDataFrame(y, schema)
    content = ["a", "b", "c"]
    assert rows(compare.counted_difference(a, b, content)) == sorted(
        [(1, "x", 1.0, 5, 2), (2, None, None, 2, 4), (3, "only here", 0.5, 1, 0),
         (4, "only there", None, 0, 1)], key=repr)
    assert rows(compare.except_all(a, b, content)) == rows(a.exceptAll(b))
    assert rows(compare.intersect_all(a, b, content)) == rows(a.intersectAll(b))
    assert rows(compare.except_all(a.limit(0), b, content)) == []


def test_sketches_of_any_span(spark):
    rng = random.Random(7)
    said = [(rng.choice("ab"), START + dt.timedelta(hours=rng.randrange(240)), rng.randrange(3000))
            for _ in range(20_000)] + [("a", None, 1), ("b", START, None)]
    df = spark.createDataFrame(said, "room string, ts timestamp_ntz, who int")
    kept = sketches.daily_sketches(df, ["room"], "ts", "who").persist()
    for first, last in ((None, None), ("2024-01-03", "2024-01-05"), ("2024-01-09", None)):
        low = at(first) if first else dt.datetime.min
        high = at(last) + dt.timedelta(days=1) if last else dt.datetime.max
        inside = [(r, w) for r, t, w in said
                  if (t is None and first is None and last is None) or (t and low <= t < high)]
        n = Counter(r for r, _ in inside)
        for room, count, people in sketches.merge_sketches(kept, ["room"], first, last).collect():
            exact = len({w for r, w in inside if r == room and w is not None})
            assert count == n[room]
            assert abs(people - exact) <= 0.06 * exact  # some four standard errors
    both = sketches.merge_sketches(kept.unionByName(kept), ["room"])
    once = sketches.merge_sketches(kept, ["room"])
    assert rows(both.select("room", "people")) == rows(once.select("room", "people"))


def test_exports_of_any_shape(spark):
    texts = ['{"k": 1, "who": {"name": "ann"}}', '{"k": "one", "more": [1, 2]}', '[1, 2]', '7',
             '{"k": 1}],"__end":true} rubbish', '{"k": 1} {"k": 2}', "{", " ", "", None, '{"k": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    good, rejects = any_export.parse_any_export(
        df, "raw", {"k": ("$.k", "int"), "name": ("$.who.name", "string"),
                    "second": ("$.more[1]", "int")})
    assert rows(good.drop("raw")) == [
        (0, 1, "ann", None), (1, None, None, 2), (10, None, None, None), (2, None, None, None),
        (3, None, None, None)]
    assert Counter(r.reason for r in rejects.collect()) == {"malformed": 3, "blank": 2, "null": 1}
    shapes = any_export.export_shape(df.where("i < 2"), "raw").collect()
    assert shapes[0].n == 2 and "who" in shapes[0]["shape"]
    by = any_export.export_shape(df.withColumn("g", F.col("i") % 2), "raw", ["g"])
    assert sum(r.n for r in by.collect()) == 5
