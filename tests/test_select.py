import pytest

from colloquary.operators import select
from colloquary.plans.worth_reading import worth_reading
from tests.helpers import messages, rows


def test_stats(spark):
    df = messages(spark, (1, 0, "a", "hello"), (1, 1, "a", None), (1, 2, "b", "x"), (2, 0, None, None))
    assert rows(select.discussion_stats(df)) == [(1, 3, 2, 6), (2, 1, 0, 0)]


def test_score_is_capped(spark):
    stats = spark.createDataFrame([(1, 4), (2, 400)], "conv_id long, turns long")
    assert rows(select.value_score(stats, {"turns": (0.5, 8)}).select("conv_id", "score")) == [
        (1, 0.25), (2, 0.5)]


def test_top_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame(
        [(3, 1.0, "x"), (1, 1.0, "x"), (2, 2.0, "y"), (4, 1.0, "x")],
        "conv_id long, score double, lang string")
    assert [r[0] for r in select.top_discussions(df, 3).collect()] == [2, 1, 3]
    per = select.top_discussions(df, 2, "lang").select("lang", "conv_id", "rk")
    assert rows(per) == [("x", 1, 1), ("x", 3, 2), ("y", 2, 1)]


def test_term_filter(spark):
    df = messages(spark, (1, 0, "a", "Kernel panic, kernel!"), (1, 1, "b", "Mutex"),
                  (2, 0, "a", "kernel kernel"), (3, 0, "a", "nothing"), (4, 0, "a", None))
    terms = spark.createDataFrame(
        [("kernel",), ("MUTEX",), ("mutex!",), ("heap",), (None,), ("++",)], "term string")
    assert rows(select.term_filter(df, terms, 2)) == [(1, 2)]
    assert rows(select.term_filter(df, terms, 1)) == [(1, 2), (2, 1)]


def test_terms_that_would_never_be_found(spark):
    df = messages(spark, (1, 0, "a", "C++ and node.js"))
    terms = spark.createDataFrame([("c++",)], "term string")
    assert rows(select.term_filter(df, terms, 1)) == [(1, 1)]
    with pytest.raises(Exception, match="not one word: node.js"):
        select.term_filter(df, spark.createDataFrame([("node.js",)], "term string"), 1).collect()


def test_dedupe(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "A")], "id long, t string")
    assert rows(select.dedupe_exact(df, "id", "t")) == [(1, 2), (2, 1), (4, 1)]


def test_worth_reading(spark):
    df = messages(spark, (1, 0, "a", "short"), (2, 0, "a", "long " * 50), (2, 1, "b", "reply"),
                  (3, 0, "a", "long " * 50), (3, 1, "b", "reply"))
    weights = {"turns": (0.5, 2), "chars": (0.5, 100)}
    out = worth_reading(df, weights, 1)
    assert [(r.conv_id, r.score) for r in out.collect()] == [(2, 1.0)]
    assert out.collect()[0].body == "a: " + "long " * 50 + "\nb: reply"


def test_empty_input(spark):
    empty = messages(spark, (1, 0, "a", "b")).limit(0)
    assert select.discussion_stats(empty).count() == 0
    assert select.dedupe_exact(empty, "seq", "text").count() == 0
    assert worth_reading(empty, {"turns": (1, 1)}, 5).count() == 0
