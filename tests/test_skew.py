"""One key with a third of all rows: same results, no oversized piece."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from colloquary.operators import archive, distill
from colloquary.plans.skew import HOT, PIECE, HotSplit, cut_hot_keys
from tests.helpers import rows

SPLIT = HotSplit(share=60, min_rows=200)
TOTAL = 24_000


@pytest.fixture(scope="module", params=["steady", "burst", "one moment"])
def logs(request, spark):
    """A third of the rows in room 0; all but a few of those in one hour, or at one time."""
    room = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1)
    year = F.pmod(F.xxhash64("id"), F.lit(365 * 86400))
    hour = 200 * 86400 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3600))
    crowd = {"steady": year, "burst": hour, "one moment": F.lit(200 * 86400)}[request.param]
    second = F.when((F.col("id") % 3 == 0) & (F.col("id") % 100 != 0), crowd).otherwise(year)
    df = spark.range(TOTAL).select(
        room.alias("key"), F.col("id").alias("capture_id"),
        F.timestamp_seconds(second).cast("timestamp_ntz").alias("captured_at"),
        (F.xxhash64("id", F.lit(2)) % 3).alias("state"))
    return df.cache()


def test_pieces_are_even_ordered_and_the_same_in_every_plan(logs):
    cut = cut_hot_keys(logs, ["key"], ["captured_at", "capture_id"], SPLIT)
    assert [r.key for r in cut.where(HOT).select("key").distinct().collect()] == [0]
    sizes = cut.where("key = 0").groupBy(PIECE).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("captured_at", "capture_id")).alias("a"),
        F.max(F.struct("captured_at", "capture_id")).alias("b")).orderBy(PIECE).collect()
    assert len(sizes) > 12
    assert max(r.n for r in sizes) <= 3 * TOTAL / SPLIT.share
    assert all(x.b < y.a for x, y in zip(sizes, sizes[1:]))
    assert cut.where(f"key <> 0 AND {PIECE} <> 0").count() == 0
    again = cut_hot_keys(logs.repartition(7), ["key"], ["captured_at", "capture_id"], SPLIT)
    assert rows(again.select("capture_id", PIECE)) == rows(cut.select("capture_id", PIECE))


def test_versions_equal_a_plain_window(logs):
    before = F.lag("state").over(Window.partitionBy("key").orderBy("captured_at", "capture_id"))
    want = logs.withColumn("b", before).where("b IS NULL OR b <> state").drop("b")
    assert rows(archive.versions(logs, ["state"], split=SPLIT)) == rows(want)


@pytest.mark.parametrize("gap", ["5 seconds", "30 minutes", "3 days"])
def test_sessions_equal_a_plain_window(logs, gap):
    w = Window.partitionBy("key").orderBy("captured_at", "capture_id")
    fresh = F.lag("captured_at").over(w) + F.expr(f"interval {gap}") < F.col("captured_at")
    want = logs.withColumn("fresh", F.coalesce(fresh.cast("bigint"), F.lit(0))).withColumn(
        "session_no", F.sum("fresh").over(w)).drop("fresh")
    out = distill.sessionize(logs, "key", "captured_at", gap, ["capture_id"], SPLIT)
    assert rows(out) == rows(want)


def test_pairs_equal_a_plain_window(logs):
    talk = logs.select(
        F.col("key").alias("conv_id"), F.col("capture_id").alias("seq"),
        F.when(F.col("state") == 0, "user").otherwise("bot").alias("author"))
    w = Window.partitionBy("conv_id").orderBy("seq")
    want = (talk.withColumn("s", F.lead("seq").over(w)).withColumn("a", F.lead("author").over(w))
            .where("author = 'user' AND a = 'bot'").select("conv_id", "seq", "s"))
    assert rows(distill.pair_replies(talk, "user", "bot", SPLIT)) == rows(want)


@pytest.mark.parametrize("name", sorted(
    {n[2:] for n in vars(entry) if n.startswith("q_")}
    - {"stream_intake", "stream_activity", "stream_sessions", "stream_sessions_busy_rooms",
       "stream_replies"}))
def test_no_query_pairs_everything_or_leaves_the_jvm(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    for word in ("CartesianProduct", "NestedLoopJoin", "Python", "InPandas", "Cross"):
        assert word not in plan


def _plan(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark):
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts" in _plan(spark, "as_of")
    assert "ReadSchema: struct<conv_id:bigint,role:string,text:string>" in _plan(
        spark, "discussion_stats")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string>" in _plan(
        spark, "pair_replies")


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "partial_max_by" in _plan(spark, "as_of")
    for name in ("key_terms", "extract_summary", "top_discussions_per_group"):
        assert "Partial" in _plan(spark, name).split("WindowGroupLimit", 1)[1]
    assert "TakeOrderedAndProject" in _plan(spark, "top_discussions")


def _final_plan(df):
    """Lines of the plan as it ran, without the initial plans shown beside it."""
    kept, beside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if beside is not None and depth > beside:
            continue
        beside = depth - 3 if "== Initial Plan ==" in line else None
        if beside is None:
            kept.append(line)
    return kept


@pytest.mark.parametrize("name", ["key_terms_busy_words", "extract_summary_busy_words"])
def test_words_are_cut_and_counted_once(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = _final_plan(df)
    assert any("Final Plan" in line for line in plan)
    assert sum("Generate explode" in line for line in plan) == 1
    assert sum("ReusedExchange" in line for line in plan) >= 3


def test_captures_are_shuffled_once_per_side(spark):
    plan = "\n".join(_final_plan(entry.queries()["append_captures"](spark, "/root/testdata/sf0.001")))
    assert plan.count("Exchange hashpartitioning") == 2


def test_planning_does_not_grow_with_the_number_of_pieces(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    start = time.time()
    out = distill.sessionize(events, "user_id", "ts", "6 hours", ["event_id"],
                             HotSplit(share=10_000_000, min_rows=1))
    assert out.count() == 1000
    assert time.time() - start < 60
