import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from colloquary.operators import archive
from colloquary.operators.respect import honour_removals
from colloquary.plans.capture_run import capture_run
from colloquary.plans.skew import HotSplit
from colloquary.schemas import CAPTURES
from colloquary.sources import archive_store
from tests.helpers import at, captures, rows

CONTENT = ["key", "captured_at", "state", "value"]


def test_append_is_idempotent_and_keeps_returning_states(spark):
    held = captures(spark, (1, 1, "2024-01-01", "A"), (1, 2, "2024-01-02", "B"))
    new = captures(spark, (1, 2, "2024-01-02", "B"), (1, 3, "2024-01-03", "A"),
                   (1, 3, "2024-01-03", "A"), (2, 4, "2024-01-03", None))
    once = archive.append_captures(held, new, ["capture_id"], CONTENT)
    assert [r[1] for r in rows(once)] == [1, 2, 3, 4]
    assert rows(archive.append_captures(once, new, ["capture_id"], CONTENT)) == rows(once)


def test_append_tells_content_apart(spark):
    held = captures(spark, (1, 1, "2024-01-01", "A", 1.0))
    new = captures(spark, (1, 1, "2024-01-01", "A", None), (1, 1, "2024-01-01", "A", 1.0))
    out = archive.append_captures(held, new, ["capture_id"], CONTENT)
    assert rows(out.select("value")) == [(1.0,), (None,)]


def test_append_null_identity_is_idempotent(spark):
    new = spark.createDataFrame([(None, "x"), (None, "x"), (None, "y")], "id long, s string")
    empty = new.limit(0)
    once = archive.append_captures(empty, new, ["id"], ["s"])
    assert rows(once) == [(None, "x"), (None, "y")]
    assert rows(archive.append_captures(once, new, ["id"], ["s"])) == rows(once)


def test_append_reads_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "archive")
    held = captures(spark, *[(1, i, f"2024-01-0{i}", "A") for i in range(1, 8)]).withColumn(
        "day", F.col("captured_at").cast("date"))
    archive_store.write_archive(held, path, "day")
    stored = spark.read.parquet(path)
    new = captures(spark, (1, 7, "2024-01-07", "A"), (1, 8, "2024-01-07", "B")).withColumn(
        "day", F.col("captured_at").cast("date"))
    fresh = archive.unseen_captures(stored, new, ["capture_id"], CONTENT, within="day")
    assert rows(fresh.select("capture_id")) == [(8,)]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    pruned = [x for x in plan.split("\n") if "PartitionFilters: [" in x and "day" in x]
    assert len(pruned) == 1 and "subquery" in pruned[0].split("PartitionFilters: ")[1].lower()


def test_append_keeps_captures_a_microsecond_apart(spark):
    held = captures(spark, (1, 1, "2024-01-01T00:00:00.000001", "A"))
    new = captures(spark, (1, 2, "2024-01-01T00:00:00.000002", "A"),
                   (1, 3, "2024-01-01T00:00:00.000001", "A"))
    out = archive.append_captures(held, new, ["key", "captured_at"], ["state"])
    assert [r[1] for r in rows(out)] == [1, 2]


def test_of_equal_captures_always_the_same_one_is_added(spark):
    new = captures(spark, *[(1, i, "2024-01-01", "A", float(i)) for i in range(9, 0, -1)])
    empty = new.limit(0)
    for n in (1, 2, 3, 5, 8):
        out = archive.append_captures(empty, new.repartition(n), ["key"], ["state"])
        assert [r.capture_id for r in out.collect()] == [1]


def test_within_looks_at_its_partition_only_however_many_there_are(spark):
    held = spark.createDataFrame([(1, "a"), (2, None)], "id long, day string")
    few = [(1, "b"), (2, None), (3, None)]
    many = few + [(i, f"d{i}") for i in range(100, 11_000)]
    for new in (few, many):
        df = spark.createDataFrame(new, "id long, day string")
        out = archive.unseen_captures(held, df, ["id"], [], within="day")
        assert {tuple(r) for r in out.collect()} == set(new) - {(2, None)}


def test_removal_from_the_stored_archive(spark, tmp_path):
    path = str(tmp_path / "archive")
    held = captures(spark, *[(k, 10 * k + d, f"2024-01-0{d}", "A") for k in (1, 2, 3)
                             for d in range(1, 5) if (k, d) != (2, 1)],
                    (2, 99, "2024-01-09", "B"), (2, 98, None, "C"), (3, 97, None, "C"))
    held = held.withColumn("day", F.col("captured_at").cast("date"))
    archive_store.write_archive(held, path, "day")
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "archive" / "day=2024-01-01").iterdir()}
    asked = spark.createDataFrame([(2,), (None,), (77,)], "key int")
    archive_store.remove_from_archive(spark, path, "day", asked, "key")
    stored = spark.read.parquet(path)
    assert rows(stored.select("capture_id")) == rows(held.where("key <> 2").select("capture_id"))
    assert {f: f.stat().st_mtime_ns for f in untouched} == untouched
    assert not (tmp_path / "archive" / "day=2024-01-09").exists()
    assert archive.versions(stored, ["state"]).where("key = 2").count() == 0
    archive_store.remove_from_archive(spark, path, "day", asked, "key")
    assert spark.read.parquet(path).count() == 9


def test_nearest_is_never_a_capture_without_a_time(spark):
    df = captures(spark, (1, 1, "2024-01-01", "A"), (1, 2, None, "B"), (2, 3, None, "C"))
    assert rows(archive.nearest_capture(df, "2024-06-01")) == [(1, 1)]


def test_a_busy_partition_is_written_by_several_tasks(spark, tmp_path):
    path = tmp_path / "archive"
    df = spark.range(0, 60_000, 1, 8).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.when(F.col("id") < 50_000, "busy").otherwise(F.concat(F.lit("d"), F.col("id") % 5))
        .alias("day"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        archive_store.write_archive(df, str(path), "day")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in path.glob("day=*")}
    assert files["day=busy"] > 4
    assert all(files[f"day=d{i}"] <= 2 for i in range(5))
    assert spark.read.parquet(str(path)).count() == 60_000


def test_as_of_ties_and_bounds(spark):
    df = captures(spark, (1, 1, "2024-01-01", "A"), (1, 3, "2024-01-02", "B"),
                  (1, 2, "2024-01-02", "C"), (2, 4, "2024-01-03", "D"), (3, 5, None, "E"))
    assert rows(archive.as_of(df, "2024-01-02")) == [(1, 3, at("2024-01-02"), "B", None)]
    assert archive.as_of(df, "2023-01-01").count() == 0


def test_as_of_looks_at_nothing_later(spark):
    df = captures(spark, *[(i % 3, i, f"2024-01-{i + 1:02d}", str(i)) for i in range(20)])
    before = df.where(F.col("captured_at") <= F.lit("2024-01-11").cast("timestamp_ntz"))
    assert rows(archive.as_of(df, "2024-01-11")) == rows(archive.as_of(before, "9999-01-01"))


def test_nearest_ties_go_to_the_smaller_id(spark):
    df = captures(spark, (1, 9, "2024-01-01T11:00", "A"), (1, 2, "2024-01-01T13:00", "B"),
                  (2, 5, "2024-01-09", "C"))
    assert rows(archive.nearest_capture(df, "2024-01-01 12:00:00")) == [(1, 2), (2, 5)]


@pytest.mark.parametrize("split", [HotSplit(), HotSplit(share=1000, min_rows=0)])
def test_versions(spark, split):
    df = captures(spark, (1, 1, "2024-01-01", "A"), (1, 2, "2024-01-02", "A"),
                  (1, 3, "2024-01-03", "B"), (1, 4, "2024-01-04", "A"),
                  (2, 5, "2024-01-01", None), (2, 6, "2024-01-02", None),
                  (2, 7, "2024-01-03", "A"))
    out = archive.versions(df, ["state"], split=split)
    assert [r[1] for r in rows(out)] == [1, 3, 4, 5, 7]
    assert rows(archive.versions(out, ["state"], split=split)) == rows(out)


def test_snapshot_diff(spark):
    a = captures(spark, (1, 1, None, "A"), (2, 2, None, "B"), (3, 3, None, None), (4, 4, None, "D"))
    b = captures(spark, (2, 9, None, "X"), (3, 8, None, None), (4, 7, None, "D"), (5, 6, None, "E"))
    assert rows(archive.snapshot_diff(a, b, "key", ["state"])) == [
        (1, "removed"), (2, "changed"), (3, "same"), (4, "same"), (5, "added")]
    assert {r[1] for r in rows(archive.snapshot_diff(a, a, "key", ["state"]))} == {"same"}


def test_calendar_and_gaps(spark):
    df = captures(spark, (1, 1, "2024-01-01T01:00", "A"), (1, 2, "2024-01-01T23:59:59", "A"),
                  (1, 3, "2024-01-04", "A"), (2, 4, "2024-01-02", "A"), (1, 5, "2024-01-05", "A"))
    assert [(k, str(d), n) for k, d, n in rows(archive.capture_calendar(df))] == [
        (1, "2024-01-01", 2), (1, "2024-01-04", 1), (1, "2024-01-05", 1), (2, "2024-01-02", 1)]
    assert [(k, str(d)) for k, d in rows(archive.gap_report(df))] == [
        (1, "2024-01-02"), (1, "2024-01-03")]


def test_capture_run_twice_adds_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    schema = "room string, who string, id long, text string, day date"
    day = at("2024-01-01").date()
    new = spark.createDataFrame(
        [("open", "ann", 1, "a", day), ("open", "bob", 2, "b", day),
         ("closed", "ann", 3, "c", day), ("open", None, 4, "d", day)], schema)
    spaces = spark.createDataFrame([("open",)], "room string")
    gone = spark.createDataFrame([("bob",)], "who string")
    spark.createDataFrame([], schema).write.partitionBy("day").parquet(path)

    def run():
        capture_run(spark.read.schema(schema).parquet(path), new, spaces, gone, "room", "who",
                    ["id"], ["room", "who", "text"], path, "day")
        return rows(spark.read.parquet(path).select("id"))

    assert run() == [(1,), (4,)]
    assert run() == [(1,), (4,)]


def test_removed_people_are_in_no_view_of_the_past(spark):
    df = captures(spark, (1, 1, "2024-01-01", "A"), (2, 2, "2024-01-01", "B"),
                  (2, 3, "2024-01-05", "C"))
    left = honour_removals(df, spark.createDataFrame([(2,)], "key long"), "key")
    for out in (archive.as_of(left, "2024-01-31"), archive.versions(left, ["state"]),
                archive.capture_calendar(left), archive.gap_report(left)):
        assert out.where("key = 2").count() == 0


def test_empty_input(spark):
    empty = captures(spark, (1, 1, "2024-01-01", "A")).limit(0)
    assert archive.append_captures(empty, empty, ["capture_id"], CONTENT).count() == 0
    assert archive.as_of(empty, "2024-01-01").count() == 0
    assert archive.nearest_capture(empty, "2024-01-01").count() == 0
    assert archive.versions(empty, ["state"]).count() == 0
    assert archive.snapshot_diff(empty, empty, "key", ["state"]).count() == 0
    assert archive.gap_report(empty).count() == 0


@pytest.mark.parametrize("split", [HotSplit(), HotSplit(share=1000, min_rows=3)])
def test_states_at_many_moments(spark, split):
    """Equal to one ``as_of`` per moment, ties, nulls and repeats included."""
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    captures = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([None, *[
        start + dt.timedelta(hours=rng.randrange(40))] * 9]), f"s{i % 4}", None)
        for i in range(300)]
    moments = [(rng.choice([1, 1, 2, 3, 4, None]), start + dt.timedelta(hours=rng.randrange(-3, 45)))
               for _ in range(120)] + [(1, None), (1, start), (1, start)]
    df = spark.createDataFrame(captures, CAPTURES)
    found = archive.states_at(df, spark.createDataFrame(
        moments, "key long, moment timestamp_ntz"), split=split)
    assert found.columns == ["key", "moment", "capture_id", "captured_at", "state", "value"]
    want = []
    for key, moment in moments:
        before = [(c[2], c[1], c) for c in captures
                  if c[0] == key and c[2] and moment and c[2] <= moment]
        best = max(before)[2][1:] if before else (None,) * 4
        want.append((key, moment, *best))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
