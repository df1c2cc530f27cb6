"""The stored archive: types of partition values, and rewrites that break off anywhere."""

import pytest
from pyspark.sql import functions as F

from colloquary.sources import archive_store as store

ODD = ["007", "7", "1e3", None, "2024-01-01", "a b/c=%d:", "%25", "true", "é", "x'y\"z"]
SCHEMA = "who long, said string, room string"


class Killed(Exception):
    pass


def fill(spark, path):
    rows = [(who, f"{room}-{who}", room) for room in ODD for who in range(4)]
    store.write_archive(spark.createDataFrame(rows, SCHEMA), path, "room")
    return rows


def held(spark, path, schema=None):
    found = store.read_archive(spark, path, "room", schema).select("who", "said", "room")
    return sorted(map(tuple, found.collect()), key=str)


def asked(spark):
    """Person 1, and all of the room 7."""
    return spark.createDataFrame([(1,)], "who long")


def rewrite(spark, path, step=lambda name: None):
    from colloquary.plans.skew import drop_listed, keep_listed

    gone = asked(spark)

    def rest(rows):
        return drop_listed(rows, gone, "who").where(~F.coalesce(F.col("room") == "7", F.lit(False)))

    return store.rewrite_archive(spark, path, "room", lambda rows: keep_listed(rows, gone, "who"),
                                 rest, step=step)


def wanted(rows):
    return sorted([r for r in rows if r[0] != 1 and r[2] != "7"], key=str)


def test_partition_values_stay_text(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = fill(spark, path)
    assert held(spark, path) == sorted(rows, key=str)
    assert store.read_archive(spark, path, "room").schema["room"].dataType.simpleString() == "string"
    assert spark.conf.get(store.INFERENCE) == "true"
    with pytest.raises(ValueError):
        store.read_archive(spark, path, "day")


def test_remove_whatever_partitions_look_like(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = fill(spark, path)
    for _ in range(2):
        store.remove_from_archive(spark, path, "room", asked(spark), "who")
        assert held(spark, path) == sorted([r for r in rows if r[0] != 1], key=str)
    assert not [p.name for p in tmp_path.joinpath("a").iterdir() if p.name.startswith("_rewrite")]


def steps(spark, path):
    seen = []
    rewrite(spark, path, seen.append)
    return seen


def test_killed_between_any_two_steps(spark, tmp_path):
    """Some steps of each kind, the first and the last of them; run again, or only recovered."""
    fill(spark, str(tmp_path / "plain"))
    seen = steps(spark, str(tmp_path / "plain"))
    outs = [s for s in seen if s.startswith("out")]
    ins = [s for s in seen if s.startswith("in")]
    assert seen[:3] == ["touched", "new", "plan"] and seen[-2:] == ["swapped", "forgotten"]
    assert len(outs) == len(ODD) and len(ins) == len(ODD) - 1
    for i, at in enumerate([*seen[:3], outs[0], ins[0], outs[-1], ins[-1], *seen[-2:]]):
        path = str(tmp_path / f"killed{i}")
        rows = fill(spark, path)

        def stop(name):
            if name == at:
                raise Killed

        with pytest.raises(Killed):
            rewrite(spark, path, stop)
        # nothing doubled, and nothing of those who stay is lost once it is recovered
        store.recover_archive(spark, path)
        done = at not in ("touched", "new")
        assert held(spark, path) == (wanted(rows) if done else sorted(rows, key=str))
        rewrite(spark, path)
        assert held(spark, path) == wanted(rows)


def test_killed_while_recovering(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = fill(spark, path)
    left = {"n": 0}

    def stop(name):
        left["n"] += 1
        if left["n"] % 4 == 0:
            raise Killed

    for _ in range(20):
        try:
            rewrite(spark, path, stop)
            break
        except Killed:
            pass
    assert held(spark, path) == wanted(rows)


def test_nothing_to_remove(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = fill(spark, path)
    none = spark.createDataFrame([(99,)], "who long")
    store.remove_from_archive(spark, path, "room", none, "who")
    assert held(spark, path) == sorted(rows, key=str)


def read_rows(df):
    """Rows that the scan hands on, after it has skipped row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value()
               for i in range(leaves.size()))


def test_laid_out_for_one_key(spark, tmp_path):
    """As many files as appends before; then one key skips nearly all row groups."""
    path = str(tmp_path / "a")
    for part in range(6):
        store.write_archive(spark.range(4000).selectExpr(
            "id * 7919 % 4001 AS who", f"concat('said {part} ', id) AS said",
            "CASE id % 3 WHEN 0 THEN '007' WHEN 1 THEN NULL ELSE '1e3' END AS room"), path, "room")
    store.write_archive(spark.createDataFrame([(1, "only one file", "alone")], SCHEMA), path, "room")
    before = held(spark, path)
    with_key = lambda: store.read_archive(spark, path, "room").where("who = 1234")
    found, read = sorted(map(tuple, with_key().collect()), key=str), read_rows(with_key())
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        assert store.lay_out_archive(spark, path, "room", "who") == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert held(spark, path) == before
    assert sorted(map(tuple, with_key().collect()), key=str) == found
    assert len(found) == 6 and read_rows(with_key()) < read / 2
    missing = store.read_archive(spark, path, "room").where("who = 4000000")
    assert read_rows(missing) == 0
    # what is in one file already is left alone
    assert store.lay_out_archive(spark, path, "room", "who", files=100) == 0
