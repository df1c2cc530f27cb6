import pytest
from pyspark.sql import types as T

from colloquary.plans import skew
from colloquary.schemas import MESSAGES
from colloquary.sources import intake
from tests.helpers import rows


def test_to_messages_fills_and_casts(spark):
    df = spark.createDataFrame([(7, "0", "a", "hi")], "room int, n string, who string, said string")
    out = intake.to_messages(df, {"conv_id": "room", "seq": "n", "author": "who", "text": "said"})
    assert out.schema.names == MESSAGES.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in MESSAGES]
    assert rows(out) == [(None, 7, 0, "a", None, "hi")]


def test_to_messages_refuses_unknown_columns(spark):
    with pytest.raises(ValueError):
        intake.to_messages(spark.range(1), {"nope": "id"})


def test_json_export_rejects(spark):
    df = spark.createDataFrame(
        [(1, '{"a": 5}'), (2, "{broken"), (3, ""), (4, None), (5, " \n\t "), (6, '{"a": "x"}'),
         (7, "{}"), (8, '{"a": null, "b": 1}')], "id int, raw string")
    good, bad = intake.parse_json_export(
        df, "raw", T.StructType([T.StructField("a", T.LongType())]))
    assert rows(good.select("id", "a")) == [(1, 5), (7, None), (8, None)]
    assert rows(bad) == sorted([("{broken", "malformed"), ("", "blank"), (None, "null"),
                                (" \n\t ", "blank"), ('{"a": "x"}', "malformed")], key=repr)


def test_json_export_with_more_behind(spark):
    texts = ['{"a": 1}', ' {"a": 2} \n', '{"a":1}{"a":2}', '{"a":1},{"a":2}', '{"a":1} rubbish',
             '{"a":1}]', '{"a":1}]}', '[{"a":1}]', '1', '"x"', 'null', '{"a":1}\n{"a":2}', '{"a":"]}"}']
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    good, bad = intake.parse_json_export(
        df, "raw", T.StructType([T.StructField("a", T.LongType())]))
    assert rows(good) == sorted([(texts[0], 1), (texts[1], 2)], key=repr)
    assert rows(bad) == sorted([(t, "malformed") for t in texts[2:]], key=repr)


def test_chat_shaped_fields(spark):
    df = spark.createDataFrame(
        [("!r:m.org", 1700000000123), ("!s:m.org", 1700000000), ("42", None)],
        "room string, at long")
    out = intake.to_messages(df, {"conv_id": "room", "ts": "at"}).collect()
    assert [str(r.ts) for r in out] == [
        "2023-11-14 22:13:20.123000", "2023-11-14 22:13:20", "None"]
    assert out[2].conv_id == 42 and len({r.conv_id for r in out}) == 3


def test_json_export_nested(spark):
    schema = T.StructType.fromDDL("content struct<body:string>, sender string")
    df = spark.createDataFrame([('{"sender": "@a", "content": {"body": "hi"}}',)], "raw string")
    good, bad = intake.parse_json_export(df, "raw", schema)
    assert rows(good.select("sender", "content.body")) == [("@a", "hi")]
    assert bad.count() == 0


def test_line_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("12:00 <ann> hi there\n* bob waves\n12:01 <bob> yes\n\n")
    good, bad = intake.parse_line_log(
        intake.read_lines(spark, str(tmp_path)), r"^(\d\d:\d\d) <(\w+)> (.*)$",
        ["time", "author", "text"])
    assert rows(good) == [("12:00", "ann", "hi there"), ("12:01", "bob", "yes")]
    assert rows(bad) == [("",), ("* bob waves",)]


def test_line_log_null_line_is_a_reject(spark):
    good, bad = intake.parse_line_log(
        spark.createDataFrame([(None,), ("a",)], "value string"), "^(a)$", ["x"])
    assert rows(good) == [("a",)] and rows(bad) == [(None,)]


def test_public_only(spark):
    df = spark.createDataFrame(
        [("open", i) for i in range(50)] + [("closed", i) for i in range(40)]
        + [("rare", 1), ("other", 1), (None, 1)], "space string, i int")
    spaces = spark.createDataFrame([("open",), ("open",), ("rare",), (None,)], "space string")
    out = intake.public_only(df, spaces, "space")
    assert rows(out) == sorted([("open", i) for i in range(50)] + [("rare", 1)], key=repr)


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "decimal(20,0)"])
@pytest.mark.parametrize("listed", ["int", "bigint", "string", "smallint"])
def test_lists_of_other_types(spark, kind, listed):
    df = spark.range(10).selectExpr(f"cast(id AS {kind}) AS k", "map('a', id) AS m")
    names = spark.range(5, 20).selectExpr(f"cast(id AS {listed}) AS k", "id AS other")
    assert sorted(int(r.k) for r in intake.public_only(df, names, "k").collect()) == [5, 6, 7, 8, 9]
    left = skew.drop_listed(df, names, "k").collect()
    assert sorted(int(r.k) for r in left) == [0, 1, 2, 3, 4] and left[0].m


def test_names_that_no_key_can_be(spark):
    df = spark.range(3).selectExpr("cast(id AS int) AS k")
    names = spark.createDataFrame([("1",), ("x",), ("99999999999",), (None,)], "k string")
    assert rows(intake.public_only(df, names, "k")) == [(1,)]
    assert rows(skew.drop_listed(df, names, "k")) == [(0,), (2,)]


def test_a_list_longer_than_any_broadcast(spark):
    df = spark.range(0, 2000).selectExpr("cast(if(id % 3 = 0, 7, id) AS int) AS k", "id")
    names = spark.range(1_000_001).selectExpr("id * 2 + 1 AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert skew.drop_listed(df, names, "k").where("k % 2 = 1").count() == 0
        assert skew.keep_listed(df, names, "k").count() == 667 + 667
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_building_a_list_plan_starts_no_job(spark):
    df, names = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).toDF("k")
    spark.sparkContext.setJobGroup("planning", "")
    skew.drop_listed(df, names, "k")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_public_only_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("open", 1), ("closed", 2)], "space string, i int").write.parquet(src)
    spaces = spark.createDataFrame([("open",)], "space string")
    stream = spark.readStream.schema("space string, i int").parquet(src)
    query = (intake.public_only(stream, spaces, "space").writeStream.format("parquet")
             .option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("open", 1)]


def test_text_ids_stay_apart(spark):
    texts = ["7", " 7 ", "+7", "007", "7.0", None, "room", "-3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, room string")
    ids = [r.conv_id for r in intake.to_messages(df, {"conv_id": "room", "seq": "i"}).orderBy(
        "seq").collect()]
    assert ids[0] == 7 and ids[5] is None and ids[7] == -3 and len(set(ids)) == len(texts)


def test_times_that_are_none(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.5e9,)], "t double")
    out = intake.to_messages(df, {"ts": "t"}).collect()
    assert [r.ts is None for r in out] == [True, True, True, False]
