"""Live intake, activity, sessions, replies, and capture into the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquary.operators.archive import unseen_captures
from colloquary.operators.distill import sessionize
from colloquary.plans.skew import HotSplit
from colloquary.sources.archive_store import (
    last_batch, note_batch, recover_archive, write_archive)


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    # watermarks need a timestamp with zone; the session zone is UTC
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_intake(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Drop repeats of ``key`` that arrive within ``delay``.

    State is kept no longer than that, so a much later repeat gets through;
    lasting uniqueness comes from ``append_captures``.
    """
    return (_event_time(stream, ts).withWatermark(ts, delay)
            .dropDuplicatesWithinWatermark([key]))


def stream_activity(stream: DataFrame, ts: str, width: str, delay: str,
                    by: list[str]) -> DataFrame:
    """Counts per tumbling window and group; rows later than ``delay`` are dropped."""
    counted = (_event_time(stream, ts).withWatermark(ts, delay)
               .groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n")))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                          F.col("window.end").cast("timestamp_ntz").alias("window_end"), *by, "n")


def stream_sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str,
                    split: HotSplit = HotSplit(), tie: list[str] | None = None) -> DataFrame:
    """Discussions per ``key`` cut by a silence longer than ``gap``; the end is last row plus gap.

    A plain table is cut with ``sessionize``, which copes with a key that owns
    much of the table; ``tie`` is for that.
    """
    if stream.isStreaming:
        counted = (_event_time(stream, ts).withWatermark(ts, delay)
                   .groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")))
        start, end = F.col("session_window.start"), F.col("session_window.end")
    else:
        counted = (sessionize(stream.where(F.col(ts).isNotNull()), key, ts, gap, tie, split)
                   .groupBy(key, "session_no")
                   .agg(F.min(ts).alias("first"), F.max(ts).alias("last"),
                        F.count(F.lit(1)).alias("n")))
        start, end = F.col("first"), F.col("last") + F.expr(f"interval {gap}")
    return counted.select(key, start.cast("timestamp_ntz").alias("session_start"),
                          end.cast("timestamp_ntz").alias("session_end"), "n")


def run_sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str, path: str,
                 checkpoint: str) -> None:
    """``stream_sessions`` for rooms that may hold much of a stream: process all there is and
    append final sessions to Parquet at ``path``.

    Two queries, one after the other.  The first sums up each room's slices of ``gap``, whose
    rows are all of one session; its states are many and are combined before the shuffle, so a
    busy room costs a row per slice and task.  The second merges slices over silences; what
    it keeps and reads of a room is one row per slice.  Between them lie the finished slices,
    at ``checkpoint``/slices.  A slice is final once rows are ``delay`` past its end, a session
    once a slice begins more than ``gap`` past its own end.
    """
    micros = f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {gap})"
    slices = (_event_time(stream, ts).withWatermark(ts, delay)
              .groupBy(key, F.window(ts, gap))
              .agg(F.min(ts).alias("first"), F.max(ts).alias("last"),
                   F.count(F.lit(1)).alias("n"))
              .select(key, "first", "last", "n"))
    run_available(slices, f"{checkpoint}/slices", f"{checkpoint}/cut")
    spark = stream.sparkSession
    done = spark.readStream.schema(slices.schema).parquet(f"{checkpoint}/slices")
    # slices come out in order but for those of one batch, which begin less than a gap apart
    # from where the last batch ended
    span = F.concat(F.expr(f"unix_micros(last) - unix_micros(first) + {micros}").cast("string"),
                    F.lit(" microseconds"))
    merged = (done.withWatermark("first", gap)
              .groupBy(key, F.session_window("first", span))
              .agg(F.sum("n").alias("n"))
              .select(key, F.col("session_window.start").cast("timestamp_ntz").alias(
                  "session_start"), F.col("session_window.end").cast("timestamp_ntz").alias(
                  "session_end"), "n"))
    run_available(merged, path, f"{checkpoint}/merge")


def stream_replies(stream: DataFrame, key: str, ts: str, author: str, turn: str, asker: str,
                   answerer: str, within: str, delay: str) -> DataFrame:
    """Turns by ``asker`` with the first one by ``answerer`` in the same room that follows
    within a time, or with nulls if none does: ``key, question, asked_at, answer, answered_at``.
    A row comes out once no answer can come any more.

    Both sides meet on (room, stretch of ``within``), of which a question touches two, so a
    busy room is spread over its time.  Of answers of one time the smaller ``turn`` counts.
    """
    timed = _event_time(stream, ts).withWatermark(ts, delay)
    width = f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {within})"

    def stretch(at: str) -> Column:
        return F.floor(F.unix_micros(at) / F.expr(width))

    asked = timed.where(F.col(author) == asker).select(
        F.col(key), F.col(turn).alias("question"), F.col(ts).alias("asked_at")).withColumn(
        "__stretch", F.explode(F.array(stretch("asked_at"), stretch("asked_at") + 1)))
    said = timed.where(F.col(author) == answerer).select(
        F.col(key).alias("__key"), F.col(turn).alias("answer"), F.col(ts).alias("answered_at")
    ).withColumn("__place", stretch("answered_at"))
    met = asked.join(said, F.expr(
        f"{key} = __key AND __stretch = __place AND answered_at > asked_at "
        f"AND answered_at <= asked_at + interval {within}"), "left_outer")
    first = F.min(F.when(F.col("answered_at").isNotNull(),
                         F.struct("answered_at", "answer"))).alias("__first")
    return met.groupBy(key, "question", "asked_at").agg(first).select(
        key, "question", F.col("asked_at").cast("timestamp_ntz").alias("asked_at"),
        F.col("__first.answer").alias("answer"),
        F.col("__first.answered_at").cast("timestamp_ntz").alias("answered_at"))


def capture_live(stream: DataFrame, path: str, by: str, identity: list[str], content: list[str],
                 checkpoint: str, name: str = "live") -> None:
    """Append all there is of ``stream`` to the archive at ``path``, partitioned by ``by``,
    every capture once.

    A batch that is delivered again, by Spark after a crash or by its source at any time, adds
    nothing: its rows are looked for in the partitions that it touches (``unseen_captures``).
    The number of the last batch that is in the archive is kept beside the data under ``name``,
    which must be one per checkpoint; a batch not above it is passed over unread.
    """
    schema = stream.schema

    def capture(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= last_batch(spark, path, name):
            return
        batch = batch.persist()
        try:
            archive = spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path)
            write_archive(unseen_captures(archive, batch, identity, content, within=by), path, by)
        finally:
            batch.unpersist()
        note_batch(spark, path, name, number)

    recover_archive(stream.sparkSession, path)
    write_archive(stream.sparkSession.createDataFrame([], schema), path, by)
    (stream.writeStream.foreachBatch(capture).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all there is and append it to Parquet at ``path``.

    Started again with the same ``checkpoint`` it goes on where it stopped.
    """
    (stream.writeStream.outputMode("append").format("parquet")
     .option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
