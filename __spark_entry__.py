"""

Stand-ins: ``conversations`` for messages (turn = seq, role = author), ``events``
for captures (user_id = key, event_id = capture_id), ``documents`` for text with
copies and personal data, toxic ``labels`` for a removal list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquary.functions.masking import DEFAULT_RULES
from colloquary.operators import (
    archive, compare, consume, distill, intervals, respect, select, sketches)
from colloquary.plans.capture_run import capture_run
from colloquary.plans.skew import HotSplit
from colloquary.plans.worth_reading import worth_reading
from colloquary.session import shared_folder
from colloquary.sources import any_export, archive_store, intake
from colloquary.streaming import live

try:
    import corpus_pipeline
    from colloquary.llm import queries as training_data
except ImportError:  # the training-data operators are an optional part
    corpus_pipeline = training_data = None

MAPPING = {"conv_id": "conv_id", "seq": "turn", "author": "role", "text": "text"}
EVENTS = archive.Names("user_id", "event_id", "ts")
WEIGHTS = {"turns": (0.4, 8), "authors": (0.2, 3), "chars": (0.4, 4000)}
SEARCH = ["the", "que", "der"]
PHRASES = ["of-the", "de la", "The."]
PART = 3  # small, so that the fixtures show discussions of several parts
SALT = "not-a-secret-only-for-checks"
_ROOM = """CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN '007'
  WHEN user_id % 7 = 2 THEN '7' WHEN user_id % 7 = 3 THEN '1e3'
  WHEN user_id % 7 = 4 THEN '2024-01-01' WHEN user_id % 7 = 5 THEN 'a b/c=%d:' ELSE 'true' END"""
_MIXED = """CASE event_id % 4 WHEN 0 THEN concat('[', props, ']') WHEN 1 THEN concat(props, '}')
  ELSE props END"""
LINE = r"^<(\w+)> (.*)$"
RULES = dict(zip(["emails", "addresses", "tokens", "numbers"], DEFAULT_RULES))
# low enough that every key of the fixtures is cut into pieces
CUT_ALL = HotSplit(share=1000, min_rows=5)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return intake.read_table(spark, sf_dir, name)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.to_messages(_table(spark, sf_dir, "conversations"), MAPPING)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _events(spark, sf_dir).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir))


def _run_live(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(spark, name)
    live.run_available(stream, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def entry(spark: SparkSession) -> DataFrame:
    """The ten discussions most worth keeping, as readable text."""
    return worth_reading(_messages(spark, "/root/testdata/sf0.001"), WEIGHTS, 10)


# --- intake ------------------------------------------------------------------

def q_to_messages(spark, sf):
    return _messages(spark, sf)


def _damaged_exports(spark, sf):
    """props as they are, cut short, blank, missing or followed by more, by event type"""
    props, kind = F.col("props"), F.col("event_type")
    return _events(spark, sf).select("event_id", F.when(
        kind == "error", F.substring(props, 1, 4)).when(kind == "signup", F.lit("  "))
        .when((kind == "purchase") & (F.col("user_id") % 3 == 0), F.concat(props, props))
        .when((kind == "purchase") & (F.col("user_id") % 3 == 1), F.concat(props, F.lit("]")))
        .when(kind != "view", props).alias("raw"))


_EXPORT = T.StructType([T.StructField("k", T.LongType())])


def q_parse_json_export(spark, sf):
    return intake.parse_json_export(_damaged_exports(spark, sf), "raw", _EXPORT)[0]


def q_parse_json_export_rejects(spark, sf):
    return intake.parse_json_export(_damaged_exports(spark, sf), "raw", _EXPORT)[1]


def _lines(spark, sf):
    said = F.concat(F.lit("<"), F.col("role"), F.lit("> "), F.col("text"))
    return _table(spark, sf, "conversations").select(
        F.explode(F.split(said, "\n")).alias("value"))


def q_parse_line_log(spark, sf):
    return intake.parse_line_log(_lines(spark, sf), LINE, ["author", "said"])[0]


def q_parse_line_log_rejects(spark, sf):
    return intake.parse_line_log(_lines(spark, sf), LINE, ["author", "said"])[1]


def q_public_only(spark, sf):
    docs = _documents(spark, sf)
    spaces = (docs.groupBy("source").agg(F.avg("n_chars").alias("a"))
              .where(F.col("a") > 2400).select("source"))
    return intake.public_only(docs, spaces, "source")


def q_public_only_other_type(spark, sf):
    """a list of numbers as text, some of which no key can be"""
    listed = _table(spark, sf, "labels").where("toxic = 1").select(
        F.col("doc_id").cast("string").alias("doc_id"))
    odd = listed.select(F.concat("doc_id", F.lit("x")).alias("doc_id"))
    return intake.public_only(_documents(spark, sf), listed.unionByName(odd), "doc_id")


def q_stream_intake(spark, sf):
    """every event delivered twice"""
    stream = _event_stream(spark, sf)
    seen = live.stream_intake(stream.unionByName(stream), "event_id", "ts", "1 hour")
    return _run_live(spark, seen, "intake").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- preservation ------------------------------------------------------------

_CONTENT = ["event_type", "value", "props"]


def q_append_captures(spark, sf):
    events = _events(spark, sf)
    held = events.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    new = events.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return archive.append_captures(held, new.unionByName(new), ["event_id"], _CONTENT)


def q_append_captures_close_times(spark, sf):
    """each event twice, a microsecond apart, told apart by user and time alone"""
    events = _events(spark, sf)
    later = events.withColumn("ts", F.col("ts") + F.expr("interval 1 microsecond"))
    return archive.append_captures(events, later.unionByName(events), ["user_id", "ts"], [])


def q_capture_run(spark, sf):
    """the same events captured twice; nobody of whom signed up is kept"""
    path = shared_folder(spark, "run")
    events = _events(spark, sf).withColumn("day", F.col("ts").cast("date"))
    spaces = events.select("event_type").distinct().where("event_type <> 'click'")
    asked = events.where("event_type = 'signup' AND user_id % 2 = 0").select("user_id")
    for _ in range(2):
        held = spark.read.schema(events.schema).option("ignoreMissingFiles", "true")
        archive_store.write_archive(events.limit(0), path, "day")
        capture_run(held.parquet(path), events, spaces, asked, "event_type", "user_id",
                    ["event_id"], _CONTENT, path, "day")
    return spark.read.schema(events.schema).parquet(path)


def q_remove_from_archive(spark, sf):
    path = shared_folder(spark, "archive")
    events = _events(spark, sf).withColumn("day", F.col("ts").cast("date"))
    archive_store.write_archive(events, path, "day")
    asked = events.where("event_type = 'purchase' AND user_id % 5 = 0").select(
        F.col("user_id").cast("int").alias("user_id"))
    archive_store.remove_from_archive(spark, path, "day", asked, "user_id")
    return spark.read.schema(events.schema).parquet(path)


def q_remove_from_archive_text_partitions(spark, sf):
    """rooms whose names look like numbers, or are missing"""
    path = shared_folder(spark, "archive")
    events = _events(spark, sf).withColumn("room", F.expr(_ROOM))
    archive_store.write_archive(events, path, "room")
    asked = events.where("event_type = 'purchase' AND user_id % 5 = 0").select("user_id")
    archive_store.remove_from_archive(spark, path, "room", asked, "user_id")
    return archive_store.read_archive(spark, path, "room").select(*events.columns)


def q_lay_out_archive(spark, sf):
    """written in two halves, then laid out for one user"""
    path = shared_folder(spark, "archive")
    events = _events(spark, sf).withColumn("room", F.expr(_ROOM))
    for half in (0, 1):
        archive_store.write_archive(events.where(F.col("event_id") % 2 == half), path, "room")
    archive_store.lay_out_archive(spark, path, "room", "user_id")
    return archive_store.read_archive(spark, path, "room").select(*events.columns)


def q_capture_live(spark, sf):
    """every event delivered twice, then the whole stream again from its beginning"""
    path = shared_folder(spark, "captured")
    stream = _event_stream(spark, sf).withColumn("day", F.col("ts").cast("date"))
    for i in range(2):
        live.capture_live(stream.unionByName(stream), path, "day", ["event_id"], _CONTENT,
                          shared_folder(spark, "checkpoint"), f"run{i}")
    return archive_store.read_archive(spark, path, "day", stream.schema)


def _moments(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").select(
        "user_id", (F.col("ts") + F.expr("interval 90 minutes")).alias("moment"))


def q_states_at(spark, sf):
    events = _events(spark, sf)
    return archive.states_at(events, _moments(events), names=EVENTS)


def q_states_at_busy_keys(spark, sf):
    events = _events(spark, sf)
    return archive.states_at(events, _moments(events), names=EVENTS, split=CUT_ALL)


def q_as_of(spark, sf):
    return archive.as_of(_events(spark, sf), "2024-01-15 12:00:00", EVENTS)


def q_nearest_capture(spark, sf):
    return archive.nearest_capture(_events(spark, sf), "2024-01-15 12:00:00", EVENTS)


def q_versions(spark, sf):
    return archive.versions(_events(spark, sf), ["event_type"], EVENTS)


def q_versions_busy_keys(spark, sf):
    return archive.versions(_events(spark, sf), ["event_type"], EVENTS, CUT_ALL)


def _withdrawn(spark, sf):
    return _events(spark, sf).where("value > 480").select("user_id")


def q_snapshot_diff(spark, sf):
    """the last states, before and after some people have withdrawn"""
    events = _events(spark, sf)
    left = respect.honour_removals(events, _withdrawn(spark, sf), "user_id")
    return archive.snapshot_diff(
        archive.as_of(events, "2024-01-02", EVENTS), archive.as_of(left, "2024-02-01", EVENTS),
        "user_id", ["event_type"])


def q_capture_calendar(spark, sf):
    return archive.capture_calendar(_events(spark, sf), EVENTS)


def q_gap_report(spark, sf):
    return archive.gap_report(_events(spark, sf), EVENTS)


def q_write_archive(spark, sf):
    path = shared_folder(spark, "archive")
    archive_store.write_archive(
        _events(spark, sf).withColumn("day", F.col("ts").cast("date")), path, "day")
    return spark.read.parquet(path)


# --- selection ---------------------------------------------------------------

def q_discussion_stats(spark, sf):
    return select.discussion_stats(_messages(spark, sf))


def _scored(spark, sf):
    return select.value_score(q_discussion_stats(spark, sf), WEIGHTS)


def q_value_score(spark, sf):
    return _scored(spark, sf)


def q_top_discussions(spark, sf):
    return select.top_discussions(_scored(spark, sf), 20)


def q_top_discussions_per_group(spark, sf):
    scored = _scored(spark, sf)
    return select.top_discussions(scored, 5, "authors").withColumn("rk", F.col("rk").cast("bigint"))


def _vocabulary(spark, sf):
    """words of the texts in `benchmark`"""
    return _table(spark, sf, "benchmark").select(
        F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term")).where(
        F.length("term") >= 5).distinct()


def q_term_filter(spark, sf):
    return select.term_filter(_messages(spark, sf), _vocabulary(spark, sf), 3)


def q_dedupe_exact(spark, sf):
    return select.dedupe_exact(_documents(spark, sf), "doc_id", "text")


# --- distillation ------------------------------------------------------------

def q_sessionize(spark, sf):
    return distill.sessionize(_events(spark, sf), "user_id", "ts", "6 hours", ["event_id"])


def q_sessionize_busy_keys(spark, sf):
    return distill.sessionize(
        _events(spark, sf), "user_id", "ts", "6 hours", ["event_id"], CUT_ALL)


def q_discussions_from_log(spark, sf):
    return distill.discussions_from_log(_events(spark, sf), "user_id", "ts", "6 hours",
                                        "event_type", "props", ["event_id"]).drop("conv_id")


def q_discussions_from_log_busy_keys(spark, sf):
    found = distill.discussions_from_log(_events(spark, sf), "user_id", "ts", "6 hours",
                                         "event_type", "props", ["event_id"], CUT_ALL)
    return select.discussion_stats(found).drop("conv_id")


def q_pair_replies(spark, sf):
    return distill.pair_replies(_messages(spark, sf), "user", "assistant")


def q_pair_replies_busy_keys(spark, sf):
    split = HotSplit(share=100_000, min_rows=2)
    return distill.pair_replies(_messages(spark, sf), "user", "assistant", split)


def _big_rank(df):
    return df.withColumn("rk", F.col("rk").cast("bigint"))


def q_key_terms(spark, sf):
    return _big_rank(distill.key_terms(_messages(spark, sf), 5))


def q_key_terms_busy_words(spark, sf):
    return _big_rank(distill.key_terms(_messages(spark, sf), 5, CUT_ALL))


def q_extract_summary(spark, sf):
    return _big_rank(distill.extract_summary(_messages(spark, sf), 2))


def q_extract_summary_busy_words(spark, sf):
    return _big_rank(distill.extract_summary(_messages(spark, sf), 2, CUT_ALL))


# --- respect -----------------------------------------------------------------

def q_pseudonymise(spark, sf):
    return respect.pseudonymise(_events(spark, sf), "user_id", SALT)


def q_redact(spark, sf):
    return respect.redact(_documents(spark, sf), "text")


def q_sensitive_report(spark, sf):
    return respect.sensitive_report(_documents(spark, sf), "text", "source", RULES)


def q_honour_removals(spark, sf):
    asked = _table(spark, sf, "labels").where("toxic = 1")
    return respect.honour_removals(_documents(spark, sf), asked, "doc_id")


def q_honour_removals_long_list(spark, sf):
    """a list far longer than the table, of another number type, with repeats and nulls"""
    asked = _table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("int"))
    others = spark.range(10**7, 10**7 + 1_000_001).select(
        F.when(F.col("id") % 1000 > 0, F.col("id")).cast("int").alias("doc_id"))
    return respect.honour_removals(
        _documents(spark, sf), asked.unionByName(others).unionByName(asked), "doc_id")


def q_credit_report(spark, sf):
    return respect.credit_report(respect.pseudonymise(_messages(spark, sf), "author", SALT))


# --- consumption -------------------------------------------------------------

def q_transcript(spark, sf):
    return consume.transcript(_messages(spark, sf))


def q_transcript_in_parts(spark, sf):
    return consume.transcript(_messages(spark, sf), PART)


def q_nested_export(spark, sf):
    return consume.nested_export(_messages(spark, sf), as_json=True, part_turns=PART)


def q_nested_export_array(spark, sf):
    """the array form, opened up again in order"""
    nested = consume.nested_export(_messages(spark, sf))
    return (nested.select("conv_id", F.posexplode("messages").alias("pos", "m"))
            .select("conv_id", F.col("pos").cast("bigint").alias("pos"),
                    "m.seq", "m.author", "m.text"))


def q_keyword_search_any(spark, sf):
    return consume.keyword_search(_messages(spark, sf), SEARCH, False)


def q_keyword_search_all(spark, sf):
    return consume.keyword_search(_messages(spark, sf), ["le", "de", "la"], True)


def q_keyword_search_phrases(spark, sf):
    return consume.keyword_search(_messages(spark, sf), PHRASES, False)


def q_hit_context(spark, sf):
    messages = _messages(spark, sf)
    hits = messages.where(F.lower("text").contains("the")).select(
        "conv_id", F.col("seq").alias("hit"))
    return consume.hit_context(messages, hits, 1).drop("space_id", "ts")


def q_activity_rollup(spark, sf):
    return consume.activity_rollup(_events(spark, sf), ["event_type"], "ts")


def q_register_views(spark, sf):
    consume.register_views(spark, {"kept_messages": _messages(spark, sf)})
    return spark.sql("SELECT author, max(seq) AS last_turn, count(*) AS n "
                     "FROM kept_messages GROUP BY author")


# --- streaming ---------------------------------------------------------------

def q_activity_windows(spark, sf):
    return live.stream_activity(_events(spark, sf), "ts", "1 day", "1 hour", ["event_type"])


def q_stream_activity(spark, sf):
    stream = live.stream_activity(
        _event_stream(spark, sf), "ts", "6 hours", "1 hour", ["event_type"])
    return _run_live(spark, stream, "activity")


def q_session_windows(spark, sf):
    return live.stream_sessions(_events(spark, sf), "user_id", "ts", "6 hours", "1 hour")


def q_session_windows_busy_keys(spark, sf):
    return live.stream_sessions(
        _events(spark, sf), "user_id", "ts", "6 hours", "1 hour", CUT_ALL)


def q_stream_sessions(spark, sf):
    stream = live.stream_sessions(
        _event_stream(spark, sf), "user_id", "ts", "6 hours", "1 hour")
    return _run_live(spark, stream, "sessions")


def q_stream_sessions_busy_rooms(spark, sf):
    folder = shared_folder(spark, "rooms")
    live.run_sessions(_event_stream(spark, sf), "user_id", "ts", "6 hours", "1 hour",
                      f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema("user_id bigint, session_start timestamp_ntz, "
                             "session_end timestamp_ntz, n bigint").parquet(f"{folder}/rows")


def q_stream_replies(spark, sf):
    replies = live.stream_replies(_event_stream(spark, sf), "user_id", "ts", "event_type",
                                  "event_id", "click", "purchase", "12 hours", "1 hour")
    return _run_live(spark, replies, "replies")


# --- versions in time, counted differences, sketches, exports of any shape ------

def _spans(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("signup"), F.col("ts").alias("span_from"),
        (F.col("ts") + F.expr("interval 36 hours")).alias("span_to"))


def q_validity(spark, sf):
    return intervals.validity(_events(spark, sf), ["event_type"], EVENTS)


def q_overlapping(spark, sf):
    events = _events(spark, sf)
    held = intervals.validity(events, ["event_type"], EVENTS).select(
        "user_id", "event_id", "event_type", "valid_from", "valid_to")
    return intervals.overlapping(held, _spans(events), ["user_id"])


def q_counted_difference(spark, sf):
    """who did what on which day, in January and February"""
    events = _events(spark, sf).withColumn("weekday", F.dayofweek("ts"))
    return compare.counted_difference(
        events.where(F.month("ts") == 1), events.where(F.month("ts") != 1),
        ["event_type", "weekday", "user_id"])


def q_merged_sketches(spark, sf):
    """all days; estimates are told as right or wrong by a bound of six in a hundred"""
    events = _events(spark, sf)
    told = sketches.merge_sketches(
        sketches.daily_sketches(events, ["event_type"], "ts", "user_id"), ["event_type"])
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return told.join(exact, "event_type").select(
        "event_type", "n", (F.abs(F.col("people") - F.col("exact")) <= 0.06 * F.col("exact")
                            ).cast("int").alias("close"))


def q_parse_any_export(spark, sf):
    """props as they are for half of the events, as a list or text for others, cut short for some"""
    events = _events(spark, sf).select("event_id", F.expr(_MIXED).alias("props"))
    return any_export.parse_any_export(events, "props", {
        "k": ("$.k", "int"), "first": ("$[0].k", "int")})[0].select("event_id", "k", "first")


def q_parse_any_export_rejects(spark, sf):
    events = _events(spark, sf).select("event_id", F.expr(_MIXED).alias("props"))
    return any_export.parse_any_export(events, "props", {})[1].groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


# --- composed ----------------------------------------------------------------

def q_worth_reading(spark, sf):
    return worth_reading(_messages(spark, sf), WEIGHTS, 10, PART)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
    if training_data is None:
        return own
    return own | training_data.queries() | {"pipeline": corpus_pipeline.run}


# --- the same in SQL ---------------------------------------------------------

_WORDS = r"""words AS (
  SELECT * FROM (SELECT conv_id, turn, unnest(
    regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM conversations)
  WHERE term <> '')"""

_SCORED = """scored AS (
  SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS authors,
         sum(length(text))::bigint AS chars,
         round(0.4::double * least(count(*) / 8.0::double, 1.0::double)
             + 0.2::double * least(count(DISTINCT role) / 3.0::double, 1.0::double)
             + 0.4::double * least(sum(length(text))::bigint / 4000.0::double, 1.0::double), 4)
           AS score
  FROM conversations GROUP BY conv_id)"""

_VERSIONS = """
  SELECT event_id, ts, user_id, event_type, value, props FROM (
    SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS rn FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE rn = 1 OR before IS DISTINCT FROM event_type"""

_VALIDITY = f"""
  SELECT *, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
  FROM ({_VERSIONS})"""

_STATES_AT = """
  WITH last AS (SELECT user_id AS who, ts AS at, max(event_id) AS id FROM events GROUP BY ALL),
  asked AS (SELECT user_id, ts + INTERVAL 90 MINUTE AS moment FROM events
            WHERE event_type = 'purchase')
  SELECT a.user_id, a.moment, e.event_id, e.ts, e.event_type, e.value, e.props
  FROM asked a ASOF LEFT JOIN last l ON a.user_id = l.who AND a.moment >= l.at
  LEFT JOIN events e ON e.event_id = l.id"""

_SESSIONS = """numbered AS (
  SELECT * EXCLUDE (fresh),
         (sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id
                           ROWS UNBOUNDED PRECEDING) - 1)::bigint AS session_no
  FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR
                       THEN 1 ELSE 0 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""

_SESSION_WINDOWS = f"""{_SESSIONS}, sessions AS (
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
         count(*) AS n FROM numbered GROUP BY user_id, session_no)"""

_PAIRS = """
  SELECT conv_id, turn AS question_turn, next_turn AS answer_turn FROM (
    SELECT *, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'"""

_KEY_TERMS = f"""
  WITH {_WORDS},
  tf AS (SELECT conv_id, term, count(*) AS tf FROM words GROUP BY conv_id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(DISTINCT conv_id)::double AS n FROM conversations),
  ranked AS (
    SELECT conv_id, term, row_number() OVER (
      PARTITION BY conv_id ORDER BY round(tf * ln(n / df), 4) DESC, term) AS rk
    FROM tf JOIN df USING (term), n)
  SELECT conv_id, term, rk FROM ranked WHERE rk <= 5"""

_SUMMARY = f"""
  WITH {_WORDS},
  df AS (SELECT term, count(DISTINCT conv_id) AS df FROM words GROUP BY term),
  n AS (SELECT count(DISTINCT conv_id)::double AS n FROM conversations),
  turns AS (SELECT conv_id, turn, round(avg(ln(n / df)), 4) AS score
            FROM words JOIN df USING (term), n GROUP BY conv_id, turn),
  ranked AS (SELECT conv_id, turn, row_number() OVER (
               PARTITION BY conv_id ORDER BY score DESC, turn) AS rk FROM turns)
  SELECT conv_id, turn, rk FROM ranked WHERE rk <= 2"""

_DAMAGED = """damaged AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, 4)
                        WHEN event_type = 'signup' THEN '  '
                        WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN props || props
                        WHEN event_type = 'purchase' AND user_id % 3 = 1 THEN props || ']'
                        WHEN event_type <> 'view' THEN props END AS raw FROM events)"""

_LINES = """lines AS (
  SELECT unnest(string_split('<' || role || '> ' || text, chr(10))) AS value
  FROM conversations)"""


def _rank(at_or_before: str, source: str = "events") -> str:
    return f"""SELECT event_id, ts, user_id, event_type, value, props FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM {source} WHERE ts <= TIMESTAMP '{at_or_before}') WHERE rn = 1"""


# DuckDB has no look-behind; without it the pattern finds the same, only slower
_SQL_RULES = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}", "[EMAIL]"),
              *[rule[:2] for rule in DEFAULT_RULES[1:]]]


def _sql_replace() -> str:
    out = "text"
    for pattern, tag in _SQL_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{tag}', 'g')"
    return out


def _sql_transcript(part: int, source: str = "conversations") -> str:
    return f"""SELECT conv_id, turn // {part} AS part,
      string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body
    FROM {source} GROUP BY conv_id, turn // {part}"""


def _stand_in(col: str) -> str:
    return f"substr(sha256('{SALT}|' || {col}::varchar), 1, 16)"


def oracle_sql() -> dict[str, str]:
    own = _own_sql()
    if training_data is None:
        return own
    piped = corpus_pipeline.ORACLE_SQL
    return own | training_data.oracle_sql() | ({"pipeline": piped} if piped else {})


def _own_sql() -> dict[str, str]:
    rule_counts = ", ".join(
        f"count(*) FILTER (regexp_matches(text, '{p}')) AS {name}"
        for name, (p, _) in zip(RULES, _SQL_RULES))
    return {
        "to_messages": """
          SELECT NULL::varchar AS space_id, conv_id, turn AS seq, role AS author,
                 NULL::timestamp AS ts, text FROM conversations""",
        "parse_json_export": f"""
          WITH {_DAMAGED} SELECT event_id, raw, (raw::json->>'k')::bigint AS k FROM damaged
          WHERE raw IS NOT NULL AND trim(raw) <> '' AND json_valid(raw)""",
        "parse_json_export_rejects": f"""
          WITH {_DAMAGED} SELECT raw, CASE WHEN raw IS NULL THEN 'null'
            WHEN trim(raw) = '' THEN 'blank' ELSE 'malformed' END AS reason FROM damaged
          WHERE raw IS NULL OR trim(raw) = '' OR NOT json_valid(raw)""",
        "parse_line_log": rf"""
          WITH {_LINES} SELECT regexp_extract(value, '{LINE}', 1) AS author,
            regexp_extract(value, '{LINE}', 2) AS said FROM lines
          WHERE regexp_matches(value, '{LINE}')""",
        "parse_line_log_rejects": rf"""
          WITH {_LINES} SELECT value FROM lines WHERE NOT regexp_matches(value, '{LINE}')""",
        "public_only": """
          SELECT * FROM documents WHERE source IN (
            SELECT source FROM documents GROUP BY source HAVING avg(n_chars) > 2400)""",
        "public_only_other_type": """
          SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
        "stream_intake": "SELECT * FROM events",
        "append_captures": "SELECT * FROM events",
        "append_captures_close_times": """
          SELECT * FROM events UNION ALL
          SELECT * REPLACE (ts + INTERVAL 1 MICROSECOND AS ts) FROM events""",
        "capture_run": """
          SELECT *, ts::date AS day FROM events WHERE event_type <> 'click' AND user_id NOT IN (
            SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 2 = 0)""",
        "remove_from_archive": """
          SELECT *, ts::date AS day FROM events WHERE user_id NOT IN (
            SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 5 = 0)""",
        "remove_from_archive_text_partitions": f"""
          SELECT *, {_ROOM} AS room FROM events WHERE user_id NOT IN (
            SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 5 = 0)""",
        "lay_out_archive": f"SELECT *, {_ROOM} AS room FROM events",
        "capture_live": "SELECT *, ts::date AS day FROM events",
        "states_at": _STATES_AT,
        "states_at_busy_keys": _STATES_AT,
        "as_of": _rank("2024-01-15 12:00:00"),
        "nearest_capture": """
          SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), event_id) AS rn
            FROM events) WHERE rn = 1""",
        "versions": _VERSIONS,
        "versions_busy_keys": _VERSIONS,
        "snapshot_diff": f"""
          WITH a AS ({_rank("2024-01-02 00:00:00")}),
          b AS ({_rank("2024-02-01 00:00:00", """(SELECT * FROM events WHERE user_id NOT IN (
                         SELECT user_id FROM events WHERE value > 480))""")})
          SELECT coalesce(a.user_id, b.user_id) AS user_id,
            CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed'
                 WHEN a.event_type IS NOT DISTINCT FROM b.event_type THEN 'same'
                 ELSE 'changed' END AS status
          FROM a FULL JOIN b ON a.user_id = b.user_id""",
        "capture_calendar": """
          SELECT user_id, ts::date AS day, count(*) AS n FROM events GROUP BY user_id, ts::date""",
        "gap_report": """
          WITH span AS (SELECT user_id, min(ts::date) AS a, max(ts::date) AS b
                        FROM events GROUP BY user_id),
          days AS (SELECT user_id, unnest(generate_series(a::timestamp, b::timestamp,
                     INTERVAL 1 DAY))::date AS day FROM span)
          SELECT user_id, day FROM days
          EXCEPT SELECT user_id, ts::date FROM events""",
        "write_archive": "SELECT *, ts::date AS day FROM events",
        "discussion_stats": """
          SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS authors,
                 sum(length(text))::bigint AS chars FROM conversations GROUP BY conv_id""",
        "value_score": f"WITH {_SCORED} SELECT * FROM scored",
        "top_discussions": f"""
          WITH {_SCORED} SELECT * FROM scored ORDER BY score DESC, conv_id LIMIT 20""",
        "top_discussions_per_group": f"""
          WITH {_SCORED} SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY authors ORDER BY score DESC, conv_id) AS rk FROM scored) WHERE rk <= 5""",
        "term_filter": f"""
          WITH {_WORDS}, vocabulary AS (
            SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(
              lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark)
            WHERE length(term) >= 5)
          SELECT conv_id, count(DISTINCT term) AS terms FROM words SEMI JOIN vocabulary USING (term)
          GROUP BY conv_id HAVING count(DISTINCT term) >= 3""",
        "dedupe_exact": """
          SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""",
        "sessionize": f"WITH {_SESSIONS} SELECT * FROM numbered",
        "sessionize_busy_keys": f"WITH {_SESSIONS} SELECT * FROM numbered",
        "discussions_from_log": """
          SELECT user_id::varchar AS space_id, event_type AS author, ts, props AS text,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
          FROM events""",
        "discussions_from_log_busy_keys": f"""
          WITH {_SESSIONS} SELECT count(*) AS turns, count(DISTINCT event_type) AS authors,
            sum(length(props))::bigint AS chars FROM numbered GROUP BY user_id, session_no""",
        "pair_replies": _PAIRS,
        "pair_replies_busy_keys": _PAIRS,
        "key_terms": _KEY_TERMS,
        "key_terms_busy_words": _KEY_TERMS,
        "extract_summary": _SUMMARY,
        "extract_summary_busy_words": _SUMMARY,
        "pseudonymise": f"""
          SELECT * REPLACE ({_stand_in("user_id")} AS user_id) FROM events""",
        "redact": f"SELECT * REPLACE ({_sql_replace()} AS text) FROM documents",
        "sensitive_report": f"SELECT source, {rule_counts} FROM documents GROUP BY source",
        "honour_removals": """
          SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
        "honour_removals_long_list": """
          SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
        "credit_report": f"""
          SELECT {_stand_in("role")} AS author, count(*) AS messages,
                 sum(length(text))::bigint AS chars, count(DISTINCT conv_id) AS discussions
          FROM conversations GROUP BY 1""",
        "transcript": _sql_transcript(consume.PART_TURNS),
        "transcript_in_parts": _sql_transcript(PART),
        "nested_export": f"""
          SELECT conv_id, turn // {PART} AS part, to_json(list(
            {{'seq': turn, 'author': role, 'text': text}} ORDER BY turn))::varchar AS json
          FROM conversations GROUP BY conv_id, turn // {PART}""",
        "nested_export_array": """
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
                 turn AS seq, role AS author, text FROM conversations""",
        "keyword_search_any": f"""
          WITH {_WORDS} SELECT conv_id, count(DISTINCT term) AS terms, count(*) AS hits
          FROM words WHERE term IN ('the', 'que', 'der') GROUP BY conv_id""",
        "keyword_search_all": f"""
          WITH {_WORDS} SELECT conv_id, count(DISTINCT term) AS terms, count(*) AS hits
          FROM words WHERE term IN ('le', 'de', 'la') GROUP BY conv_id
          HAVING count(DISTINCT term) = 3""",
        "keyword_search_phrases": f"""
          WITH said AS (SELECT conv_id, list_filter(regexp_split_to_array(
                 lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM conversations),
          hits AS (
            SELECT conv_id, 'the' AS term, len(list_filter(w, lambda x: x = 'the')) AS n FROM said
            UNION ALL SELECT conv_id, 'of the', len(list_filter(range(1, len(w)),
              lambda i: w[i] = 'of' AND w[i + 1] = 'the')) FROM said
            UNION ALL SELECT conv_id, 'de la', len(list_filter(range(1, len(w)),
              lambda i: w[i] = 'de' AND w[i + 1] = 'la')) FROM said)
          SELECT conv_id, count(DISTINCT term) AS terms, sum(n)::bigint AS hits
          FROM hits WHERE n > 0 GROUP BY conv_id""",
        "hit_context": """
          WITH hits AS (SELECT conv_id, turn AS hit FROM conversations
                        WHERE contains(lower(text), 'the'))
          SELECT m.conv_id, h.hit, m.turn AS seq, m.role AS author, m.text
          FROM conversations m JOIN hits h
            ON m.conv_id = h.conv_id AND m.turn BETWEEN h.hit - 1 AND h.hit + 1""",
        "activity_rollup": """
          SELECT event_type, ts::date AS day, count(*) AS n,
                 grouping_id(event_type, ts::date)::bigint AS gid
          FROM events GROUP BY ROLLUP (event_type, ts::date)""",
        "register_views": """
          SELECT role AS author, max(turn) AS last_turn, count(*) AS n
          FROM conversations GROUP BY role""",
        "activity_windows": """
          SELECT date_trunc('day', ts) AS window_start,
                 date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n
          FROM events GROUP BY 1, 2, 3""",
        "stream_activity": """
          SELECT * FROM (
            SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start,
                   time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
                   event_type, count(*) AS n
            FROM events GROUP BY 1, 2, 3)
          WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
        "session_windows": f"WITH {_SESSION_WINDOWS} SELECT * FROM sessions",
        "session_windows_busy_keys": f"WITH {_SESSION_WINDOWS} SELECT * FROM sessions",
        "stream_sessions": f"""
          WITH {_SESSION_WINDOWS} SELECT * FROM sessions
          WHERE session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
        "stream_sessions_busy_rooms": f"""
          WITH {_SESSION_WINDOWS} SELECT * FROM sessions WHERE session_end <= (
            SELECT max(first) - INTERVAL 6 HOUR FROM (
              SELECT min(ts) AS first FROM events
              GROUP BY user_id, time_bucket(INTERVAL 6 HOUR, ts)
              HAVING any_value(time_bucket(INTERVAL 6 HOUR, ts)) + INTERVAL 6 HOUR
                     <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)))""",
        "stream_replies": """
          SELECT q.user_id, q.event_id AS question, q.ts AS asked_at,
                 a.answer.id AS answer, a.answer.at AS answered_at
          FROM events q LEFT JOIN (
            SELECT q.event_id AS question, min({'at': a.ts, 'id': a.event_id}) AS answer
            FROM events q JOIN events a ON a.user_id = q.user_id AND a.ts > q.ts
                 AND a.ts <= q.ts + INTERVAL 12 HOUR
            WHERE q.event_type = 'click' AND a.event_type = 'purchase'
            GROUP BY q.event_id) a ON a.question = q.event_id
          WHERE q.event_type = 'click'
            AND q.ts + INTERVAL 12 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
        "validity": _VALIDITY,
        "overlapping": f"""
          WITH v AS ({_VALIDITY}), s AS (
            SELECT user_id, event_id AS signup, ts AS span_from,
                   ts + INTERVAL 36 HOUR AS span_to FROM events WHERE event_type = 'signup')
          SELECT v.user_id, v.event_id, v.event_type, v.valid_from, v.valid_to, s.signup,
                 s.span_from, s.span_to
          FROM v JOIN s ON v.user_id = s.user_id AND v.valid_from < s.span_to
               AND (v.valid_to IS NULL OR v.valid_to > s.span_from)
               AND (v.valid_to IS NULL OR v.valid_to > v.valid_from)""",
        "counted_difference": """
          SELECT event_type, (dayofweek(ts) + 1)::int AS weekday, user_id,
                 count(*) FILTER (WHERE month(ts) = 1) AS in_a,
                 count(*) FILTER (WHERE month(ts) <> 1) AS in_b
          FROM events GROUP BY 1, 2, 3""",
        "merged_sketches": """
          SELECT event_type, count(*) AS n, 1 AS close FROM events GROUP BY event_type""",
        "parse_any_export": """
          SELECT event_id,
                 CASE WHEN event_id % 4 > 1 THEN (props ->> '$.k')::int END AS k,
                 CASE WHEN event_id % 4 = 0 THEN (props ->> '$.k')::int END AS first
          FROM events WHERE event_id % 4 <> 1 AND props IS NOT NULL""",
        "parse_any_export_rejects": """
          SELECT CASE WHEN props IS NULL THEN 'null' ELSE 'malformed' END AS reason,
                 count(*) AS n
          FROM events WHERE props IS NULL OR event_id % 4 = 1 GROUP BY 1""",
        "worth_reading": f"""
          WITH {_SCORED},
          best AS (SELECT conv_id, score FROM scored ORDER BY score DESC, conv_id LIMIT 10),
          chosen AS (SELECT c.* FROM conversations c SEMI JOIN best USING (conv_id))
          SELECT t.conv_id, t.part, best.score, t.body
          FROM ({_sql_transcript(PART, "chosen")}) t JOIN best USING (conv_id)""",
    }
