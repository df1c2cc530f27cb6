"""Bring chat-like tables, JSON exports and plain line logs into one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquary.plans.skew import keep_listed
from colloquary.schemas import MESSAGES

_PARSED = "__parsed"
_BROKEN = "__broken"
_ONLY, _END = "__only", "__end"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of a plain log, column ``value``."""
    return spark.read.text(path)


def to_messages(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Project a table onto the messages shape.

    ``mapping`` goes from message column to source column; what it leaves out
    becomes a null of the right type.  A discussion's id may be text: a number as it is usually
    written stays that number, anything else ("007", " 7") becomes its hash.  A time may be a number of seconds or
    milliseconds since 1970 (UTC, which the session's zone is).
    """
    unknown = set(mapping) - set(MESSAGES.names)
    if unknown:
        raise ValueError(f"not message columns: {sorted(unknown)}")

    def column(field: T.StructField) -> Column:
        source = mapping.get(field.name)
        kind = df.schema[source].dataType if source else None
        if field.name == "conv_id" and isinstance(kind, T.StringType):
            number = F.col(source).try_cast("bigint")
            same = number.cast("string") == F.col(source)
            return F.when(F.col(source).isNotNull(), F.when(same, number).otherwise(
                F.xxhash64(source))).alias("conv_id")
        if field.name == "ts" and isinstance(kind, T.NumericType):
            # no conversation was held before 1973 in milliseconds or after 5138 in seconds
            seconds = F.when(F.abs(F.col(source)) >= 10**11, F.col(source) / 1000.0).otherwise(
                F.col(source))
            return F.timestamp_micros((seconds * 1_000_000).try_cast("bigint")).cast(
                "timestamp_ntz").alias("ts")
        if source == field.name and kind == field.dataType:
            return F.col(source)
        return (F.col(source) if source else F.lit(None)).cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in MESSAGES.fields])


def parse_json_export(df: DataFrame, col: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Fields of a JSON text column, and the rows that have none.

    Rejects are ``raw`` and ``reason``: null, blank or malformed.  Blank text is
    told apart before parsing, because it parses to nothing without a complaint.  A second
    object or anything else behind the first makes a row malformed: the text is parsed as
    an element of an array, which must then have just this one, with the array's own end
    where it was put.
    """
    full = T.StructType([
        T.StructField(_ONLY, T.ArrayType(schema)), T.StructField(_END, T.BooleanType()),
        T.StructField(_BROKEN, T.StringType())])
    framed = F.concat(F.lit(f'{{"{_ONLY}":['), F.col(col), F.lit(f'],"{_END}":true}}'))
    # as the output of explode the text is parsed once; a plain column would be moved
    # into the filters below and parsed again for each mention
    parsed = df.select("*", F.explode(F.array(F.from_json(
        framed, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))).alias(_PARSED))
    one = (F.col(f"{_PARSED}.{_BROKEN}").isNull() & F.col(f"{_PARSED}.{_END}")
           & (F.size(f"{_PARSED}.{_ONLY}") == 1) & F.col(f"{_PARSED}.{_ONLY}")[0].isNotNull())
    reason = (F.when(F.col(col).isNull(), "null")
              .when(~F.col(col).rlike(r"\S"), "blank")
              .when(~F.coalesce(one, F.lit(False)), "malformed"))
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where(F.col("reason").isNull()).select(
        *df.columns, *[F.col(f"{_PARSED}.{_ONLY}")[0][f].alias(f) for f in schema.names])
    rejects = parsed.where(F.col("reason").isNotNull()).select(F.col(col).alias("raw"), "reason")
    return good, rejects


def parse_line_log(df: DataFrame, pattern: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Columns from lines (column ``value``), one capture group per name; rejects keep ``value``."""
    # a null line matches nothing and is a reject
    fits = F.coalesce(F.col("value").rlike(pattern), F.lit(False))
    good = df.where(fits).select(*[
        F.regexp_extract("value", pattern, i).alias(n) for i, n in enumerate(names, 1)])
    return good, df.where(~fits).select("value")


def public_only(df: DataFrame, spaces: DataFrame, key: str) -> DataFrame:
    """Rows whose space is on the public list."""
    return keep_listed(df, spaces, key)
