"""JSON exports whose shape is not known beforehand, or differs from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA = "__data"


def _whole(col: str) -> Column:
    """The text as a variant, null unless it is one JSON value and nothing else.

    The parser stops behind the first value, so the text is put between brackets and between
    braces: what goes on behind its value can be right in one of them at most, or makes the
    list longer.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(col), F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"a":'), F.col(col), F.lit("}")))
    more = F.try_variant_get(listed, "$[1]", "variant")
    return F.when(named.isNotNull() & more.isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def parse_any_export(df: DataFrame, col: str, fields: dict[str, tuple[str, str]]
                     ) -> tuple[DataFrame, DataFrame]:
    """Fields of a JSON text column, whatever else is in it, and the rows that are no JSON.

    ``fields`` maps a name to (path, type), such as ``("$.sender.name", "string")``.  A path that
    is missing, or holds what can't be of that type, gives null.  Rejects are ``raw`` and
    ``reason``: null, blank or malformed; anything behind the value is malformed.  The text
    becomes a variant once (``_whole``), and both frames and all fields read from that.
    """
    # as the output of explode it isn't parsed again for each mention
    parsed = df.select("*", F.explode(F.array(_whole(col))).alias(DATA))
    reason = (F.when(F.col(col).isNull(), "null")
              .when(~F.col(col).rlike(r"\S"), "blank")
              .when(F.col(DATA).isNull(), "malformed"))
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where(F.col("reason").isNull()).select(*df.columns, *[
        F.try_variant_get(DATA, path, kind).alias(name) for name, (path, kind) in fields.items()])
    rejects = parsed.where(F.col("reason").isNotNull()).select(F.col(col).alias("raw"), "reason")
    return good, rejects


def export_shape(df: DataFrame, col: str, by: list[str] = []) -> DataFrame:
    """The common schema of a JSON text column's rows, per group: ``by, shape, n``.  Rows that
    are no JSON are left out.  Only schemas travel, not texts."""
    parsed = df.select(*by, _whole(col).alias(DATA)).where(F.col(DATA).isNotNull())
    told = [F.schema_of_variant_agg(DATA).alias("shape"), F.count(F.lit(1)).alias("n")]
    return parsed.groupBy(*by).agg(*told)
