"""Column expressions that hide people and secrets.

None of them finds names written in free text.  Patterns only catch what
they describe, and a stand-in for an author does not change what others wrote.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``tag`` replaces what ``pattern`` finds.  ``needs`` is a piece of text without which
    the pattern cannot match; looking for it first is far cheaper."""

    pattern: str
    tag: str
    needs: str | None = None


# Fixed values, in the order they are applied.  An address may only begin where a run of
# its characters begins or the last address ended; looking from every character of a long
# run would take time in the square of its length.
DEFAULT_RULES: list[Rule] = [
    Rule(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
         r"@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}", "[EMAIL]", "@"),
    Rule(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP]"),
    Rule(r'token = "[^"]*"', "[TOKEN]", 'token = "'),
    Rule(r"\b[0-9]{16}\b", "[NUMBER]"),
]


def stand_in(col: str, salt: str, digits: int = 16) -> Column:
    """First ``digits`` hex digits of a salted SHA-256; null stays null.

    Ids are few enough to try them all, so the salt must stay secret.
    """
    return F.substring(
        F.sha2(F.concat(F.lit(salt), F.lit("|"), F.col(col).cast("string")), 256), 1, digits)


def masked(col: str, rule: Rule) -> Column:
    replaced = F.regexp_replace(col, F.lit(rule.pattern), F.lit(rule.tag))
    if rule.needs is None:
        return replaced
    return F.when(F.col(col).contains(rule.needs), replaced).otherwise(F.col(col))


def matches(col: str, rule: Rule) -> Column:
    found = F.col(col).rlike(rule.pattern)
    return found if rule.needs is None else F.col(col).contains(rule.needs) & found


def as_json(*cols: str) -> Column:
    """The named columns as text that tells any two values apart, times to the microsecond."""
    return F.to_json(F.struct(*cols), {
        "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def digest(*cols: str) -> Column:
    """SHA-256 over the named columns as 32 bytes; nulls count as content.

    Never null, and declared so: a join on it then needs no null filter, which
    would compute the digest a second time.
    """
    return F.coalesce(F.unhex(F.sha2(as_json(*cols), 256)), F.lit(b""))
