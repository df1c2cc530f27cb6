"""One capture run: what is public, not withdrawn and not yet held goes into the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colloquary.operators.archive import unseen_captures
from colloquary.operators.respect import honour_removals
from colloquary.sources.archive_store import write_archive
from colloquary.sources.intake import public_only


def capture_run(archive: DataFrame, new: DataFrame, spaces: DataFrame, removals: DataFrame,
                space: str, person: str, identity: list[str], content: list[str],
                path: str, by: str, within: str | None = None) -> None:
    """Append to the archive at ``path``, partitioned by ``by``.  A repeated run adds nothing.

    Where equal captures always fall into the same partition, ``within=by`` saves reading the
    others.
    """
    wanted = honour_removals(public_only(new, spaces, space), removals, person)
    write_archive(unseen_captures(archive, wanted, identity, content, within=within), path, by)
