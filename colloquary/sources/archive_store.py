"""The durable copy: Parquet partitioned by one column, its rewriting, and plain sinks.

A stored archive is a folder of partitions.  Two things about it are settled here:

* **Types.**  Spark guesses the type of a partition value from its folder's name, so the text
  "007" would come back as 7.  ``read_archive`` takes the types from the caller, or leaves
  partition values text.
* **Rewriting.**  ``rewrite_archive`` replaces whole partitions so that a run may be killed
  between any two steps: what is to be there is written beside the archive, then listed in a
  journal, and only then put in place.  The next call, or ``recover_archive``, finishes a run
  whose journal is complete and throws away one whose journal is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquary.plans.skew import drop_listed, keep_listed

INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"
NOTHING = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's folder for null
ASIDE = "_rewrite"  # folders that begin so are no part of a table to Spark


def write_archive(df: DataFrame, path: str, by: str) -> None:
    """Append ``df`` to the archive at ``path``, partitioned by ``by``.

    The rebalance hint gathers each partition value into few files and lets
    adaptive execution split a value that holds much of the data.  An empty text as a
    partition value is null when read back, which is Spark's way.
    """
    (df.hint("rebalance", by)
     .write.partitionBy(by).mode("append").parquet(path))


def read_archive(spark: SparkSession, path: str, by: str,
                 schema: T.StructType | None = None) -> DataFrame:
    """The archive at ``path`` with ``by`` in the type that ``schema`` gives it, else as text."""
    if schema is None:
        schema = _stored(spark, path, by).schema
    return spark.read.schema(schema).parquet(path)


def _stored(spark: SparkSession, path: str, by: str) -> DataFrame:
    """With partition values as text, however they look."""
    guess = spark.conf.get(INFERENCE, "true")
    spark.conf.set(INFERENCE, "false")
    try:
        found = spark.read.parquet(path)
    finally:
        spark.conf.set(INFERENCE, guess)
    if by not in found.columns:
        raise ValueError(f"{path} is not partitioned by {by}")
    return found


class _Files:
    """The file system of an archive: the few calls that DataFrames have no word for."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        root = self._path(path)
        self._system = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def there(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.there(path):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._path(path)))

    def move(self, old: str, new: str) -> None:
        if not self._system.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)

    def folder(self, path: str) -> None:
        self._system.mkdirs(self._path(path))


def rewrite_archive(spark: SparkSession, path: str, by: str,
                    touched: Callable[[DataFrame], DataFrame],
                    rewrite: Callable[[DataFrame], DataFrame],
                    key: str | None = None,
                    step: Callable[[str], None] = lambda name: None) -> int:
    """Replace every partition that has a row of ``touched(archive)`` by ``rewrite`` of it, and
    return how many were.  Both functions are given ``by`` as text.  With ``key``, the new files
    are laid out for it (``lay_out_archive``).

    In order, each step safe to repeat:

    1. what an earlier run left is finished or thrown away (``recover_archive``);
    2. the new partitions are written to ``_rewrite-…/new``;
    3. the journal, the names of all touched folders, is written to ``_rewrite-…/plan``.  From
       here on the run will be finished by whoever comes next;
    4. folder by folder, the old one is moved to ``_rewrite-…/old`` and the new one, if
       anything of it is left, to its place.

    Readers may see a partition as missing between the two moves of step 4, never doubled or
    half new.  One writer at a time, on a file system that moves folders in one step.
    ``step`` is told each step's name (tests break off there).
    """
    recover_archive(spark, path, step)
    stored = _stored(spark, path, by)
    aside = f"{path.rstrip('/')}/{ASIDE}-{uuid.uuid4().hex}"
    concerned = touched(stored).select(by).distinct()
    concerned.write.parquet(f"{aside}/touched")
    step("touched")
    concerned = spark.read.schema(concerned.schema).parquet(f"{aside}/touched")
    files = _Files(spark, path)
    if concerned.isEmpty():
        files.delete(aside)
        return 0
    mark = concerned.select(F.col(by).alias("__by"))
    # null-safe, because rows without a value are a partition too
    inside = stored.join(mark, stored[by].eqNullSafe(mark["__by"]), "left_semi")
    _written(rewrite(inside), by, key).parquet(f"{aside}/new")
    step("new")
    _plan(by, concerned, aside)
    step("plan")
    return _swap(spark, path, aside, step)


def _written(rows: DataFrame, by: str, key: str | None) -> DataFrameWriter:
    if key is None:
        return rows.hint("rebalance", by).write.partitionBy(by)
    # ranges of the key within each partition; adaptive execution joins small ones, and a key
    # that holds much of the data is one range, spread over row groups
    ranged = rows.repartitionByRange(by, key).sortWithinPartitions(by, key)
    return ranged.write.partitionBy(by).option(f"parquet.bloom.filter.enabled#{key}", "true")


def _plan(by: str, concerned: DataFrame, aside: str) -> None:
    """The journal, complete once it is there at all: Spark commits a table's files, and the
    mark of success after them."""
    names = _named(by, F.col(by)).alias("folder")
    concerned.select(names).distinct().coalesce(1).write.text(f"{aside}/plan")


def _named(by: str, value: Column) -> Column:
    """How Spark names the folder of a partition value."""
    # fixed values: the characters that are written as % and two hexadecimal digits
    odd = "".join(map(chr, [*range(1, 32), 127])) + "\"#%'*/:=?\\{[]^"
    told = value
    for c in ["%", *[c for c in odd if c != "%"]]:
        told = F.replace(told, F.lit(c), F.lit(f"%{ord(c):02X}"))
    told = F.when(value.isNull() | (value == ""), F.lit(NOTHING)).otherwise(told)
    return F.concat(F.lit(f"{by}="), told)


def _swap(spark: SparkSession, path: str, aside: str, step: Callable[[str], None]) -> int:
    """Step 4, from the journal; again for what is not done yet, if need be."""
    files, root = _Files(spark, path), path.rstrip("/")
    folders = [r["value"] for r in spark.read.text(f"{aside}/plan").toLocalIterator()]
    files.folder(f"{aside}/old")
    for name in folders:
        old, new, kept = f"{root}/{name}", f"{aside}/new/{name}", f"{aside}/old/{name}"
        # once the old one is aside, what stands in its place is new
        if not files.there(kept) and files.there(old):
            files.move(old, kept)
            step(f"out {name}")
        if files.there(new):
            files.move(new, old)
            step(f"in {name}")
    step("swapped")
    # the journal first: without it, what else is left is only thrown away
    files.delete(f"{aside}/plan")
    step("forgotten")
    files.delete(aside)
    spark.catalog.refreshByPath(path)
    return len(folders)


def recover_archive(spark: SparkSession, path: str,
                    step: Callable[[str], None] = lambda name: None) -> None:
    """Finish what a rewrite that broke off had in its journal, or throw away what it had not
    got so far with."""
    files, root = _Files(spark, path), path.rstrip("/")
    for name in files.names(root):
        if name.startswith(ASIDE):
            aside = f"{root}/{name}"
            if files.there(f"{aside}/plan/_SUCCESS"):
                _swap(spark, path, aside, step)
            else:
                files.delete(aside)


def lay_out_archive(spark: SparkSession, path: str, by: str, key: str, files: int = 2) -> int:
    """Rewrite the partitions of at least ``files`` files, crash-safe, so that few files and row
    groups hold any one ``key``; returns how many partitions were.

    Appending leaves many small files, each with all keys.  Within a partition rows come to lie
    in ranges of the key, sorted, so that the least and largest key of a row group tell most of
    them apart, and a Bloom filter per row group the rest; reading one key skips the others.
    """
    def crowded(stored: DataFrame) -> DataFrame:
        at = stored.select(by, F.input_file_name().alias("__file")).distinct()
        return at.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= files)

    return rewrite_archive(spark, path, by, crowded, lambda rows: rows, key)


def remove_from_archive(spark: SparkSession, path: str, by: str, removals: DataFrame,
                        key: str) -> None:
    """Take everything by or about those on the list out of the archive at ``path``, which is
    partitioned by ``by``.

    Only partitions that hold such rows are written anew, crash-safe (``rewrite_archive``).
    """
    rewrite_archive(spark, path, by, lambda rows: keep_listed(rows, removals, key),
                    lambda rows: drop_listed(rows, removals, key))


def last_batch(spark: SparkSession, path: str, name: str) -> int:
    """Number of the last batch of the stream ``name`` that is in the archive, or -1."""
    return max(map(int, _Files(spark, path).names(f"{path.rstrip('/')}/_live-{name}")),
               default=-1)


def note_batch(spark: SparkSession, path: str, name: str, number: int) -> None:
    files, notes = _Files(spark, path), f"{path.rstrip('/')}/_live-{name}"
    before = files.names(notes)
    files.folder(f"{notes}/{number}")
    for old in before:
        if int(old) < number:
            files.delete(f"{notes}/{old}")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, for programs."""
    df.write.mode("append").json(path)
