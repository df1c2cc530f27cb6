"""What the operators of this package share: tables, scratch tables, batches, words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquary.session import shared_folder

# Fixed value: a word is a run of characters outside this class.  ``bytes.split`` without
# arguments cuts at exactly these characters, ``str.split`` at many more.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

TABLE_BITS = 26  # 8 MB


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = "2000", str(8 << 20)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and hand them
    batches of fewer rows and bytes than Spark's usual 10,000 and 64 MB or more: texts are
    long."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size, "10000") == "10000":
        spark.conf.set(size, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    The plan starts anew from files that every executor can read, so nothing
    behind it is computed twice, nor again after an executor is lost.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """``mapInArrow`` with the package importable in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def give_back() -> None:
    """Return freed memory to the machine; workers are reused, and allocators keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


# what modules remember from one task to the next
remembered: list[Callable[[], None]] = []


def make_room(but: Callable | None = None) -> None:
    """Drop what a reused worker still remembers, ``but`` for one, when it is to do other work."""
    for forget in remembered:
        if forget != but:
            forget()
    give_back()


def rows(batches: Iterator[pa.RecordBatch], step: int = 128) -> Iterator[list[list]]:
    """Columns of Python values, ``step`` rows at a time, so that long texts don't pile up."""
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield [column.to_pylist() for column in part.columns]


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(),
          "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(),
          "string": pa.string(), "binary": pa.binary()}
_TYPES |= {f"array<{name}>": pa.list_(kind) for name, kind in list(_TYPES.items())}


def arrow_schema(schema: str) -> pa.Schema:
    """``name type, …`` as workers need it, where no session can be asked."""
    pairs = [field.rsplit(" ", 1) for field in schema.split(", ")]
    return pa.schema([pa.field(name.strip("`"), _TYPES[kind]) for name, kind in pairs])


def bit_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a pair of numbers stands in a bit table."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the table, 64 to a row."""
    words = np.zeros(1 << TABLE_BITS - 6, dtype=np.uint64)
    for batch in batches:
        place = bit_place(*[c.to_numpy(zero_copy_only=False) for c in batch.columns])
        np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    set_ = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(set_, pa.int32()),
                                      pa.array(words[set_].view(np.int64))], names=["at", "bits"])


def bit_table(pairs: DataFrame, a: str = "doc", b: str = "line") -> np.ndarray:
    """Bytes of 2**TABLE_BITS bits with those of the pairs set: a test that lets through all
    of them and few others, whose size does not depend on how many there are."""
    marked = in_batches(pairs.select(a, b), _marked, "at int, bits bigint")
    table = np.zeros(1 << TABLE_BITS - 6, dtype="<i8")
    found = marked.groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # bounded
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint8)


def word_count(text: str | Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
