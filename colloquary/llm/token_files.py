"""Operator 8: token ids in files, coded with a static range asymmetric numeral system.

How a corpus is written:

1. texts are encoded once; ids go to a scratch table as unsigned 16-bit integers;
2. ids are counted over the whole corpus and the counts scaled to a shared frequency table
   of 2**BITS, in which every id of the vocabulary has at least 1;
3. documents are put in ascending order by range partitions, and each partition is cut into
   blocks of whole documents, of about ``BLOCK`` ids or of one longer document;
4. each block is coded on its own by ``LANES`` interleaved states.

A token file is a folder with two Parquet tables, so that any store that Spark reaches will
do: ``table`` (token, frequency) and ``blocks``, one row per block::

    part, block      place in the order; parts and blocks count from 0
    first            ids of the part before this block
    doc_ids, sizes   documents of the block and their ids
    payload          the coded ids

The payload is little-endian: magic ``RANS``, ids (u64), lanes (u32), ids between two
checkpoints (u32), number of checkpoints (u32), crc32 of all that follows (u32); then for
each checkpoint the words before it (u64) and its states (u64 each); then the words (u32).
Id number i belongs to lane i mod lanes.  From every checkpoint decoding can start, so the
stretches between them are decoded side by side.

Null texts are empty and hold the end id alone.  Of rows that share a doc_id those with the
smaller hash of their ids come first.  An empty table gives a token file without blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquary.llm.common import arrow_schema, in_batches, keep, make_room, rows
from colloquary.llm.vocabularies import word_bpe

BITS = 18
LANES = 1024
EVERY = 1 << 18  # ids between checkpoints
BLOCK = 1 << 20  # ids
PART = 1 << 23  # ids a file holds, as long as that gives no more than PARTS files
PARTS = 1 << 16
END_ID = 1

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sQIIII")
_BITS = np.uint64(BITS)
_SLOT = np.uint64((1 << BITS) - 1)

_IDS = "doc_id bigint, n_tokens bigint, ids binary"
_BLOCKS = ("part int, block int, first bigint, doc_ids array<bigint>, sizes array<bigint>, "
           "payload binary")
_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class Table:
    """Shared frequencies, one for each id, that add up to 2**BITS."""

    def __init__(self, frequency: np.ndarray):
        assert frequency.sum() == 1 << BITS and frequency.min() > 0
        self.frequency = frequency.astype(np.uint64)
        self.before = (np.cumsum(frequency) - frequency).astype(np.uint64)
        self.id_at = np.repeat(np.arange(len(frequency), dtype=np.uint16), frequency)

    @staticmethod
    def scaled(counts: np.ndarray) -> Table:
        """The nearest table to the counts in which no id lacks a place."""
        room = (1 << BITS) - len(counts)
        assert room >= 0, "more ids than places"
        total = max(1, int(counts.sum()))
        share = 1 + (counts.astype(object) * room // total).astype(np.int64)
        share[int(np.argmax(counts))] += (1 << BITS) - int(share.sum())
        return Table(share)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """The payload of a block."""
    while lanes > 1 and lanes * 64 > len(ids):  # few ids don't pay for many states
        lanes //= 2
    every = max(1, every // lanes)
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    words, marks, written = [], [], 0
    for step in range(steps - 1, -1, -1):
        some = ids[step * lanes:(step + 1) * lanes]
        frequency, x = table.frequency[some], state[:len(some)]
        full = x >= frequency << np.uint64(63 - BITS)
        if full.any():
            out = x[full]
            words.append(out.astype("<u4"))
            written += len(out)
            x[full] = out >> _WORD
        whole = x // frequency
        x[:] = (whole << _BITS) + (x - whole * frequency) + table.before[some]
        if step % every == 0:
            marks.append((written, state.copy()))
    body = b"".join([struct.pack("<Q", written - left) + states.astype("<u8").tobytes()
                     for left, states in reversed(marks)]
                    + [w.tobytes() for w in reversed(words)])
    return _HEAD.pack(b"RANS", len(ids), lanes, every * lanes, len(marks), zlib.crc32(body)) + body


def decode(payload: bytes, table: Table) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints at the same time."""
    magic, size, lanes, every, marks, crc = _HEAD.unpack_from(payload)
    body = memoryview(payload)[_HEAD.size:]
    if magic != b"RANS" or zlib.crc32(body) != crc:
        raise ValueError("a block of the token file is damaged")
    if not size:
        return np.zeros(0, dtype=np.uint16)
    wide = 8 * (lanes + 1)
    places = np.frombuffer(body[:marks * wide], dtype="<u8").reshape(marks, lanes + 1)
    words = np.frombuffer(body[marks * wide:], dtype="<u4").astype(np.uint64)
    at, state = places[:, 0].astype(np.int64), places[:, 1:].astype(np.uint64)
    out = np.zeros(marks * every, dtype=np.uint16)
    shaped = out.reshape(marks, every // lanes, lanes)
    for step in range(every // lanes):
        # how many of the lanes of each stretch have an id here
        left = np.clip(size - (np.arange(marks) * every + step * lanes), 0, lanes)
        if not left.any():
            break
        slot = state & _SLOT
        ids = table.id_at[slot]
        moved = table.frequency[ids] * (state >> _BITS) + slot - table.before[ids]
        if left[-1] < lanes:  # only the last stretch ends early
            here = np.arange(lanes) < left[:, None]
            moved = np.where(here, moved, state)
            low = (moved < _LOW) & here
        else:
            low = moved < _LOW
        need = low.sum(axis=1)
        # the next words of each stretch, in the order of the lanes
        source = np.repeat(at - (np.cumsum(need) - need), need) + np.arange(need.sum())
        moved[low] = (moved[low] << _WORD) | words[source]
        at += need
        state = moved
        shaped[:, step, :] = ids
    return out[:size]


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end_id: int
               ) -> Iterator[pa.RecordBatch]:
    make_room(but=word_bpe.cache_clear)
    tokenizer, end = word_bpe(path), np.array([end_id], dtype="<u2").tobytes()
    for ids, texts in rows(batches):
        raw = [r + end for r in tokenizer.encode(texts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(r) // 2 for r in raw], pa.int64()),
             pa.array(raw, pa.binary())], schema=arrow_schema(_IDS))


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, dtype=np.int64)
    for (raw,) in rows(batches, 1024):
        total += np.bincount(np.frombuffer(b"".join(raw), dtype="<u2"), minlength=size)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen, pa.int32()), pa.array(total[seen])], names=["token", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], frequency: np.ndarray) -> Iterator[pa.RecordBatch]:
    table, kind, part = Table(frequency), arrow_schema(_BLOCKS), TaskContext.get().partitionId()
    number = first = 0

    def block(docs, raw):
        nonlocal number, first
        ids = np.frombuffer(b"".join(raw), dtype="<u2")
        row = ([part], [number], [first], [docs], [[len(r) // 2 for r in raw]],
               [encode(ids, table)])
        number, first = number + 1, first + len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(row, kind)], schema=kind)

    docs, raw, held = [], [], 0
    for some_docs, some_raw in rows(batches):
        for doc, ids in zip(some_docs, some_raw):
            docs.append(doc)
            raw.append(ids)
            held += len(ids) // 2
            if held >= BLOCK:
                yield block(docs, raw)
                docs, raw, held = [], [], 0
    if docs:
        yield block(docs, raw)


def _documents(batches: Iterator[pa.RecordBatch], frequency: np.ndarray
               ) -> Iterator[pa.RecordBatch]:
    table = Table(frequency)
    for first, docs, sizes, payload in rows(batches, 1):
        ids = decode(payload[0], table).astype("<u4")
        ends = np.cumsum(sizes[0])
        starts = ends - sizes[0]
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[0], pa.int64()), pa.array(starts + first[0], pa.int64()),
             pa.array(sizes[0], pa.int64()), pa.array(crc, pa.int64())],
            schema=arrow_schema(_DOCS))


def write_token_file(df: DataFrame, folder: str, path: str, vocabulary: int,
                     end_id: int = END_ID) -> None:
    """Encode ``text`` of each row with the tokenizers file at ``path``, end each document
    with ``end_id`` and write a token file to ``folder``, in ascending ``doc_id`` order.

    ``vocabulary`` is the number of ids; no more than 65,536.
    """
    ids = keep(in_batches(
        df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
        partial(_tokenised, path=path, end_id=end_id), _IDS), "token-ids")
    counted = in_batches(ids.select("ids"), partial(_counted, size=vocabulary),
                         "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, dtype=np.int64)
    for token, n in counted.collect():  # one row per id of the vocabulary at most
        counts[token] = n
    table = Table.scaled(counts)
    frequency = table.frequency.astype(np.int64)
    spark = df.sparkSession
    spark.createDataFrame(
        list(enumerate(frequency.tolist())), "token int, frequency bigint"
    ).coalesce(1).write.parquet(f"{folder}/table")
    parts = min(PARTS, max(1, -(-int(counts.sum()) // PART)))
    tie = F.xxhash64("ids")
    ordered = (ids.repartitionByRange(parts, F.col("doc_id"), tie)
               .sortWithinPartitions(F.col("doc_id"), tie))
    coded = in_batches(ordered.select("doc_id", "ids"), partial(_blocks, frequency=frequency),
                       _BLOCKS)
    # coded ids don't get any smaller
    coded.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of
    each document in a token file."""
    table = spark.read.parquet(f"{folder}/table").collect()  # as many rows as the vocabulary
    frequency = np.zeros(len(table), dtype=np.int64)
    for token, n in table:
        frequency[token] = n
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    # one row per file, of which there are no more than PARTS
    parts = blocks.groupBy("part").agg(F.sum(size).alias("held"))
    offset = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(offset, F.lit(0)).alias("offset"))
    placed = blocks.join(F.broadcast(parts), "part").select(
        (F.col("first") + F.col("offset")).alias("first"), "doc_ids", "sizes", "payload")
    return in_batches(placed, partial(_documents, frequency=frequency), _DOCS)
