"""Operator 5: pack documents into sequences of several lengths.

Hierarchical packing.  A document's ids (with an end id) are cut into whole windows of the
longest tier; what is left over is routed to the shortest tier that takes it.  Tiers are
packed from the longest down: a left-over opens a sequence of its tier, and the gap behind
it is filled with the largest fitting left-overs of the same and of shorter tiers.  What still gapes
after that is filled by cutting the next left-over in two, so that sequences come out full;
a document is cut at most once more than its windows need.  Full sequences have the length
of their tier, which is a power of two and needs no padding; only the last sequence of a
pack can be short and is padded.

Packs are runs of documents inside one input partition, of about ``PACK`` tokens, so
memory is bounded, no text is shuffled and no task waits for another.  Within a pack,
sequences are dealt to step groups back and forth in order of their attention cost (the sum
of squared piece lengths), so that steps of one pack cost about the same.

Null texts are empty and consist of the end id alone.  Repeated rows are packed as often
as they occur.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquary.llm.common import arrow_schema, in_batches, make_room, rows
from colloquary.llm.vocabularies import byte_bpe

TIERS = (256, 512, 1024, 2048)
END_ID = 1
PACK = 2_000_000  # tokens
STEP_TOKENS = 65_536  # tokens a step group should hold

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, tier int, step_group bigint")


class Piece:
    """``length`` ids of a document from ``start`` on."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:at], self.total),
                Piece(self.doc, self.start + at, self.ids[at:], self.total))


def pack(documents: list[tuple[object, np.ndarray]], tiers: tuple[int, ...] = TIERS
         ) -> list[tuple[int, list[Piece]]]:
    """(tier, pieces) of each sequence."""
    longest, out = tiers[-1], []
    # left-overs by length, then in the order they came
    waiting: list[tuple[int, int]] = []
    pieces: list[Piece] = []
    for doc, ids in documents:
        whole = len(ids) // longest * longest
        for start in range(0, whole, longest):
            out.append((longest, [Piece(doc, start, ids[start:start + longest], len(ids))]))
        if whole < len(ids):
            waiting.append((len(ids) - whole, len(pieces)))
            pieces.append(Piece(doc, whole, ids[whole:], len(ids)))
    waiting.sort()
    while waiting:
        size, at = waiting.pop()  # the longest left-over of all
        tier = tiers[bisect_left(tiers, size)]
        sequence, gap = [pieces[at]], tier - size
        while gap and waiting:
            fit = bisect_right(waiting, (gap, len(pieces)))
            if fit:
                size, at = waiting.pop(fit - 1)
                sequence.append(pieces[at])
                gap -= size
            else:  # all that wait are longer than the gap: cut the shortest
                size, at = waiting.pop(0)
                head, pieces[at] = pieces[at].cut(gap)
                sequence.append(head)
                insort(waiting, (size - gap, at))
                gap = 0
        out.append((tier, sequence))
    return out


def step_groups(costs: list[int], tokens: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number for each sequence: dealt back and forth, dearest first."""
    n = max(1, round(sum(tokens) / step_tokens))
    group = [0] * len(costs)
    for place, i in enumerate(sorted(range(len(costs)), key=lambda i: (-costs[i], i))):
        turn, at = divmod(place, n)
        group[i] = at if turn % 2 == 0 else n - 1 - at
    return group


def _packed(batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], end_id: int,
            size: int) -> Iterator[pa.RecordBatch]:
    make_room(but=byte_bpe.cache_clear)
    kind, tokenizer = arrow_schema(SCHEMA), byte_bpe(path)
    # sequences are numbered within the partition
    base = TaskContext.get().partitionId() << 40
    sequences = groups = 0

    def flush(documents):
        nonlocal sequences, groups
        packed = pack(documents, tiers)
        lengths = [[len(p.ids) for p in pieces] for _, pieces in packed]
        group = step_groups([sum(n * n for n in x) for x in lengths], [sum(x) for x in lengths])
        out = []
        for (tier, pieces), sizes, step in zip(packed, lengths, group):
            offset = 0
            for p, n in zip(pieces, sizes):
                # the last sequence of a pack may be short
                out.append((p.doc, p.start, n, zlib.crc32(p.ids.tobytes()), p.total,
                            base + sequences, offset, tier, base + groups + step))
                offset += n
            sequences += 1
        groups += max(group, default=-1) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    documents, held = [], 0
    for ids, texts in rows(batches):
        for doc, raw in zip(ids, tokenizer.encode(texts)):
            tokens = np.append(np.frombuffer(raw, dtype="<u2"), end_id).astype("<u4")
            documents.append((doc, tokens))
            held += len(tokens)
        if held > size:
            yield flush(documents)
            documents, held = [], 0
    if documents:
        yield flush(documents)


def pack_documents(df: DataFrame, path: str, tiers: tuple[int, ...] = TIERS,
                   end_id: int = END_ID, pack_tokens: int = PACK) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier, step_group``, with the tokenizers file at ``path``.

    ``tiers`` are ascending powers of two.  A sequence is padded up to ``tiers[-1]`` unless
    its pieces fill a power of two.
    """
    return in_batches(df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
                      partial(_packed, path=path, tiers=tuple(tiers), end_id=end_id,
                              size=pack_tokens), SCHEMA)
