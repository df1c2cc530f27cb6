"""Operator 11: a language model of word pairs in Elias-Fano tries, and texts scored with it.

Model.  ``p(w | v) = t(v) * c(v, w) / c(v) + (1 - t(v)) * p(w)`` with
``t(v) = c(v) / (c(v) + number of distinct successors of v)`` (Witten and Bell) and
``p(w) = (c(w) + 1) / (N + V + 1)``, where c are counts in the training texts, N all tokens and
V the distinct ones.  It sums to one over the V words and one unseen.  Words are lower-cased in
A-Z; a text is its words and an end, after a begin that is only a context.  Words are known by
64-bit hashes, successors by 40 bits of them (which can only confuse successors of one context).

Form.  Contexts are dealt to shards by hash.  A shard is a trie of two levels
(``elias_fano.Trie``), stored as Parquet rows of bytes, one a level: contexts, and below them
their successors, reached by pointers.  Shards and the model grow with the corpus; no task or
driver has more than its shard.

Work.  Texts are read once and cut into blocks of about ``BLOCK`` tokens, numbered by a word
list of the block.  A block sends its distinct pairs to the shards, with the number of times
they occur in training; a shard builds its trie from these and answers, for every pair sent,
with what a successor search in the trie finds; back at the blocks the answers are put together
per text.  So pairs cross the network once, a few bytes each, and answers once.

Busy contexts.  A context with more than half a shard's tokens, but at least 1/``SHARE`` of all
(so fewer than ``2 * SHARE`` of them, however large the corpus), is dealt by pair instead.  Its
count is found beforehand, the number of its successors is added up from the shards
afterwards.  A shard gets at most one row per block for a busy pair.

Null texts are empty ones.  An empty text is one end.  A null id is one like '' (part of
training for ``held_out`` below).  Repeated rows are scored each.  Texts longer than a block go
on in the next.  An empty table gives no rows; without training texts all scores are the base's.
Other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquary.llm.common import arrow_schema, give_back, in_batches, keep, make_room
from colloquary.llm.elias_fano import ABSENT, Trie, restore

BLOCK = 1_000_000
SHARD = 1_500_000  # tokens
SHARE = 10_000
SLICE = 4_000_000  # bytes of a text cut at a time

# no word is empty or has a blank in it
END, BEGIN = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")
_WORD = np.uint64((1 << 40) - 1)
_BLANKS = b" \t\n\x0b\x0c\r"

_KINDS = {"B": "<u1", "H": "<u2", "I": "<u4", "Q": "<u8", "q": "<i8"}


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed byte string, counts in as few bytes as they need."""
    parts = []
    for a in arrays:
        if a.dtype.kind == "i" and (not len(a) or a.min() >= 0):
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        kind = a.dtype.char if a.dtype.kind == "u" else "q"
        kind = {"L": "Q"}.get(kind, kind)
        parts.append(struct.pack("<cQ", kind.encode(), len(a)) + a.astype(_KINDS[kind]).tobytes())
    return zstandard.compress(b"".join(parts), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<cQ", raw, at)
        out.append(np.frombuffer(raw, dtype=_KINDS[kind.decode()], count=n, offset=at + 9))
        at += 9 + out[-1].nbytes
    return out


def _int(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64)


class _Numbers(dict):
    """word -> its number in the block"""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a text that end between words."""
    start = 0
    while start < len(text):
        end = min(len(text), start + SLICE)
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        yield text[start:end]
        start = end


class _Block:
    """Texts being gathered: pieces of them, and their tokens."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.numbers[b""]
        self.tokens: list[np.ndarray] = []
        self.n = 0
        self.pieces: list[tuple] = []  # id, row, trains, tokens, goes on, context before

    def row(self) -> dict:
        codes = np.concatenate(self.tokens) if self.tokens else np.zeros(0, dtype=np.int64)
        counts = np.bincount(codes, minlength=len(self.numbers))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), dtype=np.uint64,
                             count=len(self.numbers))[order]
        codes = rank[codes]
        ids, rows, trains, lengths, more, before = zip(*self.pieces)
        trains, lengths = np.array(trains), np.array(lengths)
        before = np.array(before, dtype=np.uint64)
        # the bytes of numbers apart, as the higher ones are nearly all alike
        planes = [(codes >> np.uint32(8 * k)).astype(np.uint8) for k in range(4)]
        data = _pack(hashes, *planes, np.array([d or 0 for d in ids], dtype=np.int64),
                     np.array([d is None for d in ids], dtype=np.uint8),
                     np.array(rows, dtype=np.uint64), trains.astype(np.uint8), lengths,
                     np.array(more, dtype=np.uint8), before)
        began = before == np.uint64(BEGIN)
        return {"block": uuid.uuid4().hex, "tokens": int(len(codes)),
                "train_tokens": int(lengths[trains].sum()),
                "train_texts": int((trains & began).sum()), "data": data}


_BLOCKS = "block string, tokens bigint, train_tokens bigint, train_texts bigint, data binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room()
    kind = arrow_schema(_BLOCKS)
    block, row = _Block(), uuid.uuid4().int >> 65

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([block.row()], schema=kind)

    for batch in batches:
        for i in range(batch.num_rows):
            doc, text, trains = (batch.column(k)[i].as_py() for k in range(3))
            row, before, length = row + 1, BEGIN, 0
            for part in _slices(text or b""):
                words = part.lower().split()
                for at in range(0, len(words), BLOCK):
                    some = words[at:at + BLOCK]
                    if block.n and block.n + len(some) > BLOCK:
                        if length:
                            block.pieces.append((doc, row, trains, length, True, before))
                            before = last
                        yield flush()
                        block, length = _Block(), 0
                    block.tokens.append(np.fromiter(map(block.numbers.__getitem__, some),
                                                    dtype=np.int64, count=len(some)))
                    block.n += len(some)
                    length += len(some)
                    if some:
                        last = xxhash.xxh64_intdigest(some[-1])
            block.tokens.append(np.zeros(1, dtype=np.int64))
            block.n += 1
            block.pieces.append((doc, row, trains, length + 1, False, before))
            if block.n >= BLOCK:
                yield flush()
                block = _Block()
    if block.pieces:
        yield flush()


@dataclass
class _Read:
    """A block as its bytes say: tokens and contexts by number, and pieces of texts."""

    hashes: np.ndarray  # of numbers; contexts before pieces come behind those of words
    words: int
    tokens: np.ndarray
    contexts: np.ndarray
    trains: np.ndarray  # by token
    starts: np.ndarray  # of pieces
    pieces: tuple
    loose: np.ndarray  # words after which a text goes on in another block

    @staticmethod
    def of(data: bytes) -> "_Read":
        (hashes, a, b, c, d, ids, none, rows, trains, lengths, more, before) = _unpack(data)
        tokens = _int(a) | _int(b) << 8 | _int(c) << 16 | _int(d) << 24
        lengths = _int(lengths)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        extra, at = np.unique(before, return_inverse=True)
        contexts = np.empty_like(tokens)
        contexts[1:] = tokens[:-1]
        filled = lengths > 0
        contexts[starts[filled]] = len(hashes) + at[filled]
        return _Read(np.concatenate([hashes, extra]), len(hashes), tokens, contexts,
                     np.repeat(trains.astype(bool), lengths), starts,
                     (ids, none.astype(bool), rows, trains.astype(bool), lengths),
                     tokens[ends[(more > 0) & filled] - 1])


@dataclass
class _Pairs:
    """Distinct pairs of a block in the order in which they are dealt to shards."""

    contexts: np.ndarray
    words: np.ndarray
    n: np.ndarray  # times in training
    shards: np.ndarray
    place: np.ndarray  # of each token's pair


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ b * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _pairs(block: _Read, shards: int, busy: np.ndarray) -> _Pairs:
    size = len(block.hashes)
    # the end, wanted or not, keeps a word that comes last in a block known as a context
    end = int(np.flatnonzero(block.hashes[:block.words] == np.uint64(END))[0])
    keys = np.concatenate([block.contexts * size + block.tokens, block.loose * size + end])
    distinct, place = np.unique(keys, return_inverse=True)
    n = np.bincount(place[:len(block.tokens)], weights=block.trains,
                    minlength=len(distinct)).astype(np.int64)
    contexts, words = np.divmod(distinct, size)
    home = block.hashes % np.uint64(shards)
    shard = home[contexts].astype(np.int64)
    if len(busy):
        spread = np.isin(block.hashes, busy)[contexts]
        shard[spread] = (_mixed(block.hashes[contexts[spread]], block.hashes[words[spread]])
                         % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return _Pairs(contexts[order], words[order], n[order], shard[order],
                  back[place[:len(block.tokens)]])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours begin, and how many they are."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])
                            ) if len(values) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.concatenate([starts, [len(values)]]))


_CELLS = "block string, shard int, data binary"


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(name)[i].as_py() for name in names)


def _dealt(batches: Iterator[pa.RecordBatch], shards: int, busy: np.ndarray
           ) -> Iterator[pa.RecordBatch]:
    """A block's pairs, one row per shard that gets some."""
    kind = arrow_schema(_CELLS)
    for name, data in _columns(batches, "block", "data"):
        block = _Read.of(data)
        pairs = _pairs(block, shards, busy)
        for start, n in zip(*_runs(pairs.shards)):
            here = slice(start, start + n)
            first, kinds = _runs(pairs.contexts[here])
            words, ref = np.unique(pairs.words[here], return_inverse=True)
            hashes = block.hashes[words] & _WORD
            cell = _pack(block.hashes[pairs.contexts[here][first]], kinds,
                         hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint8),
                         _int(ref), pairs.n[here])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([int(pairs.shards[start])], pa.int32()),
                 pa.array([cell], pa.binary())], schema=kind)


# rows of a shard: its levels, its answers to blocks, how many words it knows, and how many
# successors of busy contexts
LEVEL, ANSWER, WORDS, SUCCESSORS = range(4)
_OUT = "kind tinyint, name string, shard int, number bigint, data binary"


def _learnt(cells: list[tuple[str, bytes]], shard: int, given: dict[int, int]
            ) -> Iterator[dict]:
    """Build one shard's trie and answer its blocks."""
    give_back()
    read = [_unpack(data) for _, data in cells]
    lists = [(c, w.astype(np.uint64) | h.astype(np.uint64) << np.uint64(32))
             for c, _, w, h, _, _ in read]
    contexts, at = np.unique(np.concatenate([c for c, _ in lists]), return_inverse=True)
    words, to = np.unique(np.concatenate([w for _, w in lists]), return_inverse=True)
    keys, counts, i, j = [], [], 0, 0
    for c, kinds, w, _, ref, n in read:
        trained = np.flatnonzero(n)
        place = np.repeat(at[i:i + len(c)], kinds)[trained]
        keys.append(place * len(words) + to[j:j + len(w)][ref[trained]])
        counts.append(_int(n[trained]))
        i, j = i + len(c), j + len(w)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys = keys[order]
    first, _ = _runs(keys)
    counts = np.add.reduceat(counts[order], first) if len(first) else counts
    c, w = np.divmod(keys[first], max(1, len(words)))
    levels = Trie.build(contexts[c], words[w], counts, given)
    del keys, counts, order, c, w
    trie = Trie(levels)
    known = trie.contexts[np.arange(trie.contexts.n)]
    busy = np.isin(known, np.array(list(given), dtype=np.uint64))
    own = int((~busy & (known != np.uint64(BEGIN))).sum())
    yield {"kind": WORDS, "name": None, "shard": shard, "number": own, "data": None}
    kinds = np.diff(_int(trie.pointers[np.arange(trie.pointers.n)]))
    for place in np.flatnonzero(busy):
        yield {"kind": SUCCESSORS, "name": str(int(known[place])), "shard": shard,
               "number": int(kinds[place]), "data": None}
    for name, data in levels.items():
        yield {"kind": LEVEL, "name": name, "shard": shard, "number": None, "data": data}
    for (block, _), (c, kinds, _, _, ref, _), (_, w) in zip(cells, read, lists):
        place = trie.contexts.index(c)
        found = trie.find(np.repeat(place, kinds), trie.words.index(w)[ref])
        there = np.maximum(place, 0)
        if not trie.contexts.n:
            count, weight = np.zeros(len(c), dtype=np.int64), np.full(len(c), ABSENT, "<u2")
        else:
            count = np.where(place >= 0, trie.counts[there], 0)
            weight = np.where(place >= 0, trie.weights[there], ABSENT)
        share = np.full(len(found), ABSENT, dtype="<u2")
        share[found >= 0] = trie.shares[found[found >= 0]]
        yield {"kind": ANSWER, "name": block, "shard": shard, "number": None,
               "data": _pack(count, weight.astype(np.uint16), share)}


def _shards(batches: Iterator[pa.RecordBatch], given: dict[int, int]
            ) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard."""
    kind = arrow_schema(_OUT)
    cells: list = []
    now = None
    for block, shard, data in _columns(batches, "block", "shard", "data"):
        if shard != now and cells:
            for out in _learnt(cells, now, given):
                yield pa.RecordBatch.from_pylist([out], schema=kind)
            cells = []
        now = shard
        cells.append((block, data))
    if cells:
        for out in _learnt(cells, now, given):
            yield pa.RecordBatch.from_pylist([out], schema=kind)


def _frequent(batches: Iterator[pa.RecordBatch], part: float, wanted: np.ndarray | None
              ) -> Iterator[pa.RecordBatch]:
    """Contexts of more than ``part`` of a block's tokens and how many those are; or how often
    the ``wanted`` ones occur in training."""
    for (data,) in _columns(batches, "data"):
        block = _Read.of(data)
        weigh = block.trains if wanted is not None else None
        n = np.bincount(block.contexts, weights=weigh, minlength=len(block.hashes))
        mine = np.isin(block.hashes, wanted) if wanted is not None else n > part * max(
            1, len(block.tokens))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.hashes[mine].view(np.int64)), pa.array(n[mine].astype(np.int64))],
            names=["context", "n"])


@dataclass(frozen=True)
class Totals:
    """What a block needs besides its answers; the size doesn't depend on the corpus."""

    tokens: int
    words: int
    texts: int
    busy: dict[int, tuple[int, float]]  # contexts: count, weight


_SCORES = ("doc_id bigint, row bigint, trains boolean, n_tokens bigint, n_known bigint, "
           "base_score double, score double")


def _told(data: bytes, answers: list[bytes], shards: int, busy: np.ndarray, totals: Totals
          ) -> pa.RecordBatch:
    """Scores of the pieces in a block."""
    give_back()
    block = _Read.of(data)
    pairs = _pairs(block, shards, busy)
    share = np.empty(len(pairs.words), dtype=np.uint16)
    count = np.zeros(len(block.hashes), dtype=np.int64)
    weight = np.full(len(block.hashes), ABSENT, dtype=np.uint16)
    for (start, n), answer in zip(zip(*_runs(pairs.shards)), answers, strict=True):
        counts, weights, shares = _unpack(answer)
        contexts = pairs.contexts[start:start + n][_runs(pairs.contexts[start:start + n])[0]]
        count[contexts], weight[contexts] = counts, weights
        share[start:start + n] = shares
    count[block.hashes == np.uint64(END)] = totals.texts
    trust = np.where(weight == ABSENT, 0.0, restore(weight))
    for context, (n, value) in totals.busy.items():
        mine = block.hashes == np.uint64(context)
        count[mine], trust[mine] = n, value
    base = np.log10((count + 1) / (totals.tokens + totals.words + 1))
    seen = np.where(share == ABSENT, 0.0, restore(share))[pairs.place]
    mine = trust[block.contexts]
    p = mine * seen + (1 - mine) * 10.0 ** base[block.tokens]
    ids, none, rows, trains, lengths = block.pieces
    sums = [np.concatenate([[0], np.cumsum(values)]) for values in
            ((count > 0)[block.tokens].astype(np.int64), base[block.tokens], np.log10(p))]
    ends = block.starts + lengths
    known, plain, scored = (s[ends] - s[block.starts] for s in sums)
    return pa.RecordBatch.from_arrays(
        [pa.array(_int(ids), mask=none), pa.array(rows.view(np.int64)), pa.array(trains),
         pa.array(lengths), pa.array(known), pa.array(plain), pa.array(scored)],
        schema=arrow_schema(_SCORES))


def _finished(batches: Iterator[pa.RecordBatch], shards: int, busy: np.ndarray, totals: Totals
              ) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its own bytes first, then the answers by shard."""
    now, data, answers = None, None, []
    for name, shard, part in _columns(batches, "block", "shard", "data"):
        if name != now:
            if data is not None:
                yield _told(data, answers, shards, busy, totals)
            now, data, answers = name, part, []
        else:
            answers.append(part)
    if data is not None:
        yield _told(data, answers, shards, busy, totals)


def held_out(doc_id: str = "doc_id") -> Column:
    """Texts that are not learnt from: every seventh, by id."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(7)) == 2


@dataclass
class Model:
    """``levels``: ``name, shard, data``, the levels of every shard's trie."""

    levels: DataFrame
    shards: int
    totals: Totals


def learn_and_score(df: DataFrame, apart: Column | None = None, shard_tokens: int = SHARD
                    ) -> tuple[Model, DataFrame]:
    """The model of the texts for which ``apart`` doesn't hold, and ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    apart = held_out() if apart is None else apart
    texts = df.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.col("text").cast("string").cast("binary").alias("text"),
                      (~apart).alias("trains"))
    blocks = keep(in_batches(texts, _cut, _BLOCKS), "blocks")
    all_, tokens, trained = (int(v or 0) for v in blocks.agg(
        F.sum("tokens"), F.sum("train_tokens"), F.sum("train_texts")).first())
    shards = max(1, -(-all_ // shard_tokens))
    part = max(1 / (2 * shards), 1 / SHARE)
    data = blocks.select("data")
    given: dict[int, int] = {}
    if shards > 1:
        # what has more than a part of all has more than half of it in blocks that make up
        # half of its tokens or more
        often = in_batches(data, partial(_frequent, part=part / 2, wanted=None),
                           "context bigint, n bigint").groupBy("context").agg(
            F.sum("n").alias("n")).where(F.col("n") > part / 2 * all_)
        found = np.array([r[0] for r in often.collect()], dtype=np.int64).view(np.uint64)
        counted = in_batches(data, partial(_frequent, part=part, wanted=found),
                             "context bigint, n bigint").groupBy("context").agg(F.sum("n"))
        given = {int(np.int64(c).view(np.uint64)): int(n) for c, n in counted.collect() if n}
    busy = np.array(sorted(given), dtype=np.uint64)
    cells = in_batches(blocks.select("block", "data"),
                       partial(_dealt, shards=shards, busy=busy), _CELLS)
    out = keep(in_batches(cells.repartition("shard").sortWithinPartitions("shard"),
                          partial(_shards, given=given), _OUT), "ngram-trie")
    words = out.where(F.col("kind") == WORDS).agg(F.sum("number")).first()[0] or 0
    kinds = out.where(F.col("kind") == SUCCESSORS).groupBy("name").agg(F.sum("number")).collect()
    inner = [c for c in given if c != BEGIN]
    totals = Totals(tokens, words + len(inner) + (trained > 0), trained,
                    {int(c): (given[int(c)], given[int(c)] / (given[int(c)] + n))
                     for c, n in kinds})
    both = blocks.select("block", F.lit(-1).alias("shard"), "data").unionAll(
        out.where(F.col("kind") == ANSWER).select(F.col("name").alias("block"), "shard", "data"))
    pieces = in_batches(both.repartition("block").sortWithinPartitions("block", "shard"),
                        partial(_finished, shards=shards, busy=busy, totals=totals), _SCORES)
    scores = pieces.groupBy("doc_id", "row", "trains").agg(
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    levels = out.where(F.col("kind") == LEVEL).select("name", "shard", "data")
    return Model(levels, shards, totals), scores.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
