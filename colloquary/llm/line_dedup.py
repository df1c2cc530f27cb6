"""Operator 4: near-duplicate lines by an exact set-similarity join.

A line is the set of its words.  A line is removed if an earlier one (by document id, then
line number) has a Jaccard similarity of ``SIMILARITY`` or more with it, kept itself or not.
Lines without words always stay.

How matches are found:

1. How often words occur is counted over all texts, in ``CELLS`` cells by hash.  That
   gives one order of rarity for all words; whatever the order, results are the same.
2. Equal sets are one entry, that of the first line; copies beyond it are removed anyway.
   Only sets that occur more than once (and a few others, by a bounded bit table) are
   brought together for that; where one occurs very often, its lines stay where they are.
3. Prefix filter: two sets of similarity t can't match unless they share a word among the
   n - ceil(t n) + 1 rarest of each.  Each entry goes to the lists of those words.
4. Within a list, length filter (t n <= m <= n / t), positional filter (what is left
   behind the shared word must be enough for the overlap needed) and a bitmap filter (sets
   whose parities over 128 bits differ by d share (n + m - d) / 2 words at most).
   Lists are sorted by size, so the length filter ends a scan; while screening only the
   ``SOME`` nearest earlier ones of each entry are held.  A crowded list (above about
   ``CROWD``, judged by a sample of documents) is cut into blocks that meet in pairs,
   each pair in a task of its own.
5. Verification: an entry that has earlier candidates is compared with the nearest of them
   by bitmap, word by word (by 52-bit hashes), and with ``SOME`` of each list where it is in
   doubt whether the nearest matches.  Only entries that fail that and have others are
   looked up again and compared with all of their candidates.  So a group of thousands of
   near copies costs few comparisons of word sets each, though all its pairs are screened,
   and no pair is missed.

Scale: what travels are entries of some 40 bytes per prefix word, some lists of a task in
one row (a parcel), so that there are fewer rows than postings; entries are written once,
with their prefixes, for the sample, the lists and the second look-up; word sets are fetched
only for lines that have candidates (a bounded bit table sorts out most others while texts
are read), and only documents that lose a line are joined with the list of those.
Frequent words are last in the order of rarity, so they head lists only for lines that
have nothing else, and equal lines have met before.  No task is planned with two Python steps
at once, each of which would need a worker that stays.

Null texts stay null, empty ones empty.  Rows that share doc_id and text lose the same
lines.  A row without a doc_id keeps all its lines and removes none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquary.llm.common import (
    BLANKS, arrow_schema, bit_place, bit_table, give_back, in_batches, keep, make_room,
    remembered, ship)

SIMILARITY = 0.8
CELLS, SPAN = 1 << 18, 1 << 12  # cells of word counts; those that travel in one row
LIMIT = 200_000  # sets remembered per task
ROWS, PAIRS = 200_000, 1 << 18  # postings and comparisons at a time
SOME = 8  # candidates of an entry in a list that are verified before the others are looked up
HELD = 1 << 19  # pairs that passed the filters held before the nearest are picked
CROWD, PART = 16_384, 16  # entries of a crowded list; one in so many documents is sampled
PARCEL = 8192  # lines for each of which there is one parcel of lists, of all tasks together
PACKED = 1 << 17  # postings put into parcels at a time
BUSY = 1000  # lines of a set that don't travel to meet
CHARS = 150_000  # bytes of text worked through at a time

_COUNTS = "at bigint, counts binary"
_ENTRY = "s1 bigint, s2 bigint, doc bigint, line bigint, size int, b1 bigint, b2 bigint, prefix binary"
_POSTING = "word int, doc bigint, line bigint, size int, at int, b1 bigint, b2 bigint"
_PARCEL = "parcel int, postings binary"
_PAIR = "doc bigint, line bigint, with_doc bigint, with_line bigint, apart int, more boolean"
_SET = "doc bigint, line bigint, s1 bigint, words binary"
_VERDICT = "doc bigint, line bigint, s1 bigint, matches boolean"
_ASKING = ("word int, doc bigint, line bigint, s1 bigint, size int, at int, b1 bigint, "
           "b2 bigint")


# 1 for a blank, 0 for any other byte
_BLANK = bytes(int(chr(i) in BLANKS) for i in range(256))
# a posting within a parcel
_PACKED = np.dtype([("word", "<i4"), ("doc", "<i8"), ("line", "<i4"), ("size", "<i4"),
                    ("at", "<i4"), ("b1", "<i8"), ("b2", "<i8")])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MASK = np.uint64((1 << 52) - 1)


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(factor)
    return x ^ x >> np.uint64(29)


_POWERS: dict[int, np.ndarray] = {}
remembered.append(_POWERS.clear)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base), ())
    if len(held) < n:
        held = np.full(max(n, 2 * CHARS), base, dtype=np.uint64)
        held[0] = 1
        held = _POWERS[int(base)] = np.multiply.accumulate(held)
    return held[:n]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start, and their hashes of 52 bits.

    A word's hash is a polynomial over its bytes, taken from one running sum as the
    difference of its ends.
    """
    blank = np.frombuffer(b"\x01" + raw.translate(_BLANK) + b"\x01", dtype=bool)
    starts = np.flatnonzero(blank[:-1] > blank[1:])
    ends = np.flatnonzero(blank[:-1] < blank[1:])
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        letters = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
        letters += np.uint64(1)  # so that a zero byte counts
        letters *= _powers(_STEP, len(raw))
        np.cumsum(letters, out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _powers(_BACK, len(raw))[starts]
        return starts, _mixed(_mixed(hashes, 0xBF58476D1CE4E5B9), 0x94D049BB133111EB) & _MASK


class Lines:
    """The lines with words of some texts: where they stand, and their distinct words (as
    hashes of 52 bits), one line behind the other, each sorted.

    Works on the bytes of all texts at once.  ``wanted`` may tell, given document ids and line
    numbers, which lines are wanted; others are not cut into words.
    """

    def __init__(self, docs: pa.Array, texts: pa.Array,
                 wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        rows = [i for i, ok in enumerate(docs.is_valid().to_pylist()) if ok]
        docs, texts = docs.take(pa.array(rows, pa.int64())), texts.take(pa.array(rows, pa.int64()))
        texts = texts.fill_null("")
        # a line break behind each text; longer offsets than a string's
        raw = b"".join([t.as_buffer().to_pybytes() + b"\n" for t in texts])
        ends_of_text = np.cumsum([len(t.as_buffer()) + 1 for t in texts], dtype=np.int64)
        data = np.frombuffer(raw, dtype=np.uint8)
        ids = docs.to_numpy(zero_copy_only=False).astype(np.int64)
        breaks = np.flatnonzero(data == 10)
        row = np.searchsorted(ends_of_text, breaks, side="right")
        first_line = np.concatenate(([0], np.searchsorted(breaks, ends_of_text[:-1])))
        number = np.arange(len(breaks)) - first_line[row]
        if wanted is not None:
            good, sizes = wanted(ids[row], number), np.diff(breaks, prepend=-1)
            data = data[np.repeat(good, sizes)]
            raw = data.tobytes()
            row, number, breaks = row[good], number[good], np.cumsum(sizes[good]) - 1
        starts, hashes = _words(raw)
        words_in = np.diff(np.searchsorted(starts, breaks), prepend=0)
        lines = np.flatnonzero(words_in)
        owner = np.repeat(np.arange(len(lines)), words_in[lines])
        self.doc, self.line = ids[row[lines]], number[lines]
        # sorted by line and hash in one go, some lines at a time
        words, owners = [], []
        for low in range(0, len(lines), 4096):
            a, b = np.searchsorted(owner, [low, low + 4096])
            key = np.sort((owner[a:b] - low).astype(np.uint64) << np.uint64(52) | hashes[a:b])
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            words.append(key & _MASK)
            owners.append((key >> np.uint64(52)).astype(np.int64) + low)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.sizes = np.bincount(self.owner, minlength=len(lines))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, as two signed numbers."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            return tuple(_mixed(np.add.reduceat(_mixed(self.words + np.uint64(1), f), self.starts),
                                f).view(np.int64)
                         for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

    def ranked(self, rarity: np.ndarray) -> np.ndarray:
        """The words' lower 32 bits, rarest first within each line."""
        out = np.zeros(len(self.words), dtype=np.uint32)
        for low in range(0, len(self), 4096):
            a, b = np.searchsorted(self.owner, [low, low + 4096])
            key = np.sort((self.owner[a:b] - low).astype(np.uint64) << np.uint64(52)
                          | rarity[_cell(self.words[a:b])] << np.uint64(32)
                          | self.words[a:b] & np.uint64(0xFFFFFFFF))
            out[a:b] = key.astype(np.uint32)
        return out

    def sets(self, some: np.ndarray) -> pa.Array:
        """Words of some lines, eight bytes each."""
        return _binary(self.words.astype("<u8"), self.starts[some], self.sizes[some])


def _binary(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of ``values`` as binary."""
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    offsets = np.concatenate(([0], np.cumsum(sizes * values.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [
        None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values[at].tobytes())])


def _cell(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(52 - 18)).astype(np.int64)  # the top 18 bits


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where rows of about ``CHARS`` bytes begin and end."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // CHARS
    return zip(np.flatnonzero(np.diff(part, prepend=-1)).tolist(),
               np.append(np.flatnonzero(np.diff(part)) + 1, len(part)).tolist())


def _some_lines(batches: Iterator[pa.RecordBatch],
                wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
                ) -> Iterator[Lines]:
    """Lines of about ``CHARS`` bytes of text at a time."""
    make_room()
    for batch in batches:
        for start, end in _portions(batch.column(1)):
            some = batch.slice(start, end - start)
            yield Lines(some.column(0), some.column(1), wanted)


def _tallies(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.int64()),
         pa.array([x.astype("<i8").tobytes() for x in counts.values()], pa.binary())],
        schema=arrow_schema(_COUNTS))


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words fell into the cells, ``SPAN`` of them to a row."""
    make_room()
    counts, held = np.zeros(CELLS, dtype=np.int64), []

    def count():
        nonlocal counts
        if held:
            counts += np.bincount(np.concatenate(held), minlength=CELLS)
            held.clear()

    for batch in batches:
        for start, end in _portions(batch.column(1)):
            raw = b"\n".join([t.as_buffer() for t in batch.column(1).slice(start, end - start)
                              if t.is_valid])
            held.append(_cell(_words(raw)[1]))
            if sum(map(len, held)) > CELLS:
                count()
    count()
    yield _tallies(dict(enumerate(counts.reshape(-1, SPAN))))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the same cells, added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = sums.setdefault(at, np.zeros(SPAN, dtype="<i8"))
            held += np.frombuffer(raw.as_buffer(), dtype="<i8")
    yield _tallies(sums)


def prefix_size(size: np.ndarray, t: float) -> np.ndarray:
    # a hair less than t n, so that rounding never makes a prefix too short
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _bitmaps(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of the words per bit, two times 64 bits for each line."""
    bit = np.uint64(1) << (words & np.uint64(63))
    high = words & np.uint64(64) != 0
    return (np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), starts),
            np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), starts))


def _entries(batches: Iterator[pa.RecordBatch], rarity: np.ndarray, t: float
             ) -> Iterator[pa.RecordBatch]:
    """All lines; those whose set has an earlier one in the partition without a prefix."""
    kind, seen = arrow_schema(_ENTRY), {}
    for lines in _some_lines(batches):
        if not len(lines):
            continue
        one, two = lines.digests()
        b1, b2 = _bitmaps(lines.words, lines.starts)
        ranked, prefix = lines.ranked(rarity).astype("<u4"), prefix_size(lines.sizes, t)
        for i, (s1, where) in enumerate(zip(one.tolist(), zip(lines.doc.tolist(),
                                                              lines.line.tolist()))):
            if s1 not in seen or where < seen[s1]:
                if len(seen) > LIMIT:  # forgetting one does no harm: it only travels twice
                    seen.clear()
                seen[s1] = where
            else:
                prefix[i] = 0
        columns = [one, two, lines.doc, lines.line, lines.sizes, b1.view(np.int64),
                   b2.view(np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, kind)]
            + [_binary(ranked, lines.starts, prefix)], schema=kind)
    seen.clear()
    give_back()


def _in_table(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """Which entries have a set that is in the bit table."""
    place = bit_place(*[batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
    return table[place >> 3] >> (place & 7) & 1 == 1


def _again(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of sets in the bit table."""
    make_room()
    for batch in batches:
        yield batch.take(pa.array(np.flatnonzero(_in_table(batch, table))))


def _alone(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of sets that are not in the bit table."""
    for batch in batches:
        yield batch.take(pa.array(np.flatnonzero(~_in_table(batch, table))))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by set, document and line: the first of each set."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        s1, s2 = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
        new = np.r_[(s1[0], s2[0]) != before, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]
        before = (s1[-1], s2[-1])
        yield batch.take(pa.array(np.flatnonzero(new)))


def _unfolded(batch: pa.RecordBatch, chosen: Callable[[np.ndarray], np.ndarray] | None = None
              ) -> list[np.ndarray]:
    """A posting for each prefix word of entries, by columns; ``chosen`` may tell of the words
    which are wanted."""
    doc, line, size, b1, b2 = [batch.column(i).to_numpy(zero_copy_only=False)
                               for i in range(2, 7)]
    prefixes = batch.column(7)
    ends = np.frombuffer(prefixes.buffers()[1], dtype=np.int32)[
        prefixes.offset:prefixes.offset + batch.num_rows + 1] // 4 if batch.num_rows else [0, 0]
    values = prefixes.buffers()[2]
    words = np.frombuffer(values or b"", dtype="<i4", count=-1)[ends[0]:ends[-1]]
    counts, first = np.diff(ends), np.asarray(ends[:-1]) - ends[0]
    own = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words)) - np.repeat(first, counts)
    if chosen is not None:
        some = np.flatnonzero(chosen(words))
        words, own, at = words[some], own[some], at[some]
    return [words, doc[own], line[own], size[own], at, b1[own], b2[own]]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _told(columns: list[np.ndarray]) -> pa.RecordBatch:
    kind = arrow_schema(_POSTING)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of entries."""
    for batch in batches:
        if batch.num_rows:
            yield _told(_unfolded(batch))


def _of_words(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of entries for some words."""
    for batch in batches:
        if batch.num_rows:
            yield _told(_unfolded(batch, lambda w: np.isin(w, words)))


def _of_others(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[list[np.ndarray]]:
    """By columns, postings of entries for all but some words."""
    for batch in batches:
        if batch.num_rows:
            yield _unfolded(batch, (lambda w: ~np.isin(w, words)) if len(words) else None)


def _parcels(postings: Iterator[list[np.ndarray]], parcels: int) -> Iterator[pa.RecordBatch]:
    """Postings of neighbouring words in one row; parcels are numbered in the order of words."""
    kind, held = arrow_schema(_PARCEL), []

    def packed():
        columns = [np.concatenate(c) for c in zip(*held)]
        parcel = (columns[0].astype(np.int64) + (1 << 31)) * parcels >> 32
        order = np.argsort(parcel, kind="stable")
        rows = np.empty(len(order), dtype=_PACKED)
        for name, column in zip(_PACKED.names, columns):
            rows[name] = column[order]
        parcel = parcel[order]
        first = np.flatnonzero(np.concatenate(([True], parcel[1:] != parcel[:-1])))
        offsets = (np.append(first, len(rows)) * rows.itemsize).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(parcel[first], pa.int32()), pa.Array.from_buffers(
                pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(rows.view(np.uint8))])],
            schema=kind)

    make_room()
    for columns in postings:
        if len(columns[0]):
            held.append(columns)
        if sum(len(c[0]) for c in held) > PACKED:
            yield packed()
            held = []
    if held:
        yield packed()
    held = []
    give_back()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From parcels in order: postings sorted by word and size, without those of words that
    have no other."""

    def opened(raw):
        rows = np.frombuffer(b"".join(raw), dtype=_PACKED)
        word = rows["word"].astype(np.int64)
        key = (word << 32) + rows["size"]
        order = np.argsort(key)
        word = word[order]
        same = word[1:] == word[:-1]
        met = np.concatenate((same, [False])) | np.concatenate(([False], same))
        rows = rows[order[met]]
        return _told([np.ascontiguousarray(rows[name]) for name in _PACKED.names])

    make_room()
    held: list[bytes] = []
    last = None
    for batch in batches:
        for parcel, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if parcel != last and sum(map(len, held)) > PACKED * _PACKED.itemsize:
                yield opened(held)
                held = []
            last = parcel
            held.append(raw.as_py())
    if held:
        yield opened(held)
    held = []
    give_back()


def _candidates(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """From postings sorted by word and size: for each entry its nearest earlier candidates, and
    whether there are more."""
    kind = arrow_schema(_PAIR)

    def pairs(word, doc, line, size, at, b1, b2):
        found: list[list[np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total, waiting = np.zeros(len(word), dtype=np.int64), 0  # earlier ones of each entry

        def nearest():
            """The ``SOME`` nearest earlier ones of each, by entry; where entries begin."""
            x, y, apart, spare = map(np.concatenate, zip(*found))
            order = np.lexsort((line[y], doc[y], apart, x))
            x, y, apart, spare = x[order], y[order], apart[order], spare[order]
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
            good = rank < SOME
            found[:] = [[x[good], y[good], apart[good], spare[good]]]

        def screen(i, j):
            """Pairs (later, earlier, bits apart) that pass all filters."""
            nonlocal waiting
            n, m = size[i], size[j]
            good = np.minimum(n, m) >= t * np.maximum(n, m) - 1e-9
            i, j, n, m = i[good], j[good], n[good], m[good]
            need = np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int32)
            good = np.minimum(n - at[i], m - at[j]) >= need
            i, j, spare = i[good], j[good], (n + m - 2 * need)[good]
            apart = np.bitwise_count(b1[i] ^ b1[j]).astype(np.int32)
            apart += np.bitwise_count(b2[i] ^ b2[j])
            good = apart <= spare
            i, j, apart, spare = i[good], j[good], apart[good], spare[good]
            if len(i):
                swap = (doc[i] < doc[j]) | (doc[i] == doc[j]) & (line[i] < line[j])
                found.append([np.where(swap, j, i), np.where(swap, i, j), apart, spare])
                total[:] += np.bincount(found[-1][0], minlength=len(total))
                waiting += len(i)
                if waiting > HELD:
                    nearest()
                    waiting = 0

        def flush(least):
            if held and sum(len(x[0]) for x in held) > least:
                screen(*map(np.concatenate, zip(*held)))
                held.clear()

        # entries k places apart, as long as both are in one list
        apart, i = 1, np.arange(len(word) - 1)
        while len(i):
            i = i[word[i] == word[i + apart]]
            i = i[size[i] >= t * size[i + apart] - 1e-9]  # sizes grow
            held.append((i, i + apart))
            flush(PAIRS)
            apart += 1
            i = i[:np.searchsorted(i, len(word) - apart)]
        flush(0)
        if not found:
            return None
        nearest()
        [(x, y, apart, spare)] = found
        # of each later entry in each list the nearest; where the bitmaps leave it in doubt
        # whether that one matches, some more; and whether there are others
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        held_of = np.diff(np.append(first, len(x)))
        rank = np.arange(len(x)) - np.repeat(first, held_of)
        doubt = apart[first] + apart[first] ** 2 // 64 + 2 > spare[first]
        told = np.where(doubt, SOME, 1)
        good = rank < np.repeat(told, held_of)
        more = np.repeat(total[x[first]] > told, held_of)[good]
        x, y = x[good], y[good]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
            [doc[x], line[x], doc[y], line[y], apart[good], more], kind)], schema=kind)

    def told(batch):
        return [] if batch is None else [batch]

    held: list[list[np.ndarray]] = []

    def joined():
        columns = [np.concatenate(c) for c in zip(*held)]
        columns[5:] = [c.view(np.uint64) for c in columns[5:]]
        return columns

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(c[0]) for c in held) > ROWS:
            columns = joined()
            end = int(np.searchsorted(columns[0], columns[0][-1]))  # the last list may go on
            if end:
                yield from told(pairs(*[c[:end] for c in columns]))
            columns[5:] = [c.view(np.int64) for c in columns[5:]]
            held = [[c[end:] for c in columns]]
    if held:
        yield from told(pairs(*joined()))


def _sets(batches: Iterator[pa.RecordBatch], docs: np.ndarray, table: np.ndarray
          ) -> Iterator[pa.RecordBatch]:
    """Word sets of the lines in one bit table, which are in documents of the other."""
    kind = arrow_schema(_SET)

    def concerned():
        for batch in batches:
            place = bit_place(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False),
                              np.zeros(1, dtype=np.int64))
            chosen = np.flatnonzero(docs[place >> 3] >> (place & 7) & 1)
            yield batch.take(pa.array(chosen))

    def wanted(doc, line):
        place = bit_place(doc, line)
        return table[place >> 3] >> (place & 7) & 1 == 1

    for lines in _some_lines(concerned(), wanted):
        if len(lines):
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines.doc), pa.array(lines.line), pa.array(lines.digests()[0]),
                 lines.sets(np.arange(len(lines)))], schema=kind)


def _sets_of(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc, line, s1, words`` of the lines ``doc, line`` and a few others."""
    lines = lines.withColumn("zero", F.lit(0).cast("bigint"))
    return in_batches(texts, partial(_sets, docs=bit_table(lines, "doc", "zero"),
                                     table=bit_table(lines)), _SET)


def _verified(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    kind = arrow_schema(_VERDICT)
    for whole in batches:
        # some pairs at a time: a pair's number and a word of 52 bits fill 64
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            keys, sizes = [], []
            for i in (3, 4):
                sets = batch.column(i).to_pylist()
                sizes.append(np.array([len(x) // 8 for x in sets], dtype=np.int64))
                keys.append(np.repeat(np.arange(len(sets), dtype=np.uint64), sizes[-1])
                            << np.uint64(52) | np.frombuffer(b"".join(sets), dtype="<u8"))
            key = np.sort(np.concatenate(keys))
            shared = key[1:][key[1:] == key[:-1]] >> np.uint64(52)
            both = np.bincount(shared.astype(np.int64), minlength=batch.num_rows)
            good = both >= t * (sizes[0] + sizes[1] - both) - 1e-9
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(good)], schema=kind)


def _prefixes(batches: Iterator[pa.RecordBatch], rarity: np.ndarray, t: float
              ) -> Iterator[pa.RecordBatch]:
    """From ``doc, line, s1, words``: a posting for each prefix word."""
    kind = arrow_schema(_ASKING)
    for batch in batches:
        doc, line, s1 = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        for i, raw in enumerate(batch.column(3)):
            words = np.frombuffer(raw.as_buffer(), dtype="<u8")
            order = np.lexsort((words.astype(np.uint32), rarity[_cell(words)]))
            n = int(prefix_size(np.array(len(words)), t))
            b1, b2 = _bitmaps(words, np.zeros(1, dtype=np.int64))
            chosen = words[order[:n]].astype(np.uint32).view(np.int32)
            columns = [chosen, [doc[i]] * n, [line[i]] * n, [s1[i]] * n, [len(words)] * n,
                       np.arange(n), b1.view(np.int64).repeat(n), b2.view(np.int64).repeat(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)


def _hits(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of entries for prefix words in the bit table."""
    def asked(words):
        place = bit_place(words.astype(np.int64), np.zeros(1, dtype=np.int64))
        return table[place >> 3] >> (place & 7) & 1

    for batch in batches:
        if batch.num_rows:
            yield _told(_unfolded(batch, asked))


def _any_match(pairs: DataFrame, t: float) -> DataFrame:
    """``doc, line, s1, matches`` of ``doc, line, s1, words, other``."""
    return in_batches(pairs, partial(_verified, t=t), _VERDICT).groupBy("doc", "line", "s1").agg(
        F.max("matches").alias("matches"))


def _entered(texts: DataFrame, rarity: np.ndarray, t: float) -> DataFrame:
    return in_batches(texts, partial(_entries, rarity=rarity, t=t), _ENTRY)


def _by_set(entries: DataFrame) -> DataFrame:
    """Entries that may be the first of their set, sorted."""
    return entries.where(F.length("prefix") > 0).repartition("s1").sortWithinPartitions(
        "s1", "s2", "doc", "line")


def _lists(texts: DataFrame, rarity: np.ndarray, t: float, entries: DataFrame | None = None
           ) -> DataFrame:
    """Postings of the first line of each set, from ``entries`` if these are at hand."""
    entries = _entered(texts, rarity, t) if entries is None else entries
    return in_batches(_by_set(entries), lambda b: _postings(_first_of_each(b)), _POSTING)


def crowded_words(texts: DataFrame, rarity: np.ndarray, t: float, sets: int,
                  entries: DataFrame | None = None) -> DataFrame:
    """``word, blocks`` of the words whose lists are to be cut, as a sample tells."""
    part = PART if sets > PART * CROWD else 1
    entries = _entered(texts, rarity, t) if entries is None else entries
    some = entries.where(F.pmod(F.xxhash64("doc"), F.lit(part)) == 0)
    counted = _lists(texts, rarity, t, some).groupBy("word").agg(
        (F.count(F.lit(1)) * part).alias("n"))
    return counted.where(F.col("n") > CROWD).select(
        "word", F.ceil(F.col("n") / (CROWD // 2)).alias("blocks"))


def _in_blocks(lists: DataFrame, crowded: DataFrame) -> DataFrame:
    """``lists`` with those of crowded words cut into lists of two blocks each.  That two of
    the new lists may get one number only adds pairs to be screened."""
    own = F.pmod(F.xxhash64("doc", "line"), F.col("blocks"))
    # fewer rows than there are postings for each CROWD
    placed = lists.join(F.broadcast(crowded), "word", "left").withColumn("own", own).withColumn(
        "other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("bigint")))
                           .otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))))
    word = F.when(F.col("blocks").isNull(), F.col("word")).otherwise(
        F.hash("word", F.least("own", "other"), F.greatest("own", "other")))
    return placed.select(word.alias("word"), *lists.columns[1:])


def _few(nearest: DataFrame) -> DataFrame:
    """The ``SOME`` nearest of each line's candidates, where blocks brought it many."""
    own = Window.partitionBy("doc", "line")
    ranked = nearest.withColumn(
        "rank", F.row_number().over(own.orderBy("apart", "with_doc", "with_line"))).withColumn(
        "more", F.col("more") | (F.count(F.lit(1)).over(own) > SOME))
    return ranked.where(F.col("rank") <= SOME).drop("rank")


def _copies(again: DataFrame, several: DataFrame) -> DataFrame:
    """``doc, line, s1`` of all lines but the first of each set, given lines (``s1, s2, doc,
    line``) and, of the sets of several lines, how many have it and the first's document."""
    # fewer sets than there are lines for each BUSY, and 10,000 at most
    bound = max(BUSY, again.count() // 10_000)
    busy = F.broadcast(several.where(F.col("n") > bound))
    own = ["s1", "s2"]
    met = again.join(busy, own).unionAll(again.join(busy, own, "left_anti").join(
        several.where(F.col("n") <= bound), own).select(*own, "doc", "line", "n", "first"))
    # the first's document may have the set again
    least = F.min("line").over(Window.partitionBy(*own))
    within = met.where("doc = first").withColumn("least", least).where("line > least")
    return met.where("doc > first").select("doc", "line", "s1").unionAll(
        within.select("doc", "line", "s1"))


def lost_lines(texts: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """``doc, line, s1`` (part of the digest of its set) of each line that an earlier one
    matches, given ``doc_id, text``.  Lines count from 0; where rows share doc_id and text, a
    line may be named more than once."""
    uses = np.zeros(CELLS, dtype=np.int64)
    counted = in_batches(in_batches(texts, _surveyed, _COUNTS).repartition("at"), _summed, _COUNTS)
    for at, raw in counted.collect():  # CELLS / SPAN rows
        uses[at * SPAN:(at + 1) * SPAN] = np.frombuffer(raw, dtype="<i8")
    rarity = np.empty(CELLS, dtype=np.uint64)  # places from rare to frequent
    rarity[np.argsort(uses, kind="stable")] = np.arange(CELLS, dtype=np.uint64)

    entries = keep(_entered(texts, rarity, t), "entries")
    several = keep(entries.groupBy("s1", "s2").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where("n > 1"), "several")
    table = bit_table(several, "s1", "s2")
    again = keep(in_batches(entries, partial(_again, table=table), _ENTRY), "again")
    copies = _copies(again.select("s1", "s2", "doc", "line"), several)

    n = entries.count()
    crowded, cut = None, np.zeros(0, np.int32)
    if n > CROWD:
        crowded = keep(crowded_words(texts, rarity, t, n, entries), "crowded")
        # fewer rows than there are postings for each CROWD
        cut = np.array([r["word"] for r in crowded.select("word").collect()], dtype=np.int32)
        crowded = crowded if len(cut) else None
    parcels = 1 + n // PARCEL
    lists = in_batches(
        entries, lambda b: _parcels(_of_others(_alone(b, table), cut), parcels), _PARCEL).unionAll(
        in_batches(_by_set(again), lambda b: _parcels(_of_others(_first_of_each(b), cut), parcels),
                   _PARCEL))
    if crowded is not None:
        # kept so that no task is planned with two Python steps
        rest = keep(in_batches(
            entries, lambda b: _of_words(_alone(b, table), cut), _POSTING).unionAll(in_batches(
                _by_set(again), lambda b: _of_words(_first_of_each(b), cut), _POSTING)), "rest")
        lists = lists.unionAll(in_batches(
            _in_blocks(rest, crowded), lambda b: _parcels(map(_columns, b), parcels), _PARCEL))
    lists = lists.repartition("parcel").sortWithinPartitions("parcel")
    found = in_batches(lists, lambda b: _candidates(_unpacked(b), t), _PAIR)
    nearest = found.groupBy("doc", "line", "with_doc", "with_line").agg(
        F.max("more").alias("more"), F.min("apart").alias("apart"))
    nearest = keep((nearest if crowded is None else _few(nearest)).drop("apart"), "nearest")
    ends = nearest.select("doc", "line").unionAll(
        nearest.select(F.col("with_doc").alias("doc"), F.col("with_line").alias("line")))
    sets = keep(_sets_of(texts, ends), "sets")
    other = sets.select(F.col("doc").alias("with_doc"), F.col("line").alias("with_line"),
                        F.col("words").alias("other"))
    met = nearest.join(sets, ["doc", "line"]).join(other, ["with_doc", "with_line"])
    checked = keep(_any_match(met.select("doc", "line", "s1", "words", "other"), t), "checked")
    matched = checked.where("matches").select("doc", "line", "s1")

    # the few that none of these matches, but perhaps another
    open_ = checked.where(~F.col("matches")).join(
        nearest.where("more").select("doc", "line").distinct(), ["doc", "line"])
    open_ = keep(sets.join(open_.select("doc", "line", "s1"), ["doc", "line", "s1"])
                 .select("doc", "line", "s1", "words"), "open")
    if not open_.isEmpty():
        asking = keep(in_batches(open_, partial(_prefixes, rarity=rarity, t=t), _ASKING), "asking")
        table = bit_table(asking.select(F.col("word").cast("bigint").alias("doc"),
                                        F.lit(0).cast("bigint").alias("line")))
        asked = in_batches(entries, partial(_hits, table=table), _POSTING)
        asked = asked.select("word", *[F.col(c).alias(f"with_{c}") for c in asked.columns[1:]])
        n, m = F.col("size"), F.col("with_size")
        need = F.ceil(t / (1 + t) * (n + m) - 1e-9)
        apart = (F.bit_count(F.col("b1").bitwiseXOR(F.col("with_b1")))
                 + F.bit_count(F.col("b2").bitwiseXOR(F.col("with_b2"))))
        pairs = asking.join(asked, "word").where(
            (F.struct("with_doc", "with_line") < F.struct("doc", "line"))
            & (F.least(n, m) >= t * F.greatest(n, m) - 1e-9)
            & (1 + F.least(n - F.col("at"), m - F.col("with_at")) - 1 >= need)
            & (n + m - apart >= 2 * need))
        pairs = keep(pairs.select("doc", "line", "s1", "with_doc", "with_line").distinct(), "pairs")
        others = keep(_sets_of(texts, pairs.select(
            F.col("with_doc").alias("doc"), F.col("with_line").alias("line"))), "others").select(
            F.col("doc").alias("with_doc"), F.col("line").alias("with_line"),
            F.col("words").alias("other"))
        met = pairs.join(open_, ["doc", "line", "s1"]).join(others, ["with_doc", "with_line"])
        matched = matched.unionAll(
            _any_match(met.select("doc", "line", "s1", "words", "other"), t)
            .where("matches").select("doc", "line", "s1"))
    return copies.unionAll(matched)


def _without(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts without the lines that are named by number and digest, or by number alone."""
    make_room()
    for texts, numbers, digests in batches:
        array, out = pa.array(texts, pa.string()), list(texts)
        for i, (text, gone, known) in enumerate(zip(texts, numbers, digests)):
            if gone is not None and known is None and text is not None:
                gone = set(map(int, gone))
                out[i] = "\n".join([x for n, x in enumerate(text.split("\n")) if n not in gone])
        for start, end in _portions(array):
            named = {(i, int(n), int(s1)) for i in range(start, end)
                     if numbers[i] is not None and digests[i] is not None
                     for n, s1 in zip(numbers[i], digests[i])}
            if not named:
                continue
            keys = np.array(sorted({i << 32 | n for i, n, _ in named}), dtype=np.int64)
            own = Lines(pa.array(np.arange(start, end)), array.slice(start, end - start),
                        lambda i, n: np.isin(i << 32 | n, keys))
            lost: dict[int, set[int]] = {}
            for i, n, s1 in zip(own.doc.tolist(), own.line.tolist(), own.digests()[0].tolist()):
                if (i, n, s1) in named:
                    lost.setdefault(i, set()).add(n)
            for i, gone in lost.items():
                out[i] = "\n".join([x for n, x in enumerate(out[i].split("\n")) if n not in gone])
        yield pd.Series(out, dtype=object)
        give_back()


def dedup_lines(df: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """``df`` (``doc_id``, ``text`` and any others) without the lines that an earlier line
    matches; all rows and columns stay."""
    ship(df.sparkSession)
    texts = df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    lost = keep(lost_lines(texts, t).withColumn("zero", F.lit(0).cast("bigint")), "lost")
    table = bit_table(lost, "doc", "zero")
    # only where rows share an id, digests tell whose lines are meant
    shared = texts.groupBy(F.col("doc_id").alias("doc")).agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1 AND doc IS NOT NULL").withColumn("zero", F.lit(0).cast("bigint"))
    twice = bit_table(shared, "doc", "zero")

    def in_either(doc: pd.Series) -> pd.Series:
        place = bit_place(doc.to_numpy(dtype=np.int64), np.zeros(1, dtype=np.int64))
        touched, more = [t[place >> 3] >> (place & 7) & 1 for t in (table, twice)]
        return pd.Series(touched + 2 * more).astype("int32")

    perhaps = F.pandas_udf(in_either, "int")
    # by the hints of its arguments called once for each task, not for each batch
    without = F.pandas_udf(_without, "string")
    doc = F.col("doc_id").cast("bigint")
    flagged = df.withColumn("__touched", F.when(doc.isNotNull(), perhaps(F.coalesce(doc, F.lit(0))))
                            .otherwise(0))
    by_doc = lost.groupBy(F.col("doc").alias("__doc")).agg(
        F.collect_list(F.struct("line", "s1")).alias("__lost"))
    touched = F.col("__touched") % 2 == 1
    # merged even if few: what follows a broadcast would need a second Python worker in the task
    cut = flagged.where(touched).join(by_doc.hint("merge"), doc == F.col("__doc"), "left")
    cut = cut.withColumn("text", without(
        F.col("text").cast("string"), F.col("__lost.line"),
        F.when(F.col("__touched") >= 2, F.col("__lost.s1"))))
    return flagged.where(~touched).select(*df.columns).unionAll(cut.select(*df.columns))
