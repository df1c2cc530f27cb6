"""Operator 3: quality rules with compression bands.

Base rules: a text fails with fewer than ``MIN_WORDS`` words, or if more than
``MAX_REPEATED`` percent of its words stand in a window of ``WINDOW`` words that the text
has twice or more.

Compression bands: the whole text and each fixed chunk of ``CHUNK`` bytes are compressed
with zstandard.  How well plain prose compresses depends on its length, so the limits do
too (``BANDS``).  A ratio above the band means repetition, one below it means characters
without any pattern, such as encoded data.  The whole text must lie in its band; so must
at least half of its chunks, since a long text may hide much of either kind behind a
good average.

Null and empty texts have no words and fail.  Each text is judged alone: nothing is
shuffled.  Texts are UTF-8; words are runs of anything but the six ASCII blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquary.llm.common import BLANKS, arrow_schema, in_batches, rows

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
CHUNK = 2048  # bytes; the rest behind the last chunk counts as one from half of that on
LEVEL = 3

# From so many bytes on: lowest and highest ratio of a good text.
BANDS = [(0, 0.0, 2.5), (128, 0.9, 2.6), (256, 1.1, 2.8), (512, 1.25, 3.0), (1024, 1.38, 3.3),
         (2048, 1.38, 3.6), (8192, 1.38, 4.2), (32768, 1.38, 5.0), (262144, 1.38, 6.0)]

SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
          "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
          "ratio double, chunks int, chunks_outside int")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window that occurs twice or more in the list."""
    n = len(words)
    if n < window + 1:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    # number the windows, one word longer at a time, so that numbers stay small
    runs, kinds = ids, len(number)
    for k in range(1, window):
        runs = runs[:-1] * len(number) + ids[k:]
        kinds *= len(number)
        if kinds >= 2**62 // len(number) or k == window - 1:
            _, runs, count = np.unique(runs, return_inverse=True, return_counts=True)
            kinds = len(count)
            if kinds == len(runs):
                return 0  # all runs of this length differ, and so do longer ones
    twice = count[runs] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(window):
        inside[k:k + len(twice)] |= twice
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def outside(ratio: float, size: int, bands=BANDS) -> bool:
    low, high = next((a, b) for least, a, b in reversed(bands) if size >= least)
    return not low <= ratio <= high


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, press = arrow_schema(SCHEMA), zstandard.ZstdCompressor(level=LEVEL)

    def judge(doc, text):
        text = text or ""
        raw = text.encode()
        words = raw.split()
        repeat = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEATED * len(words)
        ratio = len(raw) / len(press.compress(raw)) if raw else 0.0
        parts = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) > CHUNK else []
        if parts and len(parts[-1]) < CHUNK // 2:
            parts.pop()
        bad = sum(outside(len(p) / len(press.compress(p)), len(p)) for p in parts)
        good = not failed and not outside(ratio, len(raw)) and 2 * bad <= len(parts)
        return (doc, len(words), len(text) - sum(map(text.count, BLANKS)),
                sum(map(text.count, SYMBOLS)), repeated_lines(text), repeat, failed, good, ratio,
                len(parts), bad)

    for docs, texts in rows(batches):
        out = zip(*map(judge, docs, texts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)


def judge_texts(df: DataFrame) -> DataFrame:
    """Per row of ``doc_id, text``: the counts, ``base_failed``, ``kept``, and the figures
    behind the verdict (``ratio, chunks, chunks_outside``)."""
    return in_batches(df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
                      _judged, SCHEMA)
