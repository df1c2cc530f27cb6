"""Operator 1: exact token counts of a text and of every prefix of it.

Prefix dynamic programming.  The encoding of a prefix ends in exactly one token, and
without that token it is the encoding of a shorter prefix.  Which token that is can be
decided locally: two neighbours stand in an encoding if and only if the pair, encoded on
its own, gives just these two.  So each prefix looks at the tokens that end there and
takes the one that fits behind the last token of the prefix before it; its count is that
prefix's count plus one.  No piece of the vocabulary goes on over a blank, therefore each
distinct word is remembered, and counts of words are added up.  Nor does any hold certain
neighbours, such as a letter and then a full stop; a new word is cut there, and each distinct
chunk is solved once.

``prefix_tokens[i]`` is the number of tokens of the first i characters, for i = 0 up to
the length of the text.  Truncation and budget questions are answered from it without
encoding anything (``tokens_of_prefix``, ``longest_prefix``).  The count may fall from one
prefix to the next, when a longer token comes to fit.

Null texts count as empty: one entry, 0.  Nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache, partial
from itertools import islice
from math import inf
from operator import sub
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquary.llm.common import arrow_schema, in_batches, remembered, rows

SPACE = "▁"  # fixed value: how the vocabulary writes a blank
WORDS = 500_000  # remembered per worker, and as many chunks and pairs
ROWS = 512  # texts whose new words are solved together; the more, the more they share
FLUSH = 2_000_000  # characters in a batch that goes back to Spark
LONG = 200  # characters; longer words are not remembered

_RUN = re.compile(f"{SPACE}+[^{SPACE}]*")


class PrefixCounter:
    """Token counts of all prefixes under a sentence-piece vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        # only these are found in texts; bytes and control pieces are not
        self.score = {
            library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size())
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)
                    or library.is_unused(i))}
        self.chunk = self.chunk_pattern()
        self.chunks: dict[str, bytes] = {}
        self.edges: dict[str, tuple[list, list]] = {}
        self.steps: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def chunk_pattern(self) -> re.Pattern:
        """Matches the chunks of a word, one after the other.

        Two tokens of which one ends and the other begins with neighbours that no piece holds
        always fit, so what stands behind them doesn't depend on what stands before.
        """
        before = {(p[i], p[i + 1]) for p in self.score for i in range(len(p) - 1)}
        held = {c for pair in before for c in pair}
        alone = {c for c in map(chr, range(128)) if c not in held}
        # signs that no piece holds behind anything but another one, or a blank
        first = {c for c in held if not c.isalpha() and not c.isdecimal() and c != SPACE}
        while lost := {b for a, b in before if b in first and a not in first and a != SPACE}:
            first -= lost
        one, some = [("[" + "".join(map(re.escape, sorted(x))) + "]") if x else "(?!)"
                     for x in (alone, first)]
        other = "[^" + "".join(map(re.escape, sorted(alone | first))) + SPACE + "]"
        return re.compile(f"{SPACE}*(?:{some})*{other}+|{SPACE}*(?:{some})+|{SPACE}+|{one}")

    def merged(self, text: str) -> list:
        """Merge the best-scored pair, the leftmost of equals, until none is left.

        What comes out are (text, left part, right part), parts being None for a character.
        """
        parts, score = [(c, None, None) for c in text], self.score
        while len(parts) > 1:
            best, place = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i][0] + parts[i + 1][0])
                if s is not None and (best is None or s > best):
                    best, place = s, i
            if place < 0:
                break
            left, right = parts[place], parts[place + 1]
            parts[place:place + 2] = [(left[0] + right[0], left, right)]
        return parts

    def edge(self, token: str) -> tuple[list, list] | None:
        """The parts at the left and at the right end of a token while it was merged, each as
        (text, score at which it came up, score at which it went into a larger part); None
        for a token that, encoded on its own, gives others."""
        if token not in self.edges:
            parts, out = self.merged(token), None
            if len(parts) == 1:
                out = ([], [])
                for side, seen in ((1, out[0]), (2, out[1])):
                    part, gone = parts[0], -inf
                    while part:
                        made = inf if part[1] is None else self.score[part[0]]
                        seen.append((part[0], made, gone))
                        part, gone = part[side], made
            self.edges[token] = out
        return self.edges[token]

    def fit(self, left: str, right: str) -> bool:
        """Whether the two can stand side by side; ``left`` is empty at a word's start.

        They cannot if a part at the right end of the one and a part at the left end of the
        other are there at the same time and merge before either goes into a larger part.
        """
        held = self.pairs.get((left, right))
        if held is None:
            held = self.edge(right) is not None and (not left or self.edge(left) is not None)
            if held and left:
                get = self.score.get
                for a, made_a, gone_a in self.edge(left)[1]:
                    for b, made_b, gone_b in self.edge(right)[0]:
                        s = get(a + b)
                        # of equal scores the leftmost goes first
                        if (s is not None and s > gone_a and s >= gone_b
                                and made_a > gone_b and made_b > gone_a):
                            held = False
            self.pairs[left, right] = held
        return held

    def solve(self, words: list[str]) -> list[bytes]:
        """For each word by how much the count rises or falls with each character, as signed
        bytes.  Of sorted words only what differs from the one before is worked out."""
        score, pairs, fit = self.score, self.pairs, self.fit
        last, count, rise, out, known = [""], [0], [], [], ""
        for word in words:
            same = len(commonprefix((known, word)))
            known = word
            del last[same + 1:], count[same + 1:], rise[same:]
            for end in range(same + 1, len(word) + 1):
                for start in range(end - 1, -1, -1):
                    token = word[start:end]
                    if token in score or start == end - 1:
                        before = last[start]
                        fits = pairs.get((before, token))
                        # one token at most fits, so the first found is it
                        if fits or fits is None and fit(before, token):
                            break
                else:
                    raise ValueError(f"no token ends at {end} of {word!r}")
                last.append(token)
                # a character that the vocabulary lacks is spelled in bytes
                n = count[start] + (1 if token in score else len(token.encode()))
                rise.append(n - count[-1])
                count.append(n)
            out.append(array("b", rise).tobytes())
        return out

    def learn(self, words: list[str]) -> None:
        """Put words that are new into ``steps``."""
        cut, chunks = list(map(self.chunk.findall, words)), self.chunks
        new = sorted(set().union(*cut).difference(chunks))
        chunks.update(zip(new, self.solve(new)))
        known = chunks.__getitem__
        self.steps.update(zip(words, [b"".join(map(known, x)) for x in cut]))
        for chunk in new:
            if len(chunk) > LONG:
                del chunks[chunk]
        if len(chunks) > WORDS:
            self.chunks = dict(islice(chunks.items(), WORDS // 2))

    def prefixes(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [_RUN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        steps, out = self.steps, []
        new = list(set().union(*cut).difference(steps))
        self.learn(new)
        for words in cut:
            rise = np.frombuffer(b"".join(map(steps.__getitem__, words)), dtype=np.int8)
            counts = np.cumsum(rise, dtype=np.int32) if words else np.zeros(1, dtype=np.int32)
            # the blank that the vocabulary puts in front is no character of the text
            counts[0] = 0
            out.append(counts)
        for word in new:
            if len(word) > LONG:
                del steps[word]
        if len(steps) > WORDS:  # what came first is what is frequent
            self.steps = dict(islice(steps.items(), WORDS // 2))
        if len(self.pairs) > WORDS:
            self.pairs = dict(islice(self.pairs.items(), WORDS // 2))
        return out


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


remembered.append(counter.cache_clear)


def _count(batches: Iterator[pa.RecordBatch], path: str, schema: str) -> Iterator[pa.RecordBatch]:
    count, kind = counter(path), arrow_schema(schema)

    def batch(ids, sizes, parts):
        ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind.field(0).type), pa.array(sizes, pa.int64()), lists],
            names=kind.names)

    ids, sizes, parts, held = [], [], [], 0
    for some_ids, texts in rows(batches, ROWS):
        for key, text, counts in zip(some_ids, texts, count.prefixes(texts)):
            ids.append(key)
            sizes.append(len(text.encode()) if text else 0)
            parts.append(counts)
            held += len(counts)
            if held > FLUSH:
                yield batch(ids, sizes, parts)
                ids, sizes, parts, held = [], [], [], 0
    if ids:
        yield batch(ids, sizes, parts)


def prefix_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``prefix_tokens`` of each text, under the vocabulary
    at ``path``.  Other columns, whatever their names, are not looked at."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, prefix_tokens array<int>"
    return in_batches(df.select(key, F.col(text).cast("string")),
                      partial(_count, path=path, schema=schema), schema)


def token_count(prefix_tokens: str | Column = "prefix_tokens") -> Column:
    """Tokens of the whole text."""
    return F.element_at(prefix_tokens, -1).cast("bigint")


def tokens_of_prefix(chars: int | Column, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the first ``chars`` characters; of the whole text if it is shorter."""
    place = F.least(F.lit(chars) if isinstance(chars, int) else chars,
                    F.size(prefix_tokens) - F.lit(1))
    return F.element_at(prefix_tokens, (place + 1).cast("int")).cast("bigint")


def longest_prefix(budget: int | Column, prefix_tokens: str = "prefix_tokens") -> Column:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(prefix_tokens, lambda n: n <= limit)
    return (F.size(prefix_tokens) - F.array_position(F.reverse(fits), F.lit(True))).cast("bigint")
