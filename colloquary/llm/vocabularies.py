"""Token ids of whole texts from two public tokenizers, quickly and exactly.

A text is cut where no token can reach across, and each distinct chunk is encoded once
and remembered.  Chunks go through tiktoken's merging loop, which merges whatever pair
makes a known token.  The ``tokenizers`` library merges listed pairs only; both agree if
every token of the vocabulary, encoded on its own, gives itself (then, when all merges
of lower rank are done, two neighbours that make a known token can only be its listed
pair).  ``tests/llm`` checks that for every token.  Chunks that hold a special string or
are very long go to the ``tokenizers`` library itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from array import array
from functools import cache
from itertools import islice

import numpy as np
import regex

from colloquary.llm.common import remembered

LIMIT = 400_000  # remembered chunks per worker
LONG = 1_000  # characters; longer chunks are rare and not remembered

# Fixed values of the public word vocabulary
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# a single stop or comma between a plain letter or digit and a blank
# (the sign first: that is what a search can skip to)
_STOP = re.compile(rb"[.,](?<=[a-z0-9].)(?![^ \t\n\x0b\x0c\r])")


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for
    themselves, the others numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Remembered:
    """Base of both: chunk -> its ids as bytes, two for each id."""

    special: tuple[str, ...]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.known: dict = {}

    def cut(self, text: str) -> list:
        raise NotImplementedError

    def encode_new(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def odd(self, chunk: str) -> bool:
        return len(chunk) > LONG or any(s in chunk for s in self.special)

    def spelled(self, chunks: list) -> list[str]:
        """Chunks as strings."""
        return chunks

    def by_library(self, chunk: str) -> bytes:
        return array("H", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as unsigned 16-bit integers; a null text is empty."""
        cut = [self.cut(t) if t else [] for t in texts]
        known = self.known
        new = set().union(*cut).difference(known) if cut else ()
        once = {}
        if new:
            new = list(new)
            named = self.spelled(new)
            together = "\n".join(named)  # one look at all of them mostly tells that none is odd
            if max(map(len, named)) > LONG or any(s in together for s in self.special):
                once = {c: self.by_library(s) for c, s in zip(new, named) if self.odd(s)}
                new = [c for c in new if c not in once]
                named = self.spelled(new)
            known.update(zip(new, self.encode_new(named)))
        if once:
            whole = [b"".join([known[c] if c in known else once[c] for c in x]) for x in cut]
        else:
            whole = [b"".join(map(known.__getitem__, x)) for x in cut]
        if len(known) > LIMIT:  # what came first is what is frequent
            self.known = dict(islice(known.items(), LIMIT // 2))
        return whole


class ByteBpe(Remembered):
    """The byte-level vocabulary of 50,257 ids."""

    def __init__(self, path: str):
        super().__init__(path)
        import public_tokenizers
        import tiktoken

        with open(path_of("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merging = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN,
                                         mergeable_ranks=ranks, special_tokens={})

    def cut(self, text: str) -> list[str]:
        """Before each blank that follows a character that is not white space.

        No token reaches over such a place, and matching starts afresh there.
        """
        parts = text.split(" ")
        chunks, held = [], parts[0]
        for part in parts[1:]:
            if held and not held[-1].isspace():
                chunks.append(held)
                held = " " + part
            else:
                held += " " + part
        chunks.append(held)
        return chunks

    def encode_new(self, chunks: list[str]) -> list[bytes]:
        encode = self.merging.encode_ordinary
        return [array("H", encode(c)).tobytes() for c in chunks]


class WordBpe(Remembered):
    """The lower-cased vocabulary of 49,408 ids, whose words end in a mark."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        self.words = regex.compile(WORD_PATTERN)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of = {letter: bytes([b]) for b, letter in byte_letters().items()}

        def spelled(token: str) -> bytes:
            # a blank stands for the mark: no word holds one
            body, end = (token[:-4], b" ") if token.endswith(WORD_END) else (token, b"")
            return b"".join(byte_of[c] for c in body) + end

        # letters come first, then letters with the mark, then the merges in their order
        order = [bytes([b]) for b in range(256)]
        order += [bytes([b]) + b" " for b in range(256) if b != 32]
        order += [spelled(a) + spelled(b) for a, b in (
            m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        self.merging = tiktoken.Encoding(
            "word", pat_str="[^ ]+ ", mergeable_ranks={b: i for i, b in enumerate(order)},
            special_tokens={})
        ids = {spelled(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.id_of = np.array([ids.get(b, 0) for b in order], dtype=np.uint16)
        self.ends = np.array([b.endswith(b" ") and b != b" " for b in order])

    def cut(self, text: str) -> list[bytes]:
        raw = text.encode()
        # Letters are lower-cased anyway; done here, fewer chunks are new.  Not so where there
        # may be special strings, or marks (U+0300 to U+036F begin with these bytes), which
        # join some letters of one case only.
        as_it_is = b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw
        # and what ends a sentence or clause is a word of its own, so words with and without
        # are the same chunk
        return (raw if as_it_is else _STOP.sub(rb" \g<0>", raw.lower())).split()

    def spelled(self, chunks: list) -> list[str]:
        return [c.decode() for c in chunks]

    def encode_new(self, chunks: list[str]) -> list[bytes]:
        # upper and lower case are told apart by letter, not by what stands around them
        plain = [s.lower() if s.isascii() else
                 "".join(map(str.lower, unicodedata.normalize("NFC", s))) for s in chunks]
        find = self.words.findall
        # letters alone are one word
        lowered = [[s] if s.isascii() and s.isalpha() else find(s) for s in plain]
        ranks = np.asarray(self.merging.encode_ordinary(
            "".join([w + " " for words in lowered for w in words])), dtype=np.int64)
        ids, ends = self.id_of[ranks], np.flatnonzero(self.ends[ranks]) + 1
        words_before = np.cumsum([0] + [len(words) for words in lowered])
        places = np.concatenate(([0], ends))[words_before] * 2
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


remembered += [byte_bpe.cache_clear, word_bpe.cache_clear]
