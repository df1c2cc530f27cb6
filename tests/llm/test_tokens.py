"""Token counts, packing and token files against the libraries themselves."""

import collections
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from colloquary.llm import packing, token_counts, token_files
from colloquary.llm.vocabularies import ByteBpe, WordBpe, path_of, word_bpe
from tests.llm.helpers import ODD_TEXTS, documents, odd_rows, prose

PIECES, BYTES, WORDS = (path_of(n) for n in (
    "piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("kind,path", [(ByteBpe, BYTES), (WordBpe, WORDS)])
def test_ids_are_the_library_s(kind, path):
    mine, texts = kind(path), ODD_TEXTS + [prose(s, 200, 5000) for s in range(20)]
    library = Tokenizer.from_file(path)
    for text, raw in zip(texts, mine.encode(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(raw, dtype=np.uint16).tolist() == want, text[:50]


def test_every_byte_token_gives_itself():
    library = Tokenizer.from_file(BYTES)
    bare = Tokenizer(library.model)
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    for token, i in bare.get_vocab().items():
        assert token in special or bare.encode(token).ids == [i]


def test_every_word_token_gives_itself():
    import json

    model = json.load(open(WORDS, encoding="utf-8"))["model"]
    ended = Tokenizer(Tokenizer.from_file(WORDS).model)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
    for token, i in model["vocab"].items():
        if token.startswith("<|"):
            continue
        if token.endswith("</w>"):
            assert ended.encode(token[:-4]).ids == [i]
        else:
            assert inner.encode(token).ids == [i]


def test_a_small_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr("colloquary.llm.vocabularies.LIMIT", 50)
    mine, library = WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for s in range(5):
        text = prose(s, 300)
        raw, = mine.encode([text])
        assert np.frombuffer(raw, np.uint16).tolist() == library.encode(
            text, add_special_tokens=False).ids
    assert len(mine.known) < 1000


@pytest.mark.parametrize("kind,path,special", [
    (ByteBpe, BYTES, "<|endoftext|>"), (WordBpe, WORDS, "<|startoftext|>")])
def test_chunks_are_looked_at_together(monkeypatch, kind, path, special):
    mine, library, asked = kind(path), Tokenizer.from_file(path), []
    odd = mine.odd
    monkeypatch.setattr(mine, "odd", lambda chunk: asked.append(chunk) or odd(chunk))
    plain = [prose(s, 100) for s in range(3)] + ["A.\nB, c... (d). e,.f é. 7. x.,\t$,$ it's."]
    for texts in (plain, ["some " + special + "Text here.", "y" * 1500 + " . end", *plain]):
        asked.clear()
        for text, raw in zip(texts, mine.encode(texts)):
            assert np.frombuffer(raw, np.uint16).tolist() == library.encode(
                text, add_special_tokens=False).ids
        assert bool(asked) == (texts is not plain)


def test_pairs_fit_as_merging_says():
    c, rng = token_counts.PrefixCounter(PIECES), random.Random(1)
    some = [p for p in c.score if len(p) < 8]
    for _ in range(20_000):
        a, b = rng.choice(some), rng.choice(some)
        assert c.fit(a, b) == ([p for p, *_ in c.merged(a + b)] == [a, b])


def test_every_prefix(spark, pieces):
    texts = [t[:300] for t in ODD_TEXTS if t] + [prose(5, 60, 5000), "x " * 40, "   " * 30]
    counter = token_counts.PrefixCounter(PIECES)
    for text, counts in zip(texts, counter.prefixes(texts)):
        assert counts.tolist() == [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]


def test_words_are_cut_where_no_piece_holds_the_neighbours(pieces, monkeypatch):
    counter, solved = token_counts.PrefixCounter(PIECES), []
    solve = counter.solve
    monkeypatch.setattr(counter, "solve", lambda words: solved.extend(words) or solve(words))
    words = ["hello,", "hello.", "hello.\nhello", "hello", "hello...", "hello$$$", "7hello42,"]
    counter.prefixes([" ".join(words)])
    assert solved.count("▁hello") == 1 and not any("lo" in w and w[-1] != "o" for w in solved)
    # signs of all kinds between letters, digits, blanks and line breaks
    rng, texts = random.Random(8), []
    signs = "".join(sorted({c for p in counter.score for c in p if not c.isalnum()})) + "\n\t\x00²´"
    for _ in range(60):
        texts.append("".join(rng.choice([
            rng.choice(signs), rng.choice("abestön "), rng.choice("17 .com's"), rng.choice(
                [".com", "'s", "...", ").", "\n\n", "//", "²", "日", "km²"])]) for _ in range(40)))
    for text, counts in zip(texts, counter.prefixes(texts)):
        assert counts.tolist() == [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]


def test_counts_and_what_they_answer(spark, pieces):
    df = token_counts.prefix_counts(documents(spark, clashing=True), PIECES)
    got = df.select("doc_id", "n_bytes", token_counts.token_count().alias("n"),
                    token_counts.tokens_of_prefix(25).alias("first"),
                    token_counts.longest_prefix(10).alias("fits")).collect()
    want = []
    for doc, text, *_ in odd_rows():
        text = text or ""
        some = [len(pieces.encode(text[:i])) for i in range(min(len(text), 400) + 1)]
        fits = max(i for i, n in enumerate(some) if n <= 10)
        want.append((doc, len(text.encode()), len(pieces.encode(text)),
                     len(pieces.encode(text[:25])), fits))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.prefix_counts(documents(spark, []), PIECES).count() == 0


def _ids(text, library):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_loses_and_pads_nothing_much(spark):
    rows = odd_rows() + [(1000 + i, prose(i, 3 ** (i % 8)), "en", "s", 0) for i in range(60)]
    got = packing.pack_documents(documents(spark, rows, clashing=True), BYTES,
                                 pack_tokens=20_000).collect()
    library = Tokenizer.from_file(BYTES)
    # every id of every row once
    held = collections.Counter()
    for r in got:
        held[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    by_text = collections.Counter((doc, text) for doc, text, *_ in rows)
    assert sum(r.length for r in got) == sum(len(_ids(t, library)) for _, t, *_ in rows)
    for doc, text in by_text:
        ids = np.array(_ids(text, library), dtype="<u4")
        mine = [k for k in held if k[0] == doc and k[4] == len(ids)
                and zlib.crc32(ids[k[1]:k[1] + k[2]].tobytes()) == k[3]]
        covered = collections.Counter()
        for k in mine:
            for i in range(k[1], k[1] + k[2]):
                covered[i] += held[k]
        assert set(covered) == set(range(len(ids)))
    # sequences: gapless, not too long, of a tier's length but for the last of a pack
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length, r.tier, r.step_group))
    short = 0
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([n for _, n, *_ in parts])
        assert [o for o, *_ in parts] == [0, *ends[:-1]] and ends[-1] <= parts[0][2] <= 2048
        assert len({p[2:] for p in parts}) == 1
        short += ends[-1] < parts[0][2]
    assert short <= 3 * 5  # packs
    assert packing.pack_documents(documents(spark, []), BYTES).count() == 0


def test_step_groups_cost_the_same():
    rng = random.Random(3)
    costs = [rng.randint(1, 1000) ** 2 for _ in range(4000)]
    groups = packing.step_groups(costs, [2048] * 4000)
    sums = collections.Counter()
    for c, g in zip(costs, groups):
        sums[g] += c
    assert len(sums) == 125 and max(sums.values()) < 1.05 * min(sums.values())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 129, 5000, 70_000])
def test_a_block_comes_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 999).astype(np.uint16)
    table = token_files.Table.scaled(np.bincount(ids, minlength=1000))
    payload = token_files.encode(ids, table, lanes=64, every=8192)
    assert (token_files.decode(payload, table) == ids).all()
    if n:
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            token_files.decode(bytes(broken), table)


def test_table_of_extremes():
    for counts in (np.zeros(49408, int), np.eye(1, 49408, 5, dtype=int)[0] * 10 ** 15,
                   np.arange(49408) ** 3):
        table = token_files.Table.scaled(counts)
        ids = np.arange(49408).astype(np.uint16)
        assert (token_files.decode(token_files.encode(ids, table), table) == ids).all()


def test_token_file_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART", 20_000)
    df, folder = documents(spark, [r for r in odd_rows() if r[0] is not None], True), str(
        tmp_path / "f")
    token_files.write_token_file(df, folder, WORDS, 49_408)
    got = sorted(map(tuple, token_files.read_token_file(spark, folder).collect()),
                 key=lambda r: r[1])
    library, start = Tokenizer.from_file(WORDS), 0
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    want = collections.Counter()
    for doc, text, *_ in odd_rows():
        if doc is not None:
            ids = np.array(_ids(text, library), dtype="<u4")
            want[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((d, n, c) for d, _, n, c in got) == want
    for _, s, n, _ in got:
        assert s == start
        start += n


def test_empty_token_file(spark, tmp_path):
    folder = str(tmp_path / "f")
    token_files.write_token_file(documents(spark, []), folder, WORDS, 49_408)
    assert token_files.read_token_file(spark, folder).count() == 0


def test_letters_are_lowered_as_the_library_does():
    """Marks join some letters of one case only; special strings are in lower case."""
    path = path_of("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["J̌ Å ÀÉ Straße İI", "THE The the, THE.", "<|STARTOFTEXT|> A",
             "x<|endoftext|>Y", "ΑΣ ǅ K", "Don'T I'LL",
             "a, b. c., d,. e5. é, .f, g,h.i x,\n y.\x1c z.\xa0 it's. 's, 1,"]
    for text, ids in zip(texts, word_bpe(path).encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(
            text, add_special_tokens=False).ids
