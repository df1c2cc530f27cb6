"""The prefix trie against one built plainly."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquary.llm import prefix_trie
from colloquary.plans.skew import HotSplit

ROWS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def plain(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in said.items()}
    nodes: dict = defaultdict(list)
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        below = children[key]
        leaves[key] = sum(leaves[k] for k in below) or 1
        saved[key] = sum(saved[k] for k in below) + (
            (len(nodes[key]) - 1) * len(key[-1][1]) if key else 0)
    for key, members in nodes.items():
        ends = sorted(c for c in members if len(whole[c]) == len(key))
        yield (min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
               len(children[key]), leaves[key], saved[key],
               hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())


def talk(seed, n, vocabulary=4):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 5 * n), n):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), "éa" * rng.randint(0, vocabulary)))
    return rows


ODD = [(None, 1, "user", "nobody's"), (0, None, None, None), (0, None, "user", "second"),
       (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "a", "x"), (7, 3, "user", ""),
       (7, -3, "user", "🙂"), (205, 1, "user", "no first conversation here"), (-5, 1, "b", "y"),
       (-5, 1, "b", "y"), (-200, 9, "b", "y")]


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    found = prefix_trie.prefix_trie(df, **how)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                             "n_leaves", "saved_tokens", "ends_sha256"]
    assert [t for _, t in found.dtypes[:7]] == ["bigint"] * 7
    order = lambda r: (r[1], r[0], r[7])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(plain(rows), key=order)


@pytest.mark.parametrize("how", [
    {}, {"few": 5, "part": 40, "ids": 3, "stretch": 3, "split": HotSplit(share=20, min_rows=5)}])
def test_against_plain(spark, how):
    check(spark, ODD + talk(1, 150), **how)


def test_one_long_conversation_and_one_busy_node(spark):
    """A third of all turns in one conversation, a third of conversations that start alike."""
    rows = [(12, t, "user", f"turn {t % 7}") for t in range(400)]
    rows += [(1000 + i, t, "user", "hello" if t == 0 else f"{i}-{t}")
             for i in range(200) for t in range(2)]
    rows += [(3000 + i, t, "user", "hello") for i in range(60) for t in range(6)]
    check(spark, rows, few=20, part=100, ids=7, stretch=50,
          split=HotSplit(share=50, min_rows=10))


def test_nothing(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])
    check(spark, [(205, None, None, None)])  # a conversation may lose all its turns


def test_other_columns(spark):
    df = spark.createDataFrame(ODD, ROWS).withColumns({
        name: F.lit("x") for name in ("depth", "k1", "place", "h", "from", "c")})
    assert prefix_trie.prefix_trie(df).count() == len(list(plain(ODD)))


def test_rounds_by_coin_alone_end(spark):
    """A list whose neighbours have nothing in common is ranked all the same."""
    rng = random.Random(4)
    ids = [(rng.randrange(10**12), 0) for _ in range(300)]
    arcs = [(*a, *b, 1, i) for i, (a, b) in enumerate(zip(ids, [*ids[1:], (None, None)]))]
    rng.shuffle(arcs)
    df = spark.createDataFrame(arcs, "c bigint, e bigint, nc bigint, ne bigint, "
                                     "leaves bigint, saved bigint")
    found = {r["c"]: (r["leaves"], r["saved"]) for r in prefix_trie.rank(df, 30, 10).collect()}
    assert found == {c: (i, i * (i - 1) // 2) for i, (c, _) in enumerate(ids)}
