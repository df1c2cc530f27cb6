"""Small tables with everything awkward in them."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

# names that operators use themselves
CLASHING = ["size", "n", "block", "line", "doc", "fp", "low", "label", "words", "taken", "score"]

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
             for _ in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(rng.choice(known) + (".\n" if rng.random() < 0.05 else "," * (
            rng.random() < 0.05)))
    return " ".join(out)


ODD_TEXTS = [
    None, "", " \n\t ", "one", "two words", "x" * 5000, "word " * 3000, "\n" * 500,
    "é ́ ﬁ Ａ　日本語 🙂\x00", "  lead  and   trail  ", "a\x1cb\xa0c d\x85e",
    "<s>▁x▁ y</s><|endoftext|> <unk>", "don't I'LL we'Re ΑΣ İ", "A\nB\nA\n\nB \nA",
]


def odd_rows():
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(ODD_TEXTS)]
    long = prose(1, 40_000, 3000)
    rows += [(100, long, "en", None, len(long)), (101, prose(2, 300), None, "", 0),
             (101, prose(2, 300), None, "", 0), (101, prose(3, 50), None, "t", 0),
             (None, prose(4, 60), "en", "s", 0), (None, None, None, None, None),
             (7, ODD_TEXTS[7], "en", "s", 500), (-3, prose(2, 300), "de", "é", 1)]
    return rows


def documents(spark, rows=None, clashing=False):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCUMENTS).repartition(3)
    if clashing:
        for name in CLASHING:
            df = df.withColumn(name, df["lang"])
    return df


def simple(spark, texts, start=0):
    return documents(spark, [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, start)])


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))
