"""Rows that every operator must stand, and brute-force versions to compare with."""

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_id", "_text", "_key", "_row", "fp", "spans", "ids", "n", "key", "root", "items", "part", "spots")


def odd_rows():
    """Nulls in every column, empty and white texts, ties, repeated rows, one very long text."""
    word = random.Random(5)
    long = " ".join(word.choice("alpha beta gamma delta epsilon zeta".split()) + str(word.randrange(400)) for _ in range(30_000))
    texts = [None, "", "  \n\t ", "one", "One two", "x" * 5000, "é Ü ß 漢字 ΑΣ", "a b c d e", long, long[: len(long) // 2]]
    rows = [(i, t, "en", "s1", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s1", 3), (3, "one", "en", "s1", 3), (4, "another text", None, None, None)]
    return rows + [(None, "no id", "fr", None, 5), (None, None, None, None, None)]


def frame(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in CLASHING}) if clashing else df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def grouped(ids, linked):
    """Smallest id reachable, by trying all pairs."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def copied_texts(seed, n, alphabet="abcd", most=25):
    """Texts that borrow stretches from earlier ones."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        text = []
        for _ in range(rnd.randint(0, 6)):
            if out and rnd.random() < 0.6:
                other = rnd.choice(out).split()
                at = rnd.randint(0, max(0, len(other) - 1))
                text += other[at:at + rnd.randint(1, most)]
            else:
                text += [rnd.choice(alphabet) for _ in range(rnd.randint(1, 15))]
        out.append(" ".join(text))
    return out
