import random

import pytest

from alertloom.llm import relative_lz
from tests.llm.helpers import copied_texts, frame, odd_rows, words


def brute(rows, window):
    first, out = {}, []
    for i, text in rows:
        if i is not None:
            w = words(text)
            for p in range(len(w) - window + 1):
                k = tuple(w[p:p + window])
                first[k] = min(first.get(k, i), i)
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def found(df, window):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in
                   relative_lz.repeated_words(df, window=window).collect()), key=str)


@pytest.mark.parametrize("window", [5, 12, 50])
def test_random_copies(spark, window):
    texts = copied_texts(window, 250, most=3 * window)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts)]
    assert found(frame(spark, rows), window) == brute([r[:2] for r in rows], window)


def test_odd_rows(spark):
    rows = odd_rows()
    assert found(frame(spark, rows, clashing=True), 50) == brute([r[:2] for r in rows], 50)
    assert found(frame(spark, []), 50) == []


def test_a_passage_with_many_neighbours_is_cut_everywhere_but_first(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{'a' * (i + 1)} b{i} {passage} c{i} d", "en", "s", 0) for i in range(40)]
    got = found(frame(spark, rows), 50)
    assert got == brute([r[:2] for r in rows], 50)
    assert sorted(r[2] for r in got) == [0] + [60] * 39


def test_rows_without_repeats_keep_their_columns(spark):
    rows = odd_rows()
    docs = frame(spark, rows, clashing=True)
    got = relative_lz.without_repeats(docs)
    assert got.columns == docs.columns
    want = [(r, b) for r, b in zip(sorted(rows, key=lambda r: str((r[0], len(words(r[1]))))), [None] * len(rows))]
    kept = {(i, n): (g, t) for i, n, g, t in brute([r[:2] for r in rows], 50)}
    expected = []
    for (i, text, *_), _b in want:
        gone, left = kept[i, len(words(text))]
        if not gone:
            expected.append((i, text))
        elif left:
            expected.append((i, left))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert all(r.n_chars == len(r.text) for r in got.where("text is not null and n_chars is not null").collect())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs, 50) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)
