import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from alertloom.llm import best_fit, mixture_packing
from alertloom.llm.tokens import WordTokens, tokenizer_path
from tests.llm.helpers import frame, odd_rows

REFERENCE = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("most", [400_000, 0])
def test_tokens_equal_the_tokenizers_own(most):
    own = WordTokens(tokenizer_path(), most)
    texts = ["", "a\x1cb c", "İ, ΑΣ Σ. don't it's <|endoftext|> x<|startoftext|>,y", "é, é ́ z", "１２ 3x,. ''s 's! 1's",
             "Ünï!! ´ǅ..", "a b", "ﬁ, K.", "漢字,かな。 ok", "<|ENDOFTEXT|> DON'T 'LL 'llx", "it’s – “so” …", "٣x ²y", "ำ ักa"]
    texts += [t or "" for _, t, *_ in odd_rows()]
    for text in texts:
        assert np.frombuffer(own.encode([text.encode()])[0], "<u2").tolist() == ids_of(text), text[:40]


def test_best_fit_is_that_of_a_plain_search():
    rnd = random.Random(1)
    for _ in range(60):
        capacity = rnd.choice([1, 5, 16, 100])
        sizes = [rnd.randint(1, capacity) for _ in range(150)]
        bins = []
        for p in sorted(range(150), key=lambda i: (-sizes[i], i)):
            room = [(capacity - sum(sizes[j] for j in b), k) for k, b in enumerate(bins)]
            room = [r for r in room if r[0] >= sizes[p]]
            bins[min(room)[1]].append(p) if room else bins.append([p])
        got = best_fit.best_fit_decreasing(sizes, capacity)
        assert sorted(x for b in got for x in b) == list(range(150))
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(sum(sizes[i] for i in b) for b in bins)


def test_best_fit_round_trip(spark, tmp_path):
    rows = odd_rows()
    packed = best_fit.pack(frame(spark, rows, clashing=True), length=64, group_ids=5_000)
    got = {}
    for r in packed.collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        cuts = r.cumulative_lengths
        assert len(ids) == len(places) == 64 and cuts[0] == 0 and cuts[-1] == r.n_tokens and not ids[r.n_tokens:].any()
        for a, b, i, start in zip(cuts, cuts[1:], r.doc_ids, r.doc_starts):
            assert places[a:b].tolist() == list(range(b - a))
            got.setdefault((i, start), []).append(ids[a:b].tolist())
    want = {}
    for i, text, *_ in rows:
        ids = ids_of(text)
        for at in range(0, len(ids), 64):
            want.setdefault((i, at), []).append(ids[at:at + 64])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    back = best_fit.segments(packed).collect()
    assert sorted(np.frombuffer(r.ids, "<u2").tolist() for r in back) == sorted(x for v in want.values() for x in v)
    best_fit.write_matrices(packed, str(tmp_path / "m"), rows=16)
    blocks = spark.read.parquet(str(tmp_path / "m")).collect()
    assert sum(b["rows"] for b in blocks) == packed.count() and all(len(b.ids) == 128 * b["rows"] for b in blocks)
    assert best_fit.pack(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="16 bits"):
        best_fit.pack(frame(spark, rows), length=65_537)


def check_pieces(rows, pieces, length):
    want = sorted((str(i), ids_of(t)) for i, t, *_ in rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(ids.tobytes()) == p.ids_crc32
        by_doc.setdefault((str(p.doc_id), p.doc_tokens), []).append((p.start, ids.tolist()))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    if len({i for i, _ in want}) == len(want):
        got = sorted((i, sum((ids for _, ids in sorted(v)), [])) for (i, _), v in by_doc.items())
        assert got == want
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)
    for n, spots in by_sequence.items():
        at = 0
        for offset, size in sorted(spots):
            assert offset == at
            at += size
        assert at == length or n == max(by_sequence)


def mixed_rows(n=400, sources=("big",) * 6 + ("mid",) * 3 + ("low",), words=300, seed=2):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(["red", "green", "blue"]) for _ in range(rnd.randint(0, words))), "en", rnd.choice(sources), 0)
            for i in range(n)]


def round_robin(totals, weights, length):
    """Ids that every queue has served after every window, by crediting the active queues in small steps of time."""
    credit, served = {q: Fraction(0) for q in totals}, []
    while any(credit[q] < totals[q] for q in totals):
        left = Fraction(length)
        while left and (active := [q for q in totals if credit[q] < totals[q]]):
            rate = sum(weights[q] for q in active)
            step = min(left / rate, *((totals[q] - credit[q]) / weights[q] for q in active))
            for q in active:
                credit[q] += weights[q] * step
            left -= rate * step
        served.append({q: min(totals[q], int(credit[q] + Fraction(1, 2))) for q in totals})
    return served


def test_mixture_equals_a_sequential_round_robin(spark):
    rows = mixed_rows()
    docs = frame(spark, rows)
    source = {r[0]: r[3] for r in rows}
    for weights in (None, {"big": 1, "mid": 1, "low": 1}, {"big": 3, "mid": 1, "low": 4}):
        pieces = mixture_packing.pack(docs, length=512, weights=weights).collect()
        check_pieces(rows, pieces, 512)
        totals = {s: sum(p.length for p in pieces if source[p.doc_id] == s) for s in ("big", "low", "mid")}
        served = round_robin(totals, {s: Fraction(w) for s, w in (weights or totals).items()}, 512)
        line = [s for now, past in zip(served, [dict.fromkeys(totals, 0), *served]) for s in totals for _ in range(now[s] - past[s])]
        got = {(p.sequence_id * 512 + p.offset + i): source[p.doc_id] for p in pieces for i in range(p.length)}
        assert [got[i] for i in range(len(line))] == line


def test_every_window_meets_its_target_until_a_queue_runs_dry(spark):
    names = [f"s{i:02}" for i in range(20)]
    rows = mixed_rows(1500, [n for i, n in enumerate(names) for _ in range(i + 1)], 200, 7)
    docs, source = frame(spark, rows), {r[0]: r[3] for r in rows}
    for options in ({}, {"temper": 0.5}, {"weights": {n: 1 + i % 5 for i, n in enumerate(names)}}, {"temper": 0.7, "queues": 6}):
        pieces = mixture_packing.pack(docs, length=2048, **options).collect()
        check_pieces(rows, pieces, 2048)
        if "queues" in options:
            continue
        ids = {s: sum(p.length for p in pieces if source[p.doc_id] == s) for s in names}
        weight = options.get("weights") or {s: n ** options.get("temper", 1) for s, n in ids.items()}
        dry = int(min(ids[s] / weight[s] for s in names) * sum(weight.values()) // 2048)
        assert dry >= 5
        for n in range(dry):
            here = {s: sum(p.length for p in pieces if p.sequence_id == n and source[p.doc_id] == s) / 2048 for s in names}
            assert sum(abs(here[s] - weight[s] / sum(weight.values())) for s in names) / 2 < 0.02


def test_mixture_of_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows, clashing=True)
    pieces = mixture_packing.pack(docs, length=2048).collect()
    check_pieces(rows, pieces, 2048)
    assert {p.doc_id for p in pieces} == {r[0] for r in rows}
    unique = [r for r in rows if r[0] not in (3, 4, None)]
    check_pieces(unique, mixture_packing.pack(frame(spark, unique), length=2048).collect(), 2048)
    assert mixture_packing.pack(frame(spark, [])).count() == 0
    whole = mixture_packing.sequences(mixture_packing.pack(docs, length=256), length=256).collect()
    assert all(len(s.ids) == 4 * 256 for s in whole)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_pieces([tuple(r) for r in docs.collect()], mixture_packing.pack(docs, temper=0.7).collect(), 2048)
