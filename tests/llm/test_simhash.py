import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertloom.llm import simhash
from alertloom.llm.components import components
from tests.llm.helpers import folded, frame, grouped, odd_rows, words

CODE = simhash.Golay()


def brute_fingerprint(text, shingle=4):
    w = words(folded(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_every_word_lies_within_three_bits_of_one_codeword():
    syndromes = simhash._syndrome(np.arange(1 << 12, dtype=np.uint32) << np.uint32(11))
    codewords = (np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)) ^ syndromes
    assert (simhash._syndrome(codewords) == 0).all()
    assert np.bitwise_count(codewords[1:]).min() == 7
    assert np.bitwise_count(CODE.errors).max() == 3 and len(np.unique(CODE.errors)) == 2048


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_prints_up_to_four_bits_apart_share_a_key(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    keys, rows = simhash.golay_keys(np.array([x, y], np.uint64), CODE)
    assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
    assert len(set(keys[rows == 0].tolist())) == (rows == 0).sum()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉ \n\t ", max_size=60), st.integers(1, 5))
def test_fingerprint(text, shingle):
    assert simhash.fingerprint(text.encode(), shingle) == brute_fingerprint(text, shingle)


def test_links_connect_all_pairs_also_over_cut_keys(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    prints = [base]
    for _ in range(6):
        near = prints[-1].copy()
        for _ in range(3):
            near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
        prints.append(near)
    prints = np.unique(np.concatenate(prints))
    want = grouped(prints.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    for most in (65_536, 10):
        found = [(a % 2**64, b % 2**64) for a, b in simhash.links(df, most=most).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in found)
        pairs = {frozenset(p) for p in found}
        assert grouped(prints.tolist(), lambda a, b: frozenset((a, b)) in pairs) == want


def test_a_dense_run_is_spanned_once():
    prints = np.unique(np.random.default_rng(2).integers(0, 1 << 9, 400).astype(np.uint64))
    forest = simhash.Forest()
    found = list(simhash._run_links(np.zeros(len(prints), np.int64), prints, 4, forest))
    assert len(found) == len(prints) - 1


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    pairs += [(2000, i) for i in range(2001, 2300)] + [(7, 7), (None, 3), (4, None)]
    nodes = sorted({x for p in pairs if None not in p and p[0] != p[1] for x in p})
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    linked = {frozenset(p) for p in pairs}
    assert got == grouped(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(frame(spark, rows, clashing=True)).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(r[0]), brute_fingerprint(r[1])) for r in rows)
    by_print = {p: min((r[0] for r in rows if r[0] is not None and brute_fingerprint(r[1]) == p), default=None)
                for p in {brute_fingerprint(r[1]) for r in rows}}
    order = sorted(by_print)
    classes = grouped(order, lambda a, b: (a ^ b).bit_count() <= 4)
    for r in got:
        members = [by_print[p] for p in order if classes[p] == classes[r.fp % 2**64] and by_print[p] is not None]
        assert r.component_id == min(members, default=None)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_representatives(spark):
    docs = frame(spark, odd_rows(), clashing=True)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    classes = simhash.near_duplicates(docs).select("root").distinct().count()
    assert kept.count() == classes
    assert simhash.near_duplicates(kept).groupBy("root").count().where("count > 1").count() == 0
    low = simhash.near_duplicates(docs).groupBy("root").agg(F.min("doc_id").alias("low")).where("low is not null")
    assert {r.low for r in low.collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
    assert simhash.keep_representatives(frame(spark, [])).count() == 0


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = grouped(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
