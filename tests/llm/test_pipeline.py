import corpus_pipeline
import __spark_entry__ as entry
from alertloom.llm import simhash
from tests.llm.helpers import frame, odd_rows
from tests.llm.test_classify_and_filter import brute_leaks
from tests.llm.test_packing import check_pieces
from tests.llm.test_relative_lz import brute as brute_repeats

SF = "/root/testdata/sf0.01"


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    columns = docs.columns
    for n, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        result = step(spark, docs, SF)
        result.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            ids = {r.doc_id for r in before}
            assert {r.doc_id for r in after} <= ids and len(after) == len({r.doc_id for r in after})
        if name == "toxicity":
            gone = ids - {r.doc_id for r in after}
            assert len(toxic & gone) > 0.6 * len(toxic) and len(gone) < 0.12 * len(ids)
        elif name == "near_duplicates":
            prints = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in before}
            kept = {r.doc_id for r in after}
            assert all(min((prints[a] ^ prints[b]).bit_count() for b in kept) <= 4 or a in kept for a in ids)
            assert all((prints[a] ^ prints[b]).bit_count() > 4 for a in kept for b in kept if a < b)
        elif name == "substring_dedup":
            want = {i: t for i, _, gone, t in brute_repeats([(r.doc_id, r.text) for r in before], 50) if gone and t}
            texts = {r.doc_id: r.text for r in after}
            assert all(texts[i] == t for i, t in want.items())
            assert all(texts.get(r.doc_id, "") in (r.text, want.get(r.doc_id, "")) for r in before)
            assert all(r.n_chars == len(r.text) for r in after if r.doc_id in want)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = {i for i, _, hit, _ in brute_leaks([(r.doc_id, r.text) for r in before], items, 10) if not hit}
            assert {r.doc_id for r in after} == clean
        else:
            check_pieces([(r.doc_id, r.text) for r in before], after, 2048)


def test_odd_rows_run_through(spark, tmp_path):
    docs = frame(spark, odd_rows(), clashing=True)
    for n, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
    assert docs.count() > 0
    empty = frame(spark, [])
    for n, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, empty, SF).write.parquet(str(tmp_path / f"e{n}"))
        empty = spark.read.parquet(str(tmp_path / f"e{n}"))
    assert empty.count() == 0
