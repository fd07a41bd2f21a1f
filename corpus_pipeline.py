"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Counted as part of the ``llm`` subpackage.  Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.  Between stages the rows are written as Parquet and read again.

Every stage takes nulls in any column, empty texts, repeated rows and empty tables.  Null and empty texts are scored as
texts without known words, share a fingerprint, lose nothing and hold no leak; they are packed as an end id alone.  Rows
without an id follow their group's choice, and neither lend nor lose passages.  Of repeated rows one stays in
``near_duplicates``.  Ties go to the smaller id.  An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession

from alertloom.llm import mixture_packing, relative_lz, simhash, toxicity, wu_manber
from alertloom.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below their language's threshold."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return simhash.keep_representatives(docs, shingle=4, bits=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that an earlier document holds."""
    return relative_lz.without_repeats(docs, window=50)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item stand in a row."""
    return wu_manber.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 ids, with the ids, mixed by the sources' ids to the power 0.7."""
    return mixture_packing.pack(docs, length=2048, temper=0.7)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained classifier comes first; tests compare every stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
