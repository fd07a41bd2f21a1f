import csv
import random

import pytest
from pyspark.sql import functions as F

from alertloom.session import fresh_path
from alertloom.sources.split_csv import read_split_csv


def write(folder, name, rows, end="\r\n"):
    """A CSV file, written by the library that defines the format here."""
    with open(folder / name, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("split", ["1000", "128m"])
def test_quoted_line_breaks_over_split_ends(spark, tmp_path, split):
    rnd = random.Random(9)
    pieces = ["a", "b,c", '"', '""', "\n", "\r\n", "\n\n", "é", " ", "x" * 40, "", "'"]
    folder, want = tmp_path, []
    for n, (names, end) in enumerate([(["k", "v w", "z"], "\r\n"), (["k", "z"], "\n")]):
        rows = [[f"{n}-{i}"] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9))) + "." for _ in names[1:]] for i in range(120)]
        write(folder, f"f{n}", [names, *rows], end)
        want += [dict(zip(names, r)) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        frame = read_split_csv(spark, f"{folder}/*")
        got = {r["k"]: r.asDict() for r in frame.collect()}
        tasks = spark.read.text(f"{folder}/*").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 240 and (split == "128m" or tasks > 5)
    for row in want:
        assert {k: v for k, v in got[row["k"]].items() if v is not None} == row


def test_headers_alone_and_nothing(spark, tmp_path):
    folder = tmp_path
    write(folder, "f", [["a", "b"]])
    assert read_split_csv(spark, f"{folder}/*").columns == ["a", "b"] and read_split_csv(spark, f"{folder}/*").count() == 0
    none = fresh_path(spark, "empty-csv")
    spark.range(0).select(F.lit("").alias("value")).write.text(none)
    assert read_split_csv(spark, none).count() == 0
