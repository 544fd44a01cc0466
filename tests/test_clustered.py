"""Reads of a few ids from a clustered table."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.sources import clustered as C


def test_few_files_are_opened(spark, tmp_path):
    ids = [k for k in range(2000)] + [777] * 3 + [None]
    random.Random(1).shuffle(ids)
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, text string").repartition(7)
    path = str(tmp_path / "t")
    C.write_clustered(rows, path, "id", file_rows=100)
    files = list((tmp_path / "t" / "rows").glob("*.parquet"))
    assert len(files) > 15
    got = C.read_ids(spark, path, "id", [777, 1500, 99_999])
    assert sorted(map(tuple, got.collect())) == [(777, "text 777")] * 4 + [(1500, "text 1500")]
    assert len(C.files_of(spark, path, [777, 1500, 99_999])) <= 4
    assert {f.split("/")[-1] for f in got.inputFiles()} == {f.split("/")[-1] for f in C.files_of(spark, path, [777, 1500])}
    assert "In(id" in got._jdf.queryExecution().executedPlan().toString()
    assert C.read_ids(spark, path, "id", []).count() == 0 and C.read_ids(spark, path, "id", [-1]).count() == 0
    with pytest.raises(ValueError, match="more than"):
        C.read_ids(spark, path, "id", list(range(1001)))


def test_empty_table(spark, tmp_path):
    C.write_clustered(spark.createDataFrame([], "id long, text string"), str(tmp_path / "e"), "id")
    assert C.read_ids(spark, str(tmp_path / "e"), "id", [1]).count() == 0


def test_a_file_is_bounded_in_bytes(spark, tmp_path):
    """Few rows of long texts make as many files as their bytes ask for."""
    rows = spark.createDataFrame([(k, "x" * 1000, [f"tag {k}"], None) for k in range(400)], "id long, `a.b` string, tags array<string>, n int")
    path = str(tmp_path / "t")
    C.write_clustered(rows, path, "id", file_bytes=20_000)
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 60 and sum(sizes) == 400
    assert [(r["id"], r["tags"]) for r in C.read_ids(spark, path, "id", [7]).collect()] == [(7, ["tag 7"])]
