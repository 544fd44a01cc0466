"""Functions of one column work on slices of an Arrow batch."""

import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import PythonEvalType

from docmill.config import StoreConfig
from docmill.functions import embedding
from docmill.functions.arrow import SLICE_ROWS, row_function, slices
from docmill.functions.html import html_to_markdown
from docmill.operators import store
from docmill.operators.headers import split_by_headers
from docmill.operators.semantic import split_oversized
from docmill.plans.lifecycle import process
from docmill.schema import DOCUMENTS


def test_slices_are_bounded_in_rows_and_bytes():
    for kind, wrap in ((pa.string(), lambda x: x), (pa.list_(pa.string()), lambda x: [x, None])):
        batch = pa.array([None if k % 5 == 0 else wrap("x" * (k * k)) for k in range(150)], kind)
        got = list(slices(batch, 20, 10_000))
        assert pa.chunked_array(got).to_pylist() == batch.to_pylist()
        assert max(map(len, got)) == 20 and all(len(g) == 1 or g.nbytes <= 10_000 for g in got)
    assert list(slices(pa.array([], pa.string()))) == []


def test_rows_and_nulls(spark):
    rows = spark.range(1000).coalesce(1).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"))
    kind = T.MapType(T.StringType(), T.LongType())
    got = rows.select("x", row_function(lambda x: [(str(x), x), ("none", None)], kind)("x").alias("m")).collect()
    assert len(got) == 1000
    assert all(r["m"] == (None if r["x"] is None else {str(r["x"]): r["x"], "none": None}) for r in got)


def test_vectors_of_one_slice_are_held_at_a_time(spark, monkeypatch):
    """Of 1000 documents in one Arrow batch, not all vectors are there at once."""

    def counting():
        class Vector(list):
            alive = 0

            def __init__(self):
                super().__init__([float(Vector.alive)])
                Vector.alive += 1

            def __del__(self):
                Vector.alive -= 1

        return lambda texts: [Vector() for _ in texts]

    monkeypatch.setattr(embedding, "_MODELS", dict(embedding._MODELS))
    embedding.register("counting", counting)
    chunk = F.struct(F.lit("text").alias("page_content"), F.lit(0).alias("chunk_index"))
    docs = spark.range(1000).coalesce(1).select("id", F.lit("t").alias("title"), F.array(chunk).alias("chunks"))
    vectors = store.embed_chunks(docs, StoreConfig("unused", model_name="counting"))
    n, most = vectors.agg(F.count("vector"), F.max(F.col("vector")[0])).first()
    assert n == 1000 and most <= 2 * SLICE_ROWS


def test_the_lifecycle_calls_python_by_slices_only(spark):
    """No stage has a function that Spark calls with a whole batch in Python values."""
    text = F.concat(F.lit("<h1>T</h1>"), F.repeat(F.lit("<p>Some words here.</p>"), F.lit(200)))
    ids = spark.range(20).coalesce(1).withColumn("file_path", F.concat(F.lit("https://a/"), F.col("id").cast("string")))
    values = {"title": F.lit("t"), "status": F.lit("pending"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    docs = ids.select(*[values.get(f.name, F.col(f.name) if f.name in ids.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields])
    contents = ids.select("file_path", html_to_markdown(text).alias("markdown"))
    _, vectors = process(docs, contents, StoreConfig("unused"), keep=lambda df: df)
    kinds = re.findall(r"ArrowEvalPython \[.*\], (\d+)$", vectors._jdf.queryExecution().optimizedPlan().toString(), re.MULTILINE)
    assert len(kinds) == 4 and set(kinds) == {str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)}
    assert vectors.filter("vector IS NOT NULL").select("document_id").distinct().count() == 20


def test_python_values_dont_grow_with_the_batch(spark, monkeypatch):
    """Of a batch eight times as large, no function of the lifecycle holds more at once."""
    functions, make = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda work: functions.append(work) or make(kind)(work))
    html_to_markdown("html"), split_by_headers("text"), split_oversized("chunks", 100)
    docs = spark.range(1).select(F.array(F.struct(F.lit("text").alias("page_content"))).alias("chunks"))
    store.with_embeddings(docs, StoreConfig("unused"))
    text = "# T\n\n" + "Some words here. " * 20
    values = "<h1>T</h1>" + "<p>Some words here.</p>" * 20, text, [text], [text]
    assert len(functions) == len(values)

    def peak(work, batch):
        tracemalloc.start()
        try:
            assert sum(map(len, work(iter([batch])))) == len(batch)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    for work, value in zip(functions, values, strict=True):
        peak(work, pa.array([value]))  # what is made once
        assert peak(work, pa.array([value] * 2048)) < 1.5 * peak(work, pa.array([value] * 256))
