import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import TEXTS, documents

from docmill.llm import quality
from docmill.llm.quality import calibrate, fit, keep_good, quality_scores, train
from docmill.llm.sample import smallest_hashes

TABLES = "/root/testdata/sf0.1"


def corpus(n=900):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 200)))
        if not good:
            text = "$$$ ".join(text.split()) if rng.random() < 0.5 else " ".join([text.split()[0]] * 80)
        rows.append((i, text, "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, table)
    got = quality_scores(docs, model).collect()
    truth = {i: q for i, q, _ in labels}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.93 * len(held)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus(300)
    docs = documents(spark, rows)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    scores = [
        sorted(map(tuple, quality_scores(docs, train(docs, spark.createDataFrame(x, kind))).collect()))
        for x in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_edge_cases(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = train(docs, none)
    got = quality_scores(docs, model).collect()
    assert len(got) == len(TEXTS) and {r["score"] for r in got} == {0.5}
    rows, labels = corpus(200)
    model = train(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality_scores(docs, model).collect()
    assert len(got) == len(TEXTS)
    same = {r["score"] for r in got if r["doc_id"] in (3, 4)}
    assert len(same) == 1
    assert quality_scores(docs.limit(0), model).count() == 0
    assert keep_good(docs.limit(0), model).count() == 0


def labelled(held_out):
    """(text, label) of the training or the held-out rows of the largest table."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{TABLES}/documents.parquet").to_pylist()}
    rows = pq.read_table(f"{TABLES}/labels.parquet").to_pylist()
    split = lambda i: (zlib.crc32(str(i).encode()) % 3 == 1) == held_out
    return [(texts[r["doc_id"]], r["quality"]) for r in rows if r["doc_id"] in texts and split(r["doc_id"])]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")
@pytest.mark.parametrize("kind", ["orders", "resamples"])
def test_fit_is_stable(kind):
    """No order or resample of the training rows gives a bad fit."""
    rows, judged = [r for r in labelled(False) if len(r[0]) <= quality.SAMPLE_BYTES], labelled(True)
    truth = np.array([q for _, q in judged])
    for seed in range(20):
        rng = np.random.default_rng(seed)
        chosen = rng.permutation(len(rows)) if kind == "orders" else rng.integers(0, len(rows), len(rows))
        scores = fit([rows[i] for i in chosen]).scorer()([t for t, _ in judged])
        assert ((scores >= 0.5) == truth).mean() >= 0.95, seed


def test_calibration_always_ends():
    rng = np.random.default_rng(0)
    cases = [(np.r_[np.zeros(5), np.ones(5)], np.repeat([0.0, 1.0], 5)), (np.zeros(8), np.repeat([0.0, 1.0], 4))]
    cases += [(rng.standard_cauchy(200) * 10.0**k, (rng.random(200) < 0.9).astype(float)) for k in range(-6, 7)]
    for x, y in cases:
        a, b = calibrate(x, y)
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        assert np.isfinite([a, b]).all() and abs(p.mean() - y.mean()) < 1e-3


def test_sample_is_the_smallest_hashes(spark):
    """The cut by hash before the sort takes nothing from the sample, however
    often ids are repeated."""
    marked = spark.range(3000).selectExpr("id", "cast(id % 2 as int) quality")
    often = marked.join(spark.range(10).selectExpr("id as again"))
    want = marked.selectExpr("id", "quality", "xxhash64(id) h").orderBy("quality", "h", "id").collect()
    want = {(r["id"], q) for q in (0, 1) for r in [w for w in want if w["quality"] == q][:50]}
    for table in (marked, often):
        got, pairs = smallest_hashes(table, "quality", 50)
        assert {(r["id"], r["quality"]) for r in got.collect()} == want and pairs.count() == 3000
    few, _ = smallest_hashes(often.filter("id < 40"), "quality", 50)
    assert few.count() == 40


def test_repeated_labels_give_the_same_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 60)
    rows, labels = corpus()
    docs = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    often = table.join(spark.range(400).selectExpr("id as again")).drop("again")
    once, repeated = train(docs, table), train(docs, often)
    assert once == repeated and len(once.parts) == 2
