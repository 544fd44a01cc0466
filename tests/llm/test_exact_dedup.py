import hashlib
import random
from collections import defaultdict

import pytest
from helpers import TEXTS, documents
from pyspark.sql import functions as F

from docmill.llm.exact_dedup import drop_exact_duplicates, exact_dedup


def check(rows, got, keep):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        ids = groups[by_sha[r["text_sha256"]]]
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        if r["kept"]:
            assert r["doc_id"] == best
            kept[r["text_sha256"]] += 1
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_edge_cases(spark, keep):
    check(TEXTS, exact_dedup(documents(spark), keep=keep).collect(), keep)
    assert exact_dedup(documents(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(documents(spark), keep="any")


@pytest.mark.parametrize("keep", ["min", "max"])
def test_hot_group_over_many_partitions(spark, keep):
    rng = random.Random(3)
    rows = [(i, "hot " * 9 if i % 3 == 0 else f"text {rng.randrange(400)}", "s") for i in range(3000)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        df = documents(spark, rows).repartition(5)
        check(rows, exact_dedup(df, keep=keep).collect(), keep)
        left = drop_exact_duplicates(df, keep=keep)
        assert left.columns == df.columns
        got = {r["text"]: r["doc_id"] for r in left.collect()}
        assert left.count() == len(got) == len({t for _, t, _ in rows})
        pick = max if keep == "max" else min
        assert got == {t: pick(i for i, u, _ in rows if u == t) for t in got}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_are_kept_whole(spark):
    df = documents(spark)
    left = drop_exact_duplicates(df)
    assert left.columns == df.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in TEXTS})
    assert drop_exact_duplicates(df.limit(0)).count() == 0


def test_normalised_comparison(spark):
    rows = [(1, "A  b", "s"), (2, "a B", "s"), (3, "c", "s")]
    got = exact_dedup(documents(spark, rows), normalise=lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 1, 2: 1, 3: 3}
