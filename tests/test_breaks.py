"""Breakpoints over vectors, against windows over whole groups."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions.vector import cosine_distance
from docmill.operators import breaks as B


def by_windows(df, digits=9, percentile=0.95):
    """The same by a window over each group and Spark's own percentile."""
    by = Window.partitionBy("grp").orderBy("pos")
    near = df.select("grp", "pos", F.round(cosine_distance(F.lag("vec").over(by), F.col("vec")), digits).alias("distance"))
    bound = near.groupBy(F.col("grp").alias("g2")).agg(F.round(F.percentile("distance", percentile), digits).alias("threshold"))
    joined = near.join(bound, F.col("grp").eqNullSafe(F.col("g2")), "left").drop("g2")
    joined = joined.withColumn("breaks", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)))
    return joined.withColumn("piece", F.sum(F.col("breaks").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def vectors(spark, groups, n, seed=1):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    rows = []
    for k in range(n):
        v = [float(x) for x in rng.normal(size=4).round(2)]
        if k % 17 == 3:
            v = [0.0] * 4
        if k % 19 == 5:
            v = None
        if k % 23 == 7:
            v = v and v[:3]
        rows.append((pick.choice(groups), k, v))
    pick.shuffle(rows)
    return spark.createDataFrame(rows, "grp string, pos long, vec array<double>").repartition(5)


@pytest.mark.parametrize(
    ("groups", "most"),
    [(["all"], 100_000), (["a", "a", "a", "b", None], 0), ([f"g{k}" for k in range(60)], 100_000)],
)
def test_equals_windows(spark, monkeypatch, groups, most):
    monkeypatch.setattr(B, "BROADCAST_GROUPS", most)
    df = vectors(spark, groups, 400)
    got = B.vector_breaks(df, "pos", "vec", "grp")
    want = by_windows(df)
    key = lambda r: (str(r[0]), r[1])
    rows = lambda x: sorted(map(tuple, x.select("grp", "pos", "distance", "threshold", "breaks", "piece").collect()), key=key)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a[:2] + a[4:] == b[:2] + b[4:]
        assert a[2:4] == pytest.approx(b[2:4], abs=2e-9) or a[2:4] == b[2:4]


def test_no_window_runs_over_a_group(spark):
    """All rows in one group: windows part by range, or run over a row for each
    range or bucket."""
    got = B.vector_breaks(vectors(spark, ["all"], 300), "pos", "vec", "grp")
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line or "Window(" in line]
    assert windows and all("part" in line or "bucket" in line for line in windows)


def test_exact_order_statistics(spark, tmp_path):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.randrange(2_000_000_001), 5, 5, 2_000_000_000])) for g in "aab" for _ in range(150)] + [(None, 7)]
    df = spark.createDataFrame(rows, "g string, x long")
    values = {g: sorted(x for h, x in rows if h == g) for g in ("a", "b", None)}
    wanted = [(g, r) for g, v in values.items() for r in {0, len(v) // 3, len(v) - 1}]
    found = B.order_statistics(df, spark.createDataFrame(wanted, "g string, rank long"), 2_000_000_000, B._Known(True, ""))
    assert {(r["g"], r["rank"]): r["x"] for r in found.collect()} == {(g, r): values[g][r] for g, r in wanted}
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["value"] for r in B.exact_percentile(df, p, 2_000_000_000, B._Known(p > 0.5, str(tmp_path / f"p{p}"))).collect()}
        assert got == pytest.approx({g: float(np.percentile(v, 100 * p)) for g, v in values.items()})


def test_edges(spark):
    kind = "grp string, pos long, vec array<double>"
    assert B.vector_breaks(spark.createDataFrame([], kind), "pos", "vec", "grp").count() == 0
    one = B.vector_breaks(spark.createDataFrame([("a", 1, [1.0])], kind), "pos", "vec", "grp").first()
    assert tuple(one) == ("a", 1, None, None, False, 0)
