"""Breakpoints over stored vectors, for groups of any size.

Rows are sorted over sampled ranges of (group, order).  Each range is read once,
in its order: distances to the row before come from Arrow batches, and only the
range's first and last vectors are kept for what is between two ranges.  From then
on rows are narrow.  A group's percentile is an exact order statistic, found by
counting ever finer buckets; its breaks are numbered by adding up the ranges'
counts.  So a group is never in one task, nor in one window: windows run over the
ranges, over the buckets of a pass, and over the rows of one range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

#: Bits of a value that one pass of the search tells apart.
BITS = 11

#: Groups up to which what is known of them is broadcast, counted first; beyond,
#: it is saved and joined by a sort-merge join whose hot groups Spark splits.
BROADCAST_GROUPS = 100_000


@dataclass(frozen=True)
class _Known:
    """How tables of what is known of the groups are joined."""

    few: bool
    folder: str

    def side(self, table: DataFrame, name: str) -> DataFrame:
        return F.broadcast(table) if self.few else _saved(table, self.folder, name).hint("merge")


def _distances(before: list | None, vectors: list) -> list[float | None]:
    """Cosine distance of each vector to the one before it; the first one's
    is ``before``.  None where one is missing, without length or of another size."""
    rows = [before, *vectors]
    sizes = {len(v) if v is not None else -1 for v in rows}
    if len(sizes) == 1 and -1 not in sizes:
        m = np.array(rows, float)
        dots, norms = (m[1:] * m[:-1]).sum(1), np.sqrt((m * m).sum(1))
        product = norms[1:] * norms[:-1]
        cosine = np.divide(dots, product, out=np.full(len(dots), np.nan), where=product > 0)
        return [None if x != x else 1 - x for x in cosine.tolist()]
    out: list[float | None] = []
    for a, b in zip(rows, rows[1:]):
        pair = None if a is None or b is None or len(a) != len(b) else _distances(a, [b])
        out.append(pair[0] if pair else None)
    return out


def _saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _scanned(rows: DataFrame) -> DataFrame:
    """``rows`` (g, o, v), a partition a range in its order, as (part, seq, g, o,
    distance, v); vectors are left on the first and last row of a range."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("g", kinds["g"]),
            T.StructField("o", kinds["o"]),
            T.StructField("distance", T.DoubleType()),
            T.StructField("v", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, last_g, last_v = TaskContext.get().partitionId(), 0, None, None
        held: pa.RecordBatch | None = None

        def made(batch: pa.RecordBatch, distance: list, vectors: list) -> pa.RecordBatch:
            n = batch.num_rows
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int64()),
                    pa.array(range(seq, seq + n), pa.int64()),
                    batch.column("g"),
                    batch.column("o"),
                    pa.array(distance, pa.float64()),
                    pa.array(vectors, pa.list_(pa.float64())),
                ],
                names=schema.fieldNames(),
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            vectors, groups = batch.column("v").to_pylist(), batch.column("g").to_pylist()
            distance = _distances(last_v, vectors)
            for i, g in enumerate(groups):
                if (seq or i) and g == (groups[i - 1] if i else last_g):
                    continue
                distance[i] = None
            kept = [None] * len(vectors)
            if not seq:
                kept[0] = vectors[0]
            held = made(batch, distance, kept)
            last_g, last_v = groups[-1], vectors[-1]
            seq += batch.num_rows
        if held is not None:
            # The range's last row carries its vector, too.
            ends = held.column("v").to_pylist()
            ends[-1] = last_v
            yield held.set_column(5, "v", pa.array(ends, pa.list_(pa.float64())))

    return rows.mapInArrow(run, schema)


def _between(scanned: DataFrame) -> DataFrame:
    """(part, seq, gap): the distances between a range's last row and the next
    range's first one where they are of one group.  Two rows for each range."""
    ends = scanned.groupBy("part").agg(
        F.min_by(F.struct("g", "v"), "seq").alias("first"), F.max_by(F.struct("g", "v"), "seq").alias("last")
    )
    before = F.lag("last").over(Window.orderBy("part"))
    found = ends.select("part", "first", before.alias("before"))

    @F.udf(T.DoubleType(), useArrow=True)
    def gap(a: list[float] | None, b: list[float] | None) -> float | None:
        return _distances(a, [b])[0]

    same = F.col("before.g").eqNullSafe(F.col("first.g")) & F.col("before").isNotNull()
    return found.filter(same).select("part", F.lit(0).cast("long").alias("seq"), gap("before.v", "first.v").alias("gap"))


def order_statistics(values: DataFrame, wanted: DataFrame, most: int, known: _Known) -> DataFrame:
    """(g, rank, x): of the whole numbers ``values`` (g, x), from 0 to ``most``,
    those that are ``rank``-th (from 0) in their group, for ``wanted`` (g, rank).

    Each pass counts the buckets of the values that are still in question by
    partial sums, ``2 ** BITS`` buckets for a group and rank at most."""
    above = most.bit_length()
    shift = max(0, above - BITS)
    state = wanted.select("g", "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    while True:
        # A value is in question where it shares the prefix found so far.
        asked = known.side(state.withColumnRenamed("g", "g_"), f"ranks-{above}")
        inside = F.col("g").eqNullSafe(F.col("g_")) & (F.shiftright("x", above) == F.col("prefix"))
        counts = (
            values.join(asked, inside)
            .groupBy("g", "rank", "left", F.shiftright("x", shift).alias("bucket"))
            .agg(F.count("*").alias("n"))
        )
        upto = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("bucket"))
        found = counts.withColumn("upto", upto).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        state = found.select("g", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("bucket").alias("prefix"))
        if not shift:
            return state.select("g", "rank", F.col("prefix").alias("x"))
        above, shift = shift, max(0, shift - BITS)


def exact_percentile(values: DataFrame, percentile: float, most: int, known: _Known) -> DataFrame:
    """(g, value): each group's percentile of ``values`` (g, x), interpolated
    between the two whole numbers next to it."""
    sizes = values.groupBy("g").agg(F.count("x").alias("n"))
    at = sizes.select("g", ((F.col("n") - 1) * F.lit(percentile)).alias("at"), "n")
    ranks = at.select("g", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    found = order_statistics(values, ranks, most, known)
    both = found.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    joined = both.withColumnRenamed("g", "g_").join(at, F.col("g").eqNullSafe(F.col("g_")))
    share = F.col("at") - F.floor("at")
    return joined.select("g", ((1 - share) * F.col("low") + share * F.col("high")).alias("value"))


def vector_breaks(
    vectors: DataFrame, order_col: str, vector_col: str, group_col: str, digits: int = 9, percentile: float = 0.95
) -> DataFrame:
    """Breakpoints over consecutive stored vectors of each group: their
    ``distance`` to the vector before, the group's ``threshold``, whether it
    ``breaks``, and the running ``piece``.  Distances and threshold are rounded
    before they are compared, so that equal distances stay equal.

    A group's first vector has no distance, nor has one next to a vector that is
    null or without length; such rows never break.  Groups may be null.  Rows of
    equal order follow each other in any order.  The tables on the way stay in the
    shared folder, since the result reads them."""
    folder = shared_path(vectors.sparkSession, "vector-breaks")
    rows = vectors.select(F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.col(vector_col).alias("v"))
    ranges = rows.repartitionByRange("g", "o").sortWithinPartitions("g", "o")
    scanned = _saved(_scanned(ranges), folder, "scanned")

    scale = 10**digits
    gaps = F.broadcast(_between(scanned))  # a row for each range
    whole = F.round(F.coalesce("gap", "distance") * scale).cast("long")
    near = scanned.drop("v").join(gaps, ["part", "seq"], "left").select("part", "seq", "g", "o", whole.alias("x"))
    near = _saved(near, folder, "near")

    groups = near.select("g").distinct().limit(BROADCAST_GROUPS + 1).count()
    known = _Known(groups <= BROADCAST_GROUPS, folder)
    bound = exact_percentile(near.filter("x is not null").select("g", "x"), percentile, 2 * scale, known)
    bound = known.side(bound.select(F.col("g").alias("g_"), F.round("value").alias("bound")), "bounds")
    marked = near.join(bound, F.col("g").eqNullSafe(F.col("g_")), "left").withColumn(
        "breaks", F.coalesce(F.col("x") > F.col("bound"), F.lit(False))
    )

    per_range = marked.groupBy("g", "part").agg(F.count_if("breaks").alias("n"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_range.select(
        F.col("g").alias("g__"), F.col("part").alias("part_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    within = F.count_if("breaks").over(
        Window.partitionBy("part", "g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    )
    numbered = marked.withColumn("within", within).join(
        before, F.col("g").eqNullSafe(F.col("g__")) & (F.col("part") == F.col("part_"))
    )
    return numbered.select(
        F.col("g").alias(group_col),
        F.col("o").alias(order_col),
        F.round(F.col("x") / scale, digits).alias("distance"),
        F.round(F.col("bound") / scale, digits).alias("threshold"),
        "breaks",
        (F.col("within") + F.col("before")).alias("piece"),
    )
