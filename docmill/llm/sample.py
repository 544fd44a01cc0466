"""Bounded samples by the hash of an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved


#: Rows of one slice, about.
SLICE_ROWS = 64


def training_text(id_col: str) -> Column:
    """The id in decimal digits, of which splits take the crc32; a null id counts
    as the empty string."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")


def smallest_hashes(marked: DataFrame, by: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of (id, ``by``) pairs, for each value of ``by`` the ``rows`` ids with the
    smallest hashes; and the saved table of distinct pairs that they come from.

    Repeated pairs count once.  The values of ``by`` are meant to be few, since a
    model has a part for each: their counts are broadcast.  Only ids under a hash
    that some four times as many lie under as are wanted (a hundred more, so that
    no small sample falls short) are looked at, and ranked within slices of the
    hashes, so no task gets a class."""
    pairs = saved(marked.select("id", by).distinct(), "sample-ids")
    counts = pairs.groupBy(by).agg(F.count("*").alias("n"))
    near = pairs.withColumn("h", F.xxhash64("id")).join(F.broadcast(counts), by)
    # Where a hash would stand if all were evenly spread; slices of some rows each.
    near = near.withColumn("slice", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n") / SLICE_ROWS))
    near = near.filter(F.col("slice") <= (4.0 * rows + 100) / SLICE_ROWS)
    slices = near.groupBy(by, "slice").agg(F.count("*").alias("inside"))
    earlier = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select(by, "slice", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("before"))
    # Some hundred slices of each value are broadcast.
    joined = near.join(F.broadcast(before), [by, "slice"]).filter(F.col("before") < rows)
    place = F.row_number().over(Window.partitionBy(by, "slice").orderBy("h", "id"))
    chosen = joined.withColumn("place", F.col("before") + place).filter(F.col("place") <= rows)
    return chosen.select("id", by, "h"), pairs
