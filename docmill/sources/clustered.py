"""Tables clustered by id, for reads of a few ids out of very many rows.

Rows are written over sampled ranges of the id, sorted, with Parquet bloom filters
on it, and beside them a small table of each file's least and largest id.  A read
asks that table which files may hold the ids and opens these alone, however many
there are; within them row groups are left out by their bounds and filters.

Rows without an id are kept and read by no id; rows of equal id lie in one file, so
a hot id makes a large one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a file, about: whichever makes more files.  A file is sorted
#: and written by one task.
FILE_ROWS, FILE_BYTES = 1_000_000, 256 << 20

#: Ids of one read; they stand in the plan.
MOST_IDS = 1000


def _row_bytes(schema: T.StructType) -> Column:
    """About how long a row is: strings and what is nested by their bytes, as text,
    others by eight."""

    def of(field: T.StructField) -> Column:
        value = F.col(f"`{field.name.replace('`', '``')}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0))
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(value.cast("string")), F.lit(0))
        return F.lit(8)

    return sum((of(f).cast("long") for f in schema.fields), F.lit(0).cast("long"))


def write_clustered(
    rows: DataFrame, path: str, id_col: str, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES
) -> None:
    """``rows`` as a new table under ``path``, clustered by ``id_col``."""
    spark = rows.sparkSession
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(rows.schema)), F.lit(0)).alias("bytes")).first()
    files = max(total["n"] // file_rows, total["bytes"] // file_bytes) + 1
    ranges = rows.repartitionByRange(files, id_col).sortWithinPartitions(id_col)
    writer = ranges.write.option(f"parquet.bloom.filter.enabled#{id_col}", "true")
    writer.option(f"parquet.bloom.filter.expected.ndv#{id_col}", str(file_rows)).parquet(f"{path}/rows")
    held = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(id_col, F.col("_metadata.file_path").alias("file"))
    bounds = held.groupBy("file").agg(F.min(id_col).alias("least"), F.max(id_col).alias("most"))
    bounds.coalesce(1).write.parquet(f"{path}/files")


def files_of(spark: SparkSession, path: str, ids: list) -> list[str]:
    """The files that may hold rows of the ids, by the table of bounds."""
    if len(ids) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids: join with the table instead")
    bounds = spark.read.parquet(f"{path}/files")
    wanted = F.array(*[F.lit(i) for i in ids])
    may = F.exists(wanted, lambda i: i.between(F.col("least"), F.col("most")))
    return sorted(r["file"] for r in bounds.filter(may).select("file").collect()) if ids else []


def read_ids(spark: SparkSession, path: str, id_col: str, ids: list) -> DataFrame:
    """The rows of a few ids."""
    schema = spark.read.parquet(f"{path}/rows").schema
    files = files_of(spark, path, ids)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).filter(F.col(id_col).isin(ids))
