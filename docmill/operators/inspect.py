"""Questions one asks of a set of chunks or documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oversized(chunks: DataFrame, max_size: int = 2000, text_col: str = "page_content") -> DataFrame:
    """Chunks with whether they have more characters than ``max_size``."""
    return chunks.withColumn("is_oversized", F.length(text_col) > max_size)


def size_extremes(chunks: DataFrame, size_col: str, index_col: str) -> DataFrame:
    """Smallest and largest size and where each first occurs."""
    return chunks.agg(
        F.min(size_col).alias("min_size"),
        F.max(size_col).alias("max_size"),
        F.min_by(index_col, F.struct(size_col, index_col)).alias("min_index"),
        F.max_by(index_col, F.struct(F.col(size_col), -F.col(index_col))).alias("max_index"),
    )


def smallest(chunks: DataFrame, size_col: str, index_col: str, n: int = 25) -> DataFrame:
    """The ``n`` smallest, smallest first."""
    return chunks.orderBy(size_col, index_col).limit(n)


def largest(chunks: DataFrame, size_col: str, index_col: str, n: int = 5) -> DataFrame:
    """The ``n`` largest, still smallest first."""
    top = chunks.orderBy(F.desc(size_col), F.desc(index_col)).limit(n)
    return top.orderBy(size_col, index_col)


def flagged(chunks: DataFrame, flag_col: str = "is_semantic_split") -> DataFrame:
    """Chunks that carry a flag; a missing flag is none."""
    return chunks.filter(F.coalesce(F.col(flag_col), F.lit(False)))


def preview(docs: DataFrame, text_col: str, start: int = 2000, end: int = 10000) -> DataFrame:
    """``docs`` with the text from character ``start`` (0-based) up to ``end``."""
    return docs.withColumn("preview", F.substring(text_col, start + 1, end - start))
