"""The chunker: Markdown documents to chunks with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..errors import ChunkingError
from ..functions.text import is_blank, strip, title_in_first_lines
from ..schema import CHUNK
from .combine import combine_small, final_metadata
from .headers import split_by_headers
from .semantic import split_oversized


def as_chunks(sections: Column) -> Column:
    """Sections (content, headers) as unflagged chunks."""
    shaped = F.transform(
        sections,
        lambda s: F.struct(
            s["content"].alias("content"),
            s["headers"].alias("headers"),
            F.lit(None).cast("boolean").alias("is_semantic_split"),
            F.lit(None).cast("boolean").alias("is_combined"),
        ),
    )
    return shaped.cast(f"array<{CHUNK.simpleString()}>")


def with_chunks(
    docs: DataFrame, text_col: str = "markdown", title_col: str | None = "title", config: ChunkConfig = ChunkConfig()
) -> DataFrame:
    """``docs`` with ``chunks`` (final chunks) and ``chunk_error``.

    Blank texts have an error and no chunks.  A missing or empty title is taken
    from the first lines.  Steps are materialised as columns so that Spark
    evaluates each once; their names differ from all that ``docs`` has."""
    text = strip(text_col)
    own = title_in_first_lines(text)
    title = F.coalesce(F.nullif(F.col(title_col), F.lit("")), own) if title_col else own
    valid = ~is_blank(text_col)
    titled, work = unused("_title", docs.columns), unused("_sections", docs.columns)
    out = docs.withColumn(titled, title).withColumn(
        work, as_chunks(split_by_headers(F.when(valid, text), config.max_header_level))
    )
    if config.enable_semantic:
        out = out.withColumn(work, split_oversized(F.col(work), config.max_size, config.model))
    out = out.withColumn(work, combine_small(F.col(work), config))
    return (
        out.withColumn("chunk_error", F.when(~valid, F.lit("Text cannot be empty")))
        .withColumn("chunks", final_metadata(F.col(work), F.col(titled)))
        .drop(titled, work)
    )


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def check_chunked(docs: DataFrame) -> None:
    """Raise for the first document that couldn't be chunked; for single calls,
    since in a table such a document is a row with its message."""
    failed = docs.filter(F.col("chunk_error").isNotNull()).select("chunk_error").first()
    if failed is not None:
        raise ChunkingError(f"Pipeline failed: {failed[0]}")


def explode_chunks(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per chunk, in the columns of a final chunk, with the document's id."""
    return docs.select(id_col, F.explode("chunks").alias("c")).select(id_col, "c.*")


def chunk_stats(chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """Per document: number of chunks, words, and the average chunk in words."""
    return chunks.groupBy(id_col).agg(
        F.count("*").alias("total_chunks"),
        F.sum("word_count").alias("total_words"),
        F.coalesce(F.try_divide(F.sum("word_count"), F.count("*")), F.lit(0.0)).alias("avg_chunk_size"),
    )
