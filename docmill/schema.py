"""Table schemas and the status domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The states of a document, in order of processing.
STATUSES = ["pending", "parsing", "parsed", "chunking", "chunked", "embedding", "completed", "failed"]

#: A chunk before its final metadata.
CHUNK = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("is_semantic_split", T.BooleanType()),
        T.StructField("is_combined", T.BooleanType()),
    ]
)

#: A chunk with its final metadata.
FINAL_CHUNK = T.StructType(
    [
        T.StructField("page_content", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("is_semantic_split", T.BooleanType()),
        T.StructField("is_combined", T.BooleanType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("doc_title", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("primary_header", T.StringType()),
        T.StructField("header_level", T.IntegerType()),
        T.StructField("section_path", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("markdown", T.StringType()),
        T.StructField("doc_metadata", T.StringType()),  # JSON
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType(), False),
        T.StructField("status_details", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("chunks", T.ArrayType(FINAL_CHUNK)),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("collection_name", T.StringType()),
        T.StructField("vector_id", T.StringType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),  # JSON
        T.StructField("version", T.LongType()),
    ]
)

#: The status log: ``seq`` rises with every write.
STATUS_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


def valid_status(status: Column | str) -> Column:
    return F.coalesce((F.col(status) if isinstance(status, str) else status).isin(STATUSES), F.lit(False))
