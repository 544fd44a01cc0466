"""Serialised chunks, embedding in batches, and the vector table."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import StoreConfig
from ..errors import DatabaseConnectionError, EmbeddingError
from ..functions.arrow import row_function
from ..functions.embedding import model_of
from ..functions.retry import retrying
from ..functions.vector import cosine_similarity
from ..schema import DOCUMENTS, EMBEDDINGS, FINAL_CHUNK
from .commits import Catalog, Session, read_table, session_scope

_LEVELS = range(1, 7)
_SCALARS = [f for f in FINAL_CHUNK.fields if f.name not in ("page_content", "headers")]


def chunk_metadata(chunk: Column, *more: Column) -> Column:
    """What a chunk knows besides its text, as one flat struct: a field for each
    header level, then its other fields, then ``more``."""
    headers = [F.try_element_at(chunk["headers"], F.lit(f"Header {i}")).alias(f"Header {i}") for i in _LEVELS]
    return F.struct(*headers, *[chunk[f.name].alias(f.name) for f in _SCALARS], *more)


def serialise(chunks: Column | str) -> Column:
    """A chunk array as JSON: a list of objects with ``page_content`` and a flat
    object ``metadata``, in which absent values are left out."""
    array = F.col(chunks) if isinstance(chunks, str) else chunks
    shaped = F.transform(
        array, lambda c: F.struct(c["page_content"].alias("page_content"), chunk_metadata(c).alias("metadata"))
    )
    return F.to_json(shaped)


def deserialise(text: Column | str) -> Column:
    """The chunk array that ``serialise`` wrote; metadata of other names is lost."""
    kind = T.ArrayType(
        T.StructType(
            [
                T.StructField("page_content", T.StringType()),
                T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
            ]
        )
    )
    parsed = F.from_json(F.col(text) if isinstance(text, str) else text, kind)

    def chunk(x: Column) -> Column:
        own = x["metadata"]
        return F.struct(
            x["page_content"].alias("page_content"),
            F.map_filter(own, lambda k, v: F.startswith(k, F.lit("Header ")) & v.isNotNull()).alias("headers"),
            *[F.try_element_at(own, F.lit(f.name)).cast(f.dataType).alias(f.name) for f in _SCALARS],
        )

    return F.transform(parsed, chunk).cast(T.ArrayType(FINAL_CHUNK))


def batch_of(index: Column | str, total: Column | str, size: int) -> tuple[Column, Column]:
    """1-based batch of a 0-based index, and the number of batches."""
    i = F.col(index) if isinstance(index, str) else index
    n = F.col(total) if isinstance(total, str) else total
    return (F.floor(i / size) + 1).cast("long"), F.ceil(n / size).cast("long")


_EMBEDDED = T.ArrayType(
    T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
)


def with_embeddings(docs: DataFrame, config: StoreConfig, when: Column | None = None) -> DataFrame:
    """``docs`` with ``embedded``: a vector or an error for each of its chunks.

    A document's chunks are embedded in slices of ``batch_size``; a slice that
    fails gets the error on all its entries and no vectors, and the next slices
    go on.  Rows where ``when`` doesn't hold aren't embedded."""
    size, model, attempts = config.batch_size, model_of(config.model_name), config.attempts

    def run(texts: list[str]) -> list[dict]:
        out = []
        for at in range(0, len(texts), size):
            batch = texts[at : at + size]
            try:
                vectors = retrying(lambda batch=batch: model.embedder()(batch), attempts)
                if len(vectors) != len(batch):
                    raise EmbeddingError(f"{len(vectors)} vectors for {len(batch)} chunks")
                out += [{"vector": v, "error": None} for v in vectors]
            except Exception as error:  # noqa: BLE001  later batches go on
                out += [{"vector": None, "error": f"Failed to process batch {at // size + 1}: {error}"}] * len(batch)
        return out

    texts = F.transform("chunks", lambda c: c["page_content"])
    # Marked as nondeterministic so that it is computed once, see split_by_headers.
    embed = row_function(run, _EMBEDDED).asNondeterministic()
    return docs.withColumn("embedded", embed(texts if when is None else F.when(when, texts)))


def embedded_rows(docs: DataFrame, config: StoreConfig, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """One row per embedded chunk of ``docs``: the vector table's columns but for
    the version, the title, and ``error``.  Vector ids are made of document and
    chunk.  Where chunks carry metadata it goes along, with the document's id and
    title."""
    chunk = docs.schema["chunks"].dataType.elementType
    full = {f.name for f in FINAL_CHUNK.fields} <= set(chunk.fieldNames()) and config.use_jsonb
    rows = docs.select(
        F.col(id_col).cast("long").alias("document_id"),
        F.col(title_col).alias("original_doc_title"),
        F.explode(F.when(F.col("embedded").isNotNull(), F.arrays_zip("chunks", "embedded"))).alias("x"),
    )
    index = F.col("x.chunks.chunk_index")
    origin = F.col("document_id").alias("original_doc_id"), F.col("original_doc_title")
    metadata = F.to_json(chunk_metadata(F.col("x.chunks"), *origin)) if full else F.lit(None).cast("string")
    return rows.select(
        F.lit(config.collection_name).alias("collection_name"),
        F.concat_ws("-", "document_id", index).alias("vector_id"),
        "document_id",
        index.alias("chunk_index"),
        F.col("x.chunks.page_content").alias("chunk_text"),
        F.col("x.embedded.vector").alias("vector"),
        metadata.alias("metadata"),
        "original_doc_title",
        F.col("x.embedded.error").alias("error"),
    )


def embed_chunks(docs: DataFrame, config: StoreConfig, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """The embedded chunks of ``docs``, one row each; no shuffle."""
    return embedded_rows(with_embeddings(docs, config), config, id_col, title_col)


def embedded_counts(rows: DataFrame) -> DataFrame:
    """Per document: chunks expected and embedded, and whether they differ."""
    counts = rows.groupBy("document_id").agg(
        F.count("*").alias("expected"), F.count("vector").alias("embedded")
    )
    return counts.withColumn("mismatch", F.col("expected") != F.col("embedded"))


#: What Spark raises, on the driver, for tables that it can't read or write.
_FAILURES = (PySparkException, Py4JError, OSError)


def append_vectors(session: Session, rows: DataFrame, config: StoreConfig, documents: DataFrame | None = None) -> None:
    """Write the embedded rows to the vector table, by collection, under the
    session's number as version.

    Of ``documents`` (``id``, ``embedded``) those without any vector get a row
    without one, so that what they had before is no longer read."""
    good = rows.filter(F.col("vector").isNotNull())
    if "metadata" not in rows.columns:
        good = good.withColumn("metadata", F.lit(None).cast("string"))
    good = good.withColumn("version", F.lit(session.seq)).select(*EMBEDDINGS.fieldNames())
    if documents is not None:
        made = F.size(F.filter("embedded", lambda e: e["vector"].isNotNull()))
        emptied = documents.filter(F.coalesce(made, F.lit(0)) <= 0)
        values = {"collection_name": F.lit(config.collection_name), "document_id": F.col("id"), "version": F.lit(session.seq)}
        good = good.unionByName(
            emptied.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EMBEDDINGS.fields])
        )
    try:
        session.append(config.path, good, ("collection_name",))
    except _FAILURES as error:
        raise DatabaseConnectionError(f"Failed to connect to database: {error}") from error


def write_vectors(rows: DataFrame, config: StoreConfig) -> None:
    """Append the embedded rows to the vector table in a commit of their own."""
    try:
        catalog = Catalog(rows.sparkSession, f"{config.path}/_commits")
        with session_scope(catalog) as session:
            append_vectors(session, rows, config)
    except _FAILURES as error:
        raise DatabaseConnectionError(f"Failed to connect to database: {error}") from error


def read_vectors(spark: SparkSession, config: StoreConfig) -> DataFrame:
    """The collection's committed vectors: of each document those of the newest
    version, so that embedding a document again replaces all that it had.

    The newest versions are found without texts and vectors, by partial
    aggregates, and only then joined."""
    try:
        table = read_table(spark, config.path, EMBEDDINGS)
    except _FAILURES as error:
        raise DatabaseConnectionError(f"Failed to connect to database: {error}") from error
    rows = table.filter(F.col("collection_name") == config.collection_name)
    newest = rows.groupBy(F.col("document_id").alias("doc")).agg(F.max("version").alias("newest"))
    same = F.col("document_id").eqNullSafe(F.col("doc")) & F.col("version").eqNullSafe(F.col("newest"))
    return rows.join(newest, same, "left_semi").filter(F.col("vector").isNotNull())


def collection_info(spark: SparkSession, config: StoreConfig) -> DataFrame:
    """The settings, and for each collection of the vector table what it holds:
    vectors and documents, newest versions only."""
    try:
        table = read_table(spark, config.path, EMBEDDINGS)
    except _FAILURES as error:
        raise DatabaseConnectionError(f"Failed to connect to database: {error}") from error
    # Two levels of partial sums: a document's vectors of each version, then the newest.
    by_version = table.groupBy("collection_name", "document_id", "version").agg(F.count("vector").alias("n"))
    newest = by_version.groupBy("collection_name", "document_id").agg(F.max_by("n", "version").alias("n"))
    held = newest.groupBy("collection_name").agg(
        F.sum("n").alias("n_vectors"), F.count_if(F.col("n") > 0).alias("n_documents")
    )
    return held.select(
        "collection_name",
        F.lit(config.model_name).alias("model_name"),
        F.lit(config.batch_size).alias("batch_size"),
        F.lit(config.use_jsonb).alias("use_jsonb"),
        "n_vectors",
        "n_documents",
    )


def collection_of(slug: Column | str) -> Column:
    """The collection that belongs to a slug."""
    return F.concat(F.col(slug) if isinstance(slug, str) else slug, F.lit("_vdb"))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vector_id", vector_col: str = "vector") -> DataFrame:
    """The ``k`` vectors most similar to ``query`` (an addition of ours): partial
    top-k in every task, merged at the end."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_col, cosine_similarity(F.col(vector_col), wanted).alias("similarity"))
    return scored.orderBy(F.desc_nulls_last("similarity"), id_col).limit(k)


def init_tables(spark: SparkSession, database: str = "docmill") -> None:
    """Create the document and vector tables unless they exist."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in (("documents", DOCUMENTS), ("embeddings", EMBEDDINGS)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
