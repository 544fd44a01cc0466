"""Reads of the document and vector tables, and resuming by id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chunking import unused
from ..operators.commits import Catalog, Session, transact
from ..schema import DOCUMENTS


def by_id(docs: DataFrame, document_id: int, id_col: str = "id") -> DataFrame:
    """At most one row; the filter reaches the scan."""
    return docs.filter(F.col(id_col) == document_id).limit(1)


def embeddings_of(embeddings: DataFrame, document_id: int) -> DataFrame:
    return embeddings.filter(F.col("document_id") == document_id)


def resume(docs: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """The wanted ids (column ``id``) with their documents; ``resume_error``
    tells of ids that no document has."""
    known, asked = unused("known", docs.columns), unused("wanted", docs.columns)
    joined = wanted.select(F.col("id").alias(asked)).distinct().join(
        docs.withColumn(known, F.lit(True)), F.col(asked) == F.col(id_col), "left"
    )
    missing = F.concat(F.lit("No document found with ID "), F.col(asked).cast("string"))
    return joined.withColumn("resume_error", F.when(F.col(known).isNull(), missing)).drop(known, asked)


def new_documents(sources: DataFrame, first_id: int, path: str, source_col: str = "source") -> DataFrame:
    """Pending documents, one for each source and titled by it, see ``inserted``."""
    source = F.col(source_col).cast("string")
    return inserted(sources.select(F.coalesce(source, F.lit("")).alias("title"), source.alias("file_path")), first_id, path)


def create_documents(rows: DataFrame, first_id: int, path: str) -> DataFrame:
    """Given rows (title, markdown, and if at hand tags, doc_metadata as JSON,
    description) as documents with all defaults, see ``inserted``.  A row
    without a title ends the job."""
    given = ("markdown", "tags", "doc_metadata", "description")
    title = F.coalesce("title", F.raise_error(F.lit("a document needs a title")).cast("string"))
    return inserted(rows.select(title.alias("title"), *[c for c in given if c in rows.columns]), first_id, path)


def inserted(rows: DataFrame, first_id: int, path: str) -> DataFrame:
    """Append documents to the table at ``path``; the new ones come back.

    Ids are unique and rise from ``first_id`` on, but have gaps, so that they
    need no pass over all rows in one place.  They are given while the rows are
    written, in a folder of their own, and read from there: they never change."""
    now = F.current_timestamp()
    values = {c: F.col(c) for c in rows.columns} | {
        "id": F.lit(first_id) + F.monotonically_increasing_id(),
        "status": F.lit("pending"),
        "created_at": now,
        "updated_at": now,
    }
    docs = rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields])
    folder = f"{path}/insert={uuid.uuid4().hex}"
    docs.write.parquet(folder)
    return rows.sparkSession.read.schema(DOCUMENTS).parquet(folder)


def numbered(rows: DataFrame, session: Session, near: str) -> DataFrame:
    """``rows`` with ``place``, their number from 0 on, without gaps.

    Two passes: rows are written with their place in their partition, which
    then never changes, and the partitions' sizes, one row for each, are added up."""
    placed = session.scratch(rows.withColumn("place", F.monotonically_increasing_id()), near)
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", (F.coalesce(before, F.lit(0)) - F.shiftleft("part", 33)).alias("offset"))
    # A row for each partition: broadcast.
    joined = placed.join(F.broadcast(offsets), part == F.col("part"))
    return joined.withColumn("place", F.col("place") + F.col("offset")).select(*placed.columns)


def append_documents(rows: DataFrame, path: str) -> DataFrame:
    """Given rows (title, and if at hand markdown, tags, doc_metadata as JSON,
    description, file_path) as pending documents of the table at ``path``, whose
    ids go on from its largest without gaps.

    The table is guarded: of two inserts that come at once one begins again, on
    the other's ids.  The new documents come back.  A row without a title ends the
    job."""
    given = [c for c in ("markdown", "tags", "doc_metadata", "description", "file_path") if c in rows.columns]
    title = F.coalesce("title", F.raise_error(F.lit("a document needs a title")).cast("string"))
    plain = rows.select(title.alias("title"), *given)
    catalog = Catalog(rows.sparkSession, f"{path}/_commits")

    def insert(session: Session) -> DataFrame:
        session.guard(path)
        last = session.read(path, DOCUMENTS).agg(F.max("id")).first()[0] or 0
        now = F.current_timestamp()
        values = {c: F.col(c) for c in plain.columns} | {
            "id": F.lit(last + 1) + F.col("place"),
            "status": F.lit("pending"),
            "created_at": now,
            "updated_at": now,
        }
        made = numbered(plain, session, path).select(
            *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields]
        )
        return session.append(path, made)

    return transact(catalog, insert, attempts=20)


def log_status(docs: DataFrame, seq: int, id_col: str = "id") -> DataFrame:
    """The documents' statuses as rows of the append-only log, under ``seq``."""
    return docs.select(
        id_col, "status", F.col("status_details").alias("details"), F.lit(seq).cast("long").alias("seq")
    )


def not_embedded(docs: DataFrame, embeddings: DataFrame, id_col: str = "id") -> DataFrame:
    """Documents without any stored vector."""
    return docs.join(embeddings.select(F.col("document_id").alias(id_col)), id_col, "left_anti")


def latest_status(log: DataFrame, id_col: str = "id") -> DataFrame:
    """The last status of each document in an append-only log with ``seq``."""
    return log.groupBy(id_col).agg(
        F.max_by("status", "seq").alias("status"), F.max_by("details", "seq").alias("details")
    )
