"""Incremental ingestion: each micro-batch of new pages goes through the
lifecycle, stage by stage.  Its documents are written under the batch's number
and its vectors under a new version, so that a batch that runs again replaces its
own output; a batch whose run died goes on where that one stopped.  The status
log of a batch stays beside its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChunkConfig, StoreConfig
from ..functions.html import html_to_markdown
from ..operators.commits import Catalog
from ..plans.lifecycle import Work, ingest, resume
from ..schema import DOCUMENTS


def ingest_pages(
    pages: DataFrame, documents_path: str, store: StoreConfig, checkpoint: str, config: ChunkConfig = ChunkConfig()
) -> StreamingQuery:
    """Start ingesting a stream of (page_id, url, html); what is there now is
    processed, then the query ends."""

    def batch(rows: DataFrame, number: int) -> None:
        now = F.current_timestamp()
        # Pages may share a url, so a path is made of url and page_id.
        path = F.concat(F.coalesce("url", F.lit("https://")), F.lit("#"), F.col("page_id").cast("string"))
        values = {
            "id": F.col("page_id"),
            "title": F.coalesce("url", F.lit("")),
            "status": F.lit("pending"),
            "file_path": path,
            "created_at": now,
            "updated_at": now,
        }
        docs = rows.select(
            *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields]
        )
        contents = rows.select(path.alias("file_path"), html_to_markdown("html").alias("markdown"))
        work, catalog = f"{documents_path}/_work/batch={number}", Catalog(rows.sparkSession, f"{documents_path}/_commits")
        place = Work(rows.sparkSession, work, catalog)
        if place.begun():
            outcome = resume(rows.sparkSession, store, work, config, catalog=catalog)
        else:
            outcome = ingest(docs, contents, store, work, config, catalog=catalog)
        outcome.documents.write.mode("overwrite").parquet(f"{documents_path}/batch={number}")

    return (
        pages.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
