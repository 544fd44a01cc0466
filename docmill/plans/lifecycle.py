"""The ingestion lifecycle over a whole table of documents.

Each stage filters by status, transforms, and gives the table with new statuses
and details; a document that fails becomes a row with its message, never the
end of the job.  In one call a document goes through all stages that its status
leaves open.  Documents found in chunking, embedding or failed stay as they are
unless ``retry`` is set.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig, StoreConfig
from ..functions.text import title_anywhere
from ..operators.chunking import unused, with_chunks
from ..operators.commits import Catalog, Manifest, Session, read_table, remove, session_scope
from ..operators.store import append_vectors, embedded_rows, with_embeddings
from ..schema import STATUS_LOG
from ..sources.documents import latest_status, log_status
from ..sources.route import source_kind

#: Where a document that stands in the middle of a stage begins again on retry.
_RETRY = {"failed": "pending", "chunking": "parsed", "embedding": "chunked"}


def taken_by(stage: str) -> Column:
    """Whether a document's status lets a stage take it."""
    open_ = {"parsing": ["pending", "parsing"], "chunking": ["parsed"], "embedding": ["chunked"]}
    return F.coalesce(F.col("status").isin(*open_[stage]), F.lit(False))


def set_status(docs: DataFrame, when: Column, status: Column | str, details: Column | None = None) -> DataFrame:
    """Set status and details where ``when`` holds; details that aren't given
    are reset."""
    new = F.lit(status) if isinstance(status, str) else status
    note = F.lit(None).cast("string") if details is None else details
    return docs.withColumns(
        {
            "status_details": F.when(when, note).otherwise(F.col("status_details")),
            "updated_at": F.when(when, F.current_timestamp()).otherwise(F.col("updated_at")),
            "status": F.when(when, new).otherwise(F.col("status")),
        }
    )


def parse(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """Take the Markdown of pending documents from ``contents`` (``file_path``,
    ``markdown``), which the sources make, one row for each path."""
    content, opened, failure = (unused(c, docs.columns) for c in ("content", "opened", "failure"))
    # Contents are whole texts: they are never broadcast, however small they seem.
    found = contents.select("file_path", F.col("markdown").alias(content)).hint("merge")
    joined = docs.join(found, "file_path", "left").select(*docs.columns, content)
    unsupported = F.concat(F.lit("Unsupported file type for: "), F.coalesce("file_path", F.lit("")))
    error = F.when(source_kind(F.coalesce("file_path", F.lit(""))) == "unsupported", unsupported).when(
        F.coalesce(content, F.lit("")) == "", F.lit("Parsing resulted in empty content.")
    )
    good = taken_by("parsing") & error.isNull()
    out = joined.withColumns(
        {
            "markdown": F.when(good, F.col(content)).otherwise(F.col("markdown")),
            "title": F.when(good, F.coalesce(title_anywhere(content), "title")).otherwise(F.col("title")),
            opened: taken_by("parsing"),
            failure: error,
        }
    )
    failed = F.concat(F.lit("Parsing failed: "), F.col(failure))
    out = set_status(out, F.col(opened) & F.col(failure).isNotNull(), "failed", failed)
    out = set_status(out, F.col(opened) & F.col(failure).isNull(), "parsed")
    return out.select(*docs.columns)


def chunk(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunk parsed documents."""
    opened, text, old, failure = (unused(c, docs.columns) for c in ("opened", "text", "old", "failure"))
    missing = F.coalesce("markdown", F.lit("")) == ""
    no_text = F.concat(F.lit("Cannot chunk doc "), F.col("id").cast("string"), F.lit(", markdown content is missing."))
    work = docs.withColumns(
        {opened: taken_by("chunking"), text: F.when(taken_by("chunking") & ~missing, F.col("markdown")), old: F.col("chunks")}
    )
    out = with_chunks(work, text, "title", config)
    error = F.when(missing, no_text).when(
        F.col("chunk_error").isNotNull(), F.concat(F.lit("Chunking failed: "), F.col("chunk_error"))
    )
    out = out.withColumn(failure, F.when(F.col(opened), error))
    good = F.col(opened) & F.col(failure).isNull()
    out = out.withColumn("chunks", F.when(good, F.col("chunks")).otherwise(F.col(old)))
    out = set_status(out, F.col(failure).isNotNull(), "failed", F.col(failure))
    out = set_status(out, good, "chunked")
    return out.select(*docs.columns)


def embedded(docs: DataFrame, config: StoreConfig) -> DataFrame:
    """``docs`` with ``embedded``: the vectors of chunked documents.  Statuses and
    vectors are both made of this table, so it is to be kept."""
    return with_embeddings(docs, config, taken_by("embedding") & (F.size("chunks") > 0))


def embedding_status(done: DataFrame) -> DataFrame:
    """The documents with new statuses, from a table with their vectors.

    A document counts as completed even if some of its batches failed; the
    details give how many chunks were embedded."""
    stored = F.coalesce(F.size(F.filter("embedded", lambda e: e["vector"].isNotNull())), F.lit(0))
    empty = F.coalesce(F.size("chunks"), F.lit(0)) <= 0
    text = F.concat(F.lit("Successfully embedded "), stored.cast("string"), F.lit(" chunks."))
    missing = F.concat(F.lit("Cannot embed doc "), F.col("id").cast("string"), F.lit(", chunks are missing."))
    out = set_status(
        done,
        taken_by("embedding"),
        F.when(empty, "failed").otherwise("completed"),
        F.when(empty, missing).otherwise(text),
    )
    return out.drop("embedded")


def reopen(docs: DataFrame) -> DataFrame:
    """Put documents that stopped in a stage back to that stage's beginning."""
    back = F.create_map(*[F.lit(x) for pair in _RETRY.items() for x in pair])
    stuck = F.col("status").isin(*_RETRY)
    return set_status(docs, stuck, F.try_element_at(back, F.col("status")))


def persisted(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def process(
    docs: DataFrame,
    contents: DataFrame,
    store: StoreConfig,
    config: ChunkConfig = ChunkConfig(),
    retry: bool = False,
    keep: Callable[[DataFrame], DataFrame] = persisted,
) -> tuple[DataFrame, DataFrame]:
    """All stages: the documents with new statuses, and the vectors made.

    ``keep`` is applied to the table that both come from, so that nothing is
    parsed, chunked or embedded twice.  ``ingest`` writes every stage instead."""
    start = reopen(docs) if retry else docs
    done = keep(embedded(chunk(parse(start, contents), config), store))
    return embedding_status(done), embedded_rows(done, store)


class StatusLog:
    """The append-only log of statuses in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path

    def append(self, session: Session, docs: DataFrame, status: str | None = None) -> None:
        """The documents' statuses, or the one given for all, as the newest."""
        rows = docs.withColumns({"status": F.lit(status), "status_details": F.lit(None).cast("string")}) if status else docs
        session.append(self.path, log_status(rows, session.seq))

    def rows(self) -> DataFrame:
        return read_table(self._spark, self.path, STATUS_LOG)

    def latest(self) -> DataFrame:
        return latest_status(self.rows())


@dataclass(frozen=True)
class StageTime:
    """How long a stage took, over how many documents, and how many failed."""

    stage: str
    documents: int
    failures: int
    seconds: float


@dataclass(frozen=True)
class Outcome:
    documents: DataFrame
    log: StatusLog
    times: list[StageTime]


#: Columns of stored documents: by which commit they were taken in, and their
#: vectors as they were made, from which the vector table's rows are.
_SEQ, _MADE = "_docmill_seq", "_docmill_embedded"

#: What a document was that the log has in a stage.
_BEFORE = {"parsing": "pending", "chunking": "parsed", "embedding": "chunked"}

STAGES = ("parsing", "chunking", "embedding")


class Work:
    """The tables of a work folder: documents, their parsed contents, the status
    log.  ``catalog`` says where commits are kept, by default in the folder itself.

    Every document has one row.  A commit that changes documents writes the
    folders anew that hold them, and leaves the others, of earlier intakes say, as
    they are; so reading needs no join, whole rows are never shuffled, and which
    folders are concerned is found from statuses and ids alone.  ``tidy`` deletes
    the folders that a stage replaced as soon as it is committed, for work that
    nobody else reads; else ``Catalog.vacuum`` does."""

    def __init__(self, spark: SparkSession, path: str, catalog: Catalog | None = None, tidy: bool = False):
        self.spark, self.path, self.tidy = spark, path.rstrip("/"), tidy
        self.catalog = catalog or Catalog(spark, f"{self.path}/_commits")
        self.documents, self.contents = f"{self.path}/documents", f"{self.path}/contents"
        self.log = StatusLog(spark, f"{self.path}/status_log")

    def begun(self) -> bool:
        return self.documents in self.catalog.manifest().tables

    def enter(self, docs: DataFrame, contents: DataFrame) -> None:
        """Store documents and what the sources parsed, so that the folder alone
        is enough to go on from.  Documents of known ids take the place of the old."""
        with session_scope(self.catalog) as session:
            session.guard(self.documents)
            seq = F.lit(session.seq)
            stored = session.append(self.documents, docs.withColumn(_SEQ, seq))
            session.append(self.contents, contents.select("file_path", "markdown").withColumn(_SEQ, seq))
            old = self.catalog.read(self.documents, at=session.base, named=True).drop(_MADE)
            if old.columns:
                ids = stored.select("id").distinct()
                held = old.select("id", "txn").join(ids, "id", "left_semi").groupBy("txn").count().collect()
                if held:
                    rest = old.filter(F.col("txn").isin([r["txn"] for r in held])).join(ids, "id", "left_anti")
                    session.append(self.documents, rest.select(*stored.columns))
                    session.remove(self.documents, {f"txn={r['txn']}" for r in held})

    def _current(self, at: Manifest) -> tuple[DataFrame, bool]:
        """The documents with ``txn`` and ``stopped``: whether the log has them in a
        stage that never came to its end; their status is then the stage's.  And
        whether there are any."""
        rows = self.catalog.read(self.documents, at=at, named=True).drop(_MADE)
        stuck = self._stuck(at)
        if stuck.isEmpty():
            return rows.withColumn("stopped", F.lit(None).cast("string")), False
        joined = rows.join(stuck, "id", "left").select(*rows.columns, "stopped")
        return joined.withColumn("status", F.coalesce("stopped", "status")), True

    def table(self) -> DataFrame:
        """The documents as the log and the stages leave them."""
        return self._current(self.catalog.manifest())[0].drop("stopped", "txn", _SEQ)

    def _rewrite(self, session: Session, rows: DataFrame, taken: Column, held: list[Row], after: DataFrame) -> DataFrame:
        """Write what became of the ``taken`` documents of ``rows``, and the
        others of their folders (``held``: txn, n of all, taken) as they were."""
        stored = session.append(self.documents, after)
        mixed = [r["txn"] for r in held if r["taken"] < r["n"]]
        if mixed:
            others = rows.filter(F.col("txn").isin(mixed) & ~taken)
            session.append(self.documents, others.select(*[c for c in stored.columns if c != _MADE]))
        session.remove(self.documents, {f"txn={r['txn']}" for r in held})
        return stored

    @staticmethod
    def _held(rows: DataFrame, taken: Column) -> list[Row]:
        """The folders that hold taken documents, with their intakes; a narrow scan."""
        by_folder = rows.groupBy("txn").agg(
            F.count("*").alias("n"),
            F.count_if(taken).alias("taken"),
            F.collect_set(F.when(taken, F.col(_SEQ))).alias("seqs"),
        )
        return by_folder.filter("taken > 0").collect()

    def _stuck(self, at: Manifest) -> DataFrame:
        """(id, stopped): documents that the log has in a stage."""
        log = latest_status(self.catalog.read(self.log.path, STATUS_LOG, at))
        return log.filter(F.col("status").isin(*STAGES)).select("id", F.col("status").alias("stopped"))

    def reopen(self, failed: bool = False) -> None:
        """Put documents whose stage never came to its end back to its beginning,
        with ``failed`` also those that failed.

        What a stage doesn't commit leaves its documents' rows as they were, so
        for the former it is enough that the log says so."""
        with session_scope(self.catalog) as session:
            before = F.create_map(*[F.lit(x) for pair in _BEFORE.items() for x in pair])
            stuck = self._stuck(session.base).select("id", F.try_element_at(before, F.col("stopped")).alias("status"))
            self.log.append(session, stuck.withColumn("status_details", F.lit(None).cast("string")))
        if not failed:
            return
        rows, _ = self._current(self.catalog.manifest())
        taken = F.coalesce(F.col("status") == "failed", F.lit(False))
        held = self._held(rows, taken)
        if held:
            begins = reopen(rows.filter(taken).drop("stopped", "txn"))
            with session_scope(self.catalog) as session:
                self.log.append(session, self._rewrite(session, rows, taken, held, begins))

    def mark(self, stage: str) -> None:
        """Log the documents that a stage takes as being in it."""
        with session_scope(self.catalog) as session:
            self.log.append(session, self.table().filter(taken_by(stage)), stage)

    def run(self, stage: str, store: StoreConfig, config: ChunkConfig) -> StageTime:
        """One stage over the documents that are open for it.

        They are logged first; then the stage's rows, statuses and vectors are
        written and committed together.  Failures are observed while rows are
        written."""
        start = time.monotonic()
        rows, _ = self._current(self.catalog.manifest())
        taken = taken_by(stage)
        held = self._held(rows, taken)
        if not held:
            return StageTime(stage, 0, 0, time.monotonic() - start)
        self.mark(stage)
        opened = rows.filter(taken).drop("stopped", "txn")
        seen = Observation()
        with session_scope(self.catalog) as session:
            if stage == "parsing":
                after = self._parsed(opened, {seq for r in held for seq in r["seqs"]})
            elif stage == "chunking":
                after = chunk(opened, config)
            else:
                done = embedded(opened, store)
                after = embedding_status(done.withColumn(_MADE, F.col("embedded")))
            counted = after.observe(seen, F.count_if(F.col("status") == "failed").alias("failures"))
            stored = self._rewrite(session, rows, taken, held, counted)
            self.log.append(session, stored)
            if stage == "embedding":
                # Made once, with the documents, and read from there.
                done = stored.withColumnRenamed(_MADE, "embedded")
                append_vectors(session, embedded_rows(done, store), store, done)
        if self.tidy:
            for r in held:
                remove(self.spark, f"{self.documents}/txn={r['txn']}")
            if stage == "parsing":
                self._forget_contents()
        return StageTime(stage, sum(r["taken"] for r in held), seen.get["failures"], time.monotonic() - start)

    def _forget_contents(self) -> None:
        """Delete contents, which the documents that were waiting for them hold now."""
        with session_scope(self.catalog) as session:
            gone = session.folders(self.contents)
            session.drop(self.contents)
        for folder in gone:
            remove(self.spark, f"{self.contents}/{folder}")

    def _parsed(self, opened: DataFrame, seqs: set[int]) -> DataFrame:
        """Each intake's documents with the contents that came with them."""
        contents = self.catalog.read(self.contents)
        parts = [
            parse(opened.filter(F.col(_SEQ) == seq), contents.filter(F.col(_SEQ) == seq).drop(_SEQ)) for seq in sorted(seqs)
        ]
        return reduce(DataFrame.unionByName, parts)


def ingest(
    docs: DataFrame,
    contents: DataFrame,
    store: StoreConfig,
    work: str,
    config: ChunkConfig = ChunkConfig(),
    retry: bool = False,
    catalog: Catalog | None = None,
) -> Outcome:
    """Take documents into the work folder and through all stages.

    Before a stage, the documents that it takes are logged as being in it; what
    came of them is committed together with its vectors.  A run that dies leaves no
    half of a stage, and ``resume`` goes on from the folder alone."""
    place = Work(docs.sparkSession, work, catalog)
    place.enter(reopen(docs) if retry else docs, contents)
    return _advance(place, store, config)


def resume(
    spark: SparkSession,
    store: StoreConfig,
    work: str,
    config: ChunkConfig = ChunkConfig(),
    retry: bool = False,
    catalog: Catalog | None = None,
) -> Outcome:
    """Go on with what a run left in its work folder.

    Documents that it died with in the middle of a stage begin that stage again,
    with ``retry`` those that failed begin anew; stages that were committed aren't
    run again."""
    place = Work(spark, work, catalog)
    if not place.begun():
        raise ValueError(f"no documents were taken into {work}")
    place.reopen(retry)
    return _advance(place, store, config)


def _advance(place: Work, store: StoreConfig, config: ChunkConfig) -> Outcome:
    times = [place.run(stage, store, config) for stage in STAGES]
    return Outcome(place.table(), place.log, times)
