"""WARC archives: writing, normalising and reading.

``write_archives`` renders one record per page and lets Spark's text writer
compress each file as a single gzip stream, the monolithic form in which
archives are found in the wild.  Records are dealt over archives by size class,
so that no archive has more than about ``ARCHIVE_BYTES`` bytes before it is
compressed (or one record).  ``normalise_archives`` inflates each such stream
once, rewrites every record as a gzip member of its own and, in the same pass,
writes a sidecar index (record id and type, offset, length) beside the archive.
``read_archives`` and ``read_records`` cut the members that the index names out
of the archives, all of them or those of some record ids.

All files are read and written by Spark, so they can lie in any store that
Spark reaches, and a task that is lost and repeated leaves no partial file.  A
normalised archive, and its index, end with an empty gzip member, which adds no
content.  Their bytes go through Spark's text writer, which writes a string's
bytes as they are and doesn't check them; tests compare them byte by byte.

Of equal payloads of at least ``REVISIT_BYTES`` bytes the record with the
largest id is the response; the others are revisits that refer to it.  Which
payloads occur more than once is found by partial aggregation of digests, so a
payload in a third of all pages meets in no single task; the outcome is
broadcast only while it has at most ``BROADCAST_ROWS`` rows and is joined by
sort-merge, with hot keys split, beyond.

Edge cases: a null html is an empty payload; a null url gives an empty target;
control characters in a url are percent-encoded; null ids come back as null,
are never referred to, and equal payloads that all lack an id are all
responses; repeated rows with the largest id are each a response; an empty
table gives an empty archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import arrow_schema, struct_of
from .storage import discard, fresh_path, remove, saved

REVISIT_BYTES = 1000
BROADCAST_ROWS = 200_000

#: Bytes of records in an archive, and the largest record of each size class.
ARCHIVE_BYTES = 1 << 28
_CLASSES = [1 << 15, 1 << 20, 1 << 25]

#: Packed entries of an index that may be broadcast to the archives.
BROADCAST_ENTRIES = 2_000_000

_DATE = "2024-01-01T00:00:00Z"
_ID = "urn:docmill:page:"
_LEVEL = 4

#: Fixed value: the gzip member of no bytes.
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "00000000" "00000000")


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """page_id, url, payload, digest, n, and refers_to (null: a response); and
    the saved table of repeated payloads that these rows are made with."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    repeated = saved(
        rows.filter(F.col("n") >= REVISIT_BYTES)
        .groupBy("digest", "n")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
        .filter("copies > 1 and response_id is not null")
        .drop("copies"),
        "warc-repeated",
    )
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(repeated) if few else repeated, ["digest", "n"], "left")
    other = ~F.col("response_id").eqNullSafe(F.col("page_id"))
    refers = F.when(F.col("response_id").isNotNull() & other, F.col("response_id"))
    return joined.withColumn("refers_to", refers), repeated


def records(rows: DataFrame) -> DataFrame:
    """One text per record, without the line end that the writer adds."""
    end = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(end * 2),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.col("url")
    for code in (*range(0x20), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.when(F.col("url").rlike(r"[\x00-\x1f\x7f]"), url).otherwise(F.col("url"))
    uri = F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    refers = F.concat(
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{end}"),
        F.lit(f"WARC-Refers-To: <{_ID}"),
        F.col("refers_to").cast("string"),
        F.lit(f">{end}"),
    )
    return rows.select(
        F.concat(
            F.lit("WARC/1.1" + end + "WARC-Type: "),
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit(f"{end}WARC-Record-ID: "),
            uri,
            F.lit(f"{end}WARC-Date: {_DATE}{end}WARC-Target-URI: "),
            url,
            F.lit(f"{end}WARC-Payload-Digest: sha1:"),
            F.col("digest"),
            F.lit(end),
            F.when(revisit, refers).otherwise(F.lit("")),
            F.lit(f"Content-Type: application/http;msgtype=response{end}Content-Length: "),
            F.octet_length(block).cast("string"),
            F.lit(end * 2),
            block,
            F.lit(end),
        ).alias("value")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write all pages as archives of one gzip stream each under ``path``."""
    rows, repeated = with_revisits(pages, id_col, url_col, html_col)
    size = F.octet_length(F.coalesce(F.col(html_col).cast("string"), F.lit(""))) + F.octet_length(
        F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    )
    present = {r[0] for r in pages.select(_class_of(size)).distinct().collect()} or {0}
    rows = rows.withColumn("class", _class_of(F.col("n") + F.octet_length("url")))
    for k in sorted(present):
        most = max(1, ARCHIVE_BYTES // _CLASSES[k]) if k < len(_CLASSES) else 1
        (
            records(rows.filter(F.col("class") == k))
            .write.mode("append")
            .option("compression", "gzip")
            .option("lineSep", "\r\n")
            .option("maxRecordsPerFile", most)
            .text(path)
        )
    discard(repeated)


def _class_of(size: Column) -> Column:
    """The size class of a record; the last one has no upper end."""
    out = F.lit(len(_CLASSES))
    for k in range(len(_CLASSES) - 1, -1, -1):
        out = F.when(size <= _CLASSES[k], k).otherwise(out)
    return out


class _Inflater:
    """Bytes of a gzip stream (of one or many members), inflated as needed."""

    def __init__(self, content: bytes, step: int = 1 << 16):
        self._content, self._at, self._step = content, 0, step
        self._stream = zlib.decompressobj(31)
        self._ready = bytearray()

    def _more(self) -> bool:
        while True:
            if self._stream.eof:
                rest = self._stream.unused_data
                if not rest and self._at >= len(self._content):
                    return False
                self._at -= len(rest)
                self._stream = zlib.decompressobj(31)
            if self._at >= len(self._content):
                return False
            piece = self._content[self._at : self._at + self._step]
            self._at += len(piece)
            got = self._stream.decompress(piece)
            if got:
                self._ready += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``, or nothing at the end of the stream."""
        seen = 0
        while (at := self._ready.find(mark, seen)) < 0:
            seen = max(0, len(self._ready) - len(mark) + 1)
            if not self._more():
                if self._ready.strip():
                    raise ValueError("the archive ends inside a record's headers")
                return b""
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self._ready) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self._ready[:n])
        del self._ready[:n]
        return out


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def raw_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record of an archive: its headers and its bytes."""
    stream = _Inflater(content)
    while head := stream.until(b"\r\n\r\n"):
        headers = _headers(head)
        yield headers, head + stream.take(int(headers["content-length"])) + stream.take(4)


def _member(data: bytes) -> bytes:
    press = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def members(content: bytes, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated bytes) of each gzip member that isn't empty."""
    offset = 0
    while offset < len(content):
        stream, at, parts = zlib.decompressobj(31), offset, []
        while not stream.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a member")
            parts.append(stream.decompress(content[at : at + step]))
            at += step
        end = min(at, len(content)) - len(stream.unused_data)
        data = b"".join(parts)
        if data:
            yield offset, end - offset, data
        offset = end


_FILE = struct_of("kind string, archive string, content binary")

#: A line of an index; record ids and types hold no tabs.
_LINE = "{}\t{}\t{}\t{}\n"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive in; out comes the normalised archive and its index, itself a
    gzip member of lines."""
    schema = arrow_schema(_FILE)
    for batch in batches:
        for i in range(batch.num_rows):
            name = batch.column("path")[i].as_py().rsplit("/", 1)[-1].split(".")[0]
            parts, lines, offset = [], [], 0
            for headers, data in raw_records(batch.column("content")[i].as_py()):
                member = _member(data)
                ident, kind = (headers.get(k, "").replace("\t", " ") for k in ("warc-record-id", "warc-type"))
                lines.append(_LINE.format(ident, kind, offset, len(member)))
                parts.append(member)
                offset += len(member)
            content, index = b"".join(parts), _member("".join(lines).encode())
            yield _batch([["archives", "index"], [name, name], [content, index]], schema)


_ENTRY = struct_of("archive string, record_id string, record_type string, offset long, length long")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of index files."""
    schema = arrow_schema(_ENTRY)
    for batch in batches:
        for i in range(batch.num_rows):
            name = batch.column("archive")[i].as_py()
            lines = b"".join(data for _, _, data in members(batch.column("content")[i].as_py())).decode().split("\n")[:-1]
            for at in range(0, len(lines), 10_000):
                rows = [x.split("\t") for x in lines[at : at + 10_000]]
                ids, kinds, offsets, lengths = map(list, zip(*rows))
                out = [[name] * len(rows), ids, kinds, list(map(int, offsets)), list(map(int, lengths))]
                yield _batch(out, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select("path", "content")
    )


def _normalised(spark: SparkSession, path: str, kind: str) -> DataFrame:
    name = F.regexp_extract("path", r"/archive=([^/]*)/", 1)
    return _files(spark, f"{path}/kind={kind}").select(name.alias("archive"), "content")


def normalise_archives(spark: SparkSession, path: str, out: str) -> None:
    """Rewrite the archives under ``path`` as ``out/kind=archives`` (one member
    per record) and ``out/kind=index`` (an index per archive), in one pass."""
    (
        _files(spark, path)
        .mapInArrow(_normalise, _FILE)
        .select(F.col("content").cast("string").alias("value"), "kind", "archive")
        .write.partitionBy("kind", "archive")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
        .text(out)
    )


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the normalised archives under ``path``."""
    return _normalised(spark, path, "index").mapInArrow(_entries, _ENTRY)


_READ = struct_of(
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long"
)


def _page_id(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix(_ID)
    return int(tail) if tail else None


def _record(data: bytes) -> tuple:
    """One record's row of ``_READ``."""
    head, _, block = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    http, _, payload = block[: int(headers["content-length"])].partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    return (
        _page_id(headers["warc-record-id"]),
        headers.get("warc-target-uri"),
        payload,
        int(_headers(http)["content-length"]) if revisit else len(payload),
        headers["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha1(payload).hexdigest(),
        headers["warc-type"],
        _page_id(headers.get("warc-refers-to")),
    )


def _rows(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_READ)
    out: list[list] = [[] for _ in schema]
    for data in records:
        for column, value in zip(out, _record(data)):
            column.append(value)
        if len(out[0]) >= 1000:
            yield _batch(out, schema)
    if out[0]:
        yield _batch(out, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            content = batch.column("content")[i].as_py()
            entries = sorted((e["offset"], e["length"]) for e in batch.column("entries")[i].as_py())
            yield from _rows(zlib.decompress(content[o : o + n], 31) for o, n in entries)


def _batch(out: list[list], schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)
    for c in out:
        c.clear()
    return batch


def _cut(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """The records that index entries name.  They are counted, and broadcast to
    the archives only while they are few; else both sides are shuffled."""
    entries = entries.select("archive", "offset", "length")
    few = entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    of_archive = entries.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("entries"))
    archives = _normalised(spark, path, "archives")
    return archives.join(F.broadcast(of_archive) if few else of_archive, "archive").select("content", "entries").mapInArrow(_read, _READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the normalised archives under ``path``, as the index has it.

    Length and digest are measured on a response's payload; a revisit has
    those of the payload it stands for in its headers."""
    return _cut(spark, path, archive_index(spark, path))


def read_records(spark: SparkSession, path: str, record_ids: DataFrame) -> DataFrame:
    """The records whose ids (column ``record_id``) are asked for: the index
    says where each stands, and only those members are inflated."""
    wanted = record_ids.select("record_id").distinct()
    return _cut(spark, path, archive_index(spark, path).join(wanted, "record_id", "left_semi"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write, normalise and read back all pages under the shared folder."""
    base = fresh_path(spark, "warc")
    write_archives(pages, f"{base}/raw")
    normalise_archives(spark, f"{base}/raw", f"{base}/normal")
    remove(spark, f"{base}/raw")
    return read_archives(spark, f"{base}/normal")
