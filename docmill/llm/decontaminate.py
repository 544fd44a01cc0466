"""Benchmark decontamination with an FM-index per training shard.

Test phrases are windows of ``WINDOW`` consecutive words of a benchmark item
(an item with fewer words is one window).  A shard is a run of a task's
documents, cut where its index has ``SHARD_WORDS`` words (or its rows have
``SHARD_ROWS`` or ``SHARD_BYTES``).  Phrases are searched backwards, all at
once, through the ranks of the shard's wavelet tree, their occurrences are
located by sampled suffix positions, and the word spans found in a document are
merged into removal spans.

The benchmark is cut into blocks of about ``BLOCK_WORDS`` words, dealt by hash,
a long item in overlapping pieces.  The driver holds one block at a time.

* One block: a single pass over the texts.  Words are numbered by the block's
  vocabulary; a window can only stand inside a run of vocabulary words at least
  as long as the shortest window, so such runs, and no others, are put one after
  another into the shard's index, with a mark between them.
* Several blocks: the shards' indexes, over all words, are made once and saved
  in the shared folder; then each block is searched in them, and what it finds
  is saved too.  Texts are read once, whatever the number of blocks.

Edge cases: null or empty texts have no words and no hits; items without words
have no windows; items with a null id count for hits but aren't named; repeated
items count once by id; very long runs are cut into overlapping pieces that go
to several shards; an empty table on either side gives no hits; columns other
than the ids and the texts are ignored, or kept where rows are kept, whatever
their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import arrow_schema, map_batches, release, struct_of, unused, utf8
from .fm_index import FmIndex
from .storage import discard, fresh_path, saved
from .words import alnum_words

WINDOW = 13
SHARD_WORDS = 1_000_000
SHARD_ROWS = 8192
SHARD_BYTES = 32_000_000
BLOCK_WORDS = 400_000
BROADCAST_ROWS = 300_000

#: Words of an item's piece, besides those that it shares with the next one.
PIECE_WORDS = 2000

_MARK = 1  # between runs; words are numbered from 2


class Phrases:
    """The distinct windows of a block of benchmark items, and who has them.

    Windows stand in the rows of ``patterns``, the items' names that window i
    belongs to are ``named[owner[first[i] : first[i + 1]]]``."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.named: list[str] = sorted({name for name, words in items if words and name is not None})
        number = {name: i for i, name in enumerate(self.named)}
        rows, owners = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        for name, words in items:
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words], np.int32)
            ids = np.pad(ids, (0, max(0, window - len(ids))))
            found = np.lib.stride_tricks.sliding_window_view(ids, window)
            rows.append(found)
            owners.append(np.full(len(found), number.get(name, -1)))
        self.patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(1)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], axis=1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        self.owner = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        self.shortest = int(self.lengths.min(initial=window))

    def owners_of(self, window: int) -> list[str]:
        return [self.named[i] for i in self.owner[self.first[window] : self.first[window + 1]].tolist()]


def benchmark_pieces(items: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(item, words, n): the benchmark's pieces, saved, and the number of blocks
    that they are dealt over.  ``items`` has ``item`` and ``text``."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            names, pieces, sizes = [], [], []
            for name, text in zip(batch.column("item").to_pylist(), utf8(batch, "text")):
                words = alnum_words(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = words[at : at + PIECE_WORDS + window - 1]
                    if piece:
                        names.append(name)
                        pieces.append(b" ".join(piece))
                        sizes.append(len(piece))
            return [names, pa.array(pieces, pa.binary()), sizes]

        return work

    cut = saved(map_batches(items, make, "item string, words binary, n long", 256), "benchmark")
    total = cut.agg(F.sum("n")).first()[0] or 0
    return cut, max(1, -(-total // BLOCK_WORDS))


def block_phrases(pieces: DataFrame, block: int, blocks: int, window: int) -> Phrases:
    """One block, on the driver."""
    here = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block
    rows = pieces.filter(here).select("item", "words").collect()
    return Phrases([(r["item"], bytes(r["words"]).split(b" ")) for r in rows], window)


class Shard:
    """Words of some documents, their index, and its search.

    With ``phrases`` only runs of their vocabulary are held, in its numbers;
    without, all words, numbered as they come."""

    def __init__(self, window: int, phrases: Phrases | None = None):
        self._filtered = phrases is not None
        self.vocabulary = phrases.vocabulary if phrases else {}
        self._shortest = phrases.shortest if phrases else 1
        self._window = window
        self.clear()

    def clear(self) -> None:
        if not self._filtered:
            self.vocabulary = {}
        self._pieces: list[np.ndarray] = []
        self._docs, self._starts, self.size = [], [], 0

    def add(self, doc: int, words: list[bytes]) -> Iterator[None]:
        """Take a document's runs that a window may stand in; yields when the
        shard is full, so that the caller searches and clears it."""
        if self._filtered:
            get = self.vocabulary.get
            ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        else:
            ids = np.empty(len(words), np.int32)
            for at in range(0, len(words), SHARD_WORDS):
                put, size = self.vocabulary.setdefault, self.vocabulary.__len__
                ids[at : at + SHARD_WORDS] = [put(w, size() + 2) for w in words[at : at + SHARD_WORDS]]
        inside = np.concatenate([[False], ids > 0, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        step = max(1, SHARD_WORDS - self._window + 1)
        for start, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if end - start < self._shortest:
                continue
            for at in range(start, max(start + 1, end - self._window + 1), step):
                piece = ids[at : min(end, at + step + self._window - 1)]
                self._pieces.append(piece)
                self._docs.append(doc)
                self._starts.append(at)
                self.size += len(piece) + 1
                if self.size >= SHARD_WORDS:
                    yield None
                    if not self._filtered and at + step < end:
                        # The vocabulary went with the index; the rest is numbered anew.
                        yield from self._again(doc, words, at + step)
                        return

    def _again(self, doc: int, words: list[bytes], at: int) -> Iterator[None]:
        for _ in self.add(doc, words[at:]):
            self._starts = [s + at if d == doc else s for s, d in zip(self._starts, self._docs)]
            yield None
        self._starts = [s + at if d == doc else s for s, d in zip(self._starts, self._docs)]

    def index(self) -> ShardIndex | None:
        if not self._pieces:
            return None
        marked = np.full(self.size, _MARK, np.int32)
        sizes = np.array([len(p) for p in self._pieces]) + 1
        ends = np.cumsum(sizes)
        keep = np.ones(self.size, bool)
        keep[ends - 1] = False
        marked[keep] = np.concatenate(self._pieces)
        return ShardIndex(
            FmIndex(marked),
            ends - sizes,
            np.array(self._docs, np.int64),
            np.array(self._starts, np.int64),
            None if self._filtered else self.vocabulary,
        )


class ShardIndex:
    """The FM-index of a shard and the places of its pieces; it pickles."""

    def __init__(self, fm: FmIndex, opens: np.ndarray, docs: np.ndarray, starts: np.ndarray, vocabulary: dict | None):
        self._fm, self._opens, self._docs, self._starts, self._vocabulary = fm, opens, docs, starts, vocabulary

    def _numbered(self, phrases: Phrases) -> np.ndarray:
        """The patterns in this shard's numbers; words it lacks get one beyond."""
        if self._vocabulary is None:
            return phrases.patterns
        get, lacks = self._vocabulary.get, len(self._vocabulary) + 2
        numbers = np.zeros(len(phrases.vocabulary) + 2, np.int32)
        numbers[2:] = [get(w, lacks) for w in phrases.vocabulary]
        return numbers[phrases.patterns]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, ...]:
        """(document, first word, word after the last, window) of all
        occurrences, by document."""
        low, high = self._fm.search(self._numbered(phrases), phrases.lengths)
        found = np.flatnonzero(high > low)
        n = (high - low)[found]
        window = np.repeat(found, n)
        rows = np.repeat(low[found], n) + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        at = self._fm.locate(rows)
        piece = np.searchsorted(self._opens, at, "right") - 1
        start = self._starts[piece] + at - self._opens[piece]
        doc = self._docs[piece]
        order = np.lexsort((start, doc))
        return tuple(x[order] for x in (doc, start, start + phrases.lengths[window], window))


class Found:
    """Spans and items of the documents that were hit."""

    def __init__(self) -> None:
        self.spans: dict[int, list] = {}
        self.items: dict[int, set] = {}

    def take(self, index: ShardIndex | None, phrases: Phrases) -> None:
        if index is None:
            return
        doc, start, end, window = index.search(phrases)
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for d, s, e, w in zip(*(np.split(x, cuts) for x in (doc, start, end, window))):
            if len(d):
                key = int(d[0])
                self.spans[key] = merged([*self.spans.get(key, []), *zip(s.tolist(), e.tolist())])
                names = self.items.setdefault(key, set())
                for i in np.unique(w).tolist():
                    names.update(phrases.owners_of(i))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def by_shard(
    batches: Iterator[pa.RecordBatch], text_col: str, phrases: Phrases, window: int
) -> Iterator[tuple[list[pa.RecordBatch], list[int], Found]]:
    """The rows of a task shard by shard: batches, words of each row, and what
    was found, by the row's number among them."""
    shard = Shard(window, phrases)
    held: list[pa.RecordBatch] = []
    counts: list[int] = []
    found, size = Found(), 0

    for batch in batches:
        release()
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            for text in utf8(rows, text_col):
                words = alnum_words(text)
                size += len(text)
                for _ in shard.add(len(counts), words):
                    found.take(shard.index(), phrases)
                    shard.clear()
                counts.append(len(words))
            held.append(rows)
            if size >= SHARD_BYTES or len(counts) >= SHARD_ROWS:
                found.take(shard.index(), phrases)
                shard.clear()
                yield held, counts, found
                held, counts, found, size = [], [], Found(), 0
    if counts:
        found.take(shard.index(), phrases)
        yield held, counts, found


_FOUND = "id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _one_pass(rows: DataFrame, phrases: Phrases, window: int) -> DataFrame:
    schema = struct_of(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, counts, found in by_shard(batches, "text", phrases, window):
            ids = pa.concat_arrays([b.column("id") for b in held])
            spans = [found.spans.get(i, ()) for i in range(len(counts))]
            columns = [
                counts,
                [[a for a, _ in s] for s in spans],
                [[b for _, b in s] for s in spans],
                [sorted(found.items.get(i, ())) for i in range(len(counts))],
            ]
            arrow = arrow_schema(schema)
            arrays = [ids, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.mapInArrow(run, schema)


_INDEXED = "row long, id long, n_words long, shard binary"


def _indexed(rows: DataFrame, window: int) -> DataFrame:
    """A row for each document, numbered anew, and a row for each shard's index."""
    schema = struct_of(_INDEXED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        row = TaskContext.get().partitionId() << 40
        shard = Shard(window)

        def packed() -> pa.RecordBatch:
            blob = pickle.dumps(shard.index(), protocol=5)
            shard.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, None, blob), arrow)], schema=arrow)

        for batch in batches:
            release()
            for at in range(0, batch.num_rows, 256):
                part, counts, first = batch.slice(at, 256), [], row
                for text in utf8(part, "text"):
                    words = alnum_words(text)
                    for _ in shard.add(row, words):
                        yield packed()
                    counts.append(len(words))
                    row += 1
                numbers = pa.array(range(first, row), pa.int64())
                blobs = pa.nulls(len(counts), pa.binary())
                yield pa.RecordBatch.from_arrays([numbers, part.column("id"), pa.array(counts, pa.int64()), blobs], schema=arrow)
        if shard.size:
            yield packed()

    return rows.mapInArrow(run, schema)


_HIT = "row long, starts array<long>, ends array<long>, items array<string>"


def _search_block(shards: DataFrame, phrases: Phrases) -> DataFrame:
    """(row, starts, ends, items) of the documents that a block hits, by shard."""
    schema = struct_of(_HIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        for batch in batches:
            release()
            for blob in batch.column("shard"):
                found = Found()
                found.take(pickle.loads(blob.as_buffer()), phrases)
                rows = sorted(found.spans)
                columns = [
                    rows,
                    [[a for a, _ in found.spans[r]] for r in rows],
                    [[b for _, b in found.spans[r]] for r in rows],
                    [sorted(found.items[r]) for r in rows],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return shards.mapInArrow(run, schema)


def _many_blocks(rows: DataFrame, pieces: DataFrame, blocks: int, window: int) -> DataFrame:
    spark = rows.sparkSession
    indexed = saved(_indexed(rows, window), "fm-index")
    shards = indexed.filter(F.col("shard").isNotNull()).select("shard")
    path = fresh_path(spark, "fm-hits")
    for block in range(blocks):
        _search_block(shards, block_phrases(pieces, block, blocks, window)).write.mode("append").parquet(path)
    hits = spark.read.schema(struct_of(_HIT)).parquet(path)
    # A document's hits come from as many rows as blocks and shards that hit it.
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    together = hits.groupBy("row").agg(
        spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )

    def make():
        def work(batch: pa.RecordBatch) -> list:
            spans = [merged([(x["starts"], x["ends"]) for x in s or ()]) for s in batch.column("spans").to_pylist()]
            items = [sorted(x or ()) for x in batch.column("items").to_pylist()]
            starts, ends = ([[s[i] for s in x] for x in spans] for i in (0, 1))
            return [batch.column("id"), batch.column("n_words"), starts, ends, items]

        return work

    docs = indexed.filter(F.col("shard").isNull()).select("row", "id", "n_words")
    return map_batches(docs.join(saved(together, "fm-found"), "row", "left"), make, _FOUND)


def _contaminated(n_words: int, n_hit: int, share: int) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``items`` (sorted ids of the items found),
    ``starts`` and ``ends`` (removal spans in words) and ``contaminated``
    (some word is hit, and at least one word in ``share``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces, blocks = benchmark_pieces(_items(benchmark, item_col, item_text_col), window)
    if blocks == 1:
        found = _one_pass(rows, block_phrases(pieces, 0, 1, window), window)
    else:
        found = _many_blocks(rows, pieces, blocks, window)
    discard(pieces)
    hits = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        hits.alias("n_hit"),
        F.array_sort("items").alias("items"),
        "starts",
        "ends",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns kept."""
    pieces, blocks = benchmark_pieces(_items(benchmark, item_col, item_text_col), window)
    phrases = block_phrases(pieces, 0, 1, window) if blocks == 1 else None
    discard(pieces)
    if phrases is None:
        number = unused("row", docs.columns)
        numbered = saved(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        texts = numbered.select(F.col(number).alias("id"), F.col(text_col).cast("string").alias("text"))
        judged = decontaminate(texts, benchmark, "id", "text", item_col, item_text_col, window, share)
        gone = saved(judged.filter("contaminated").select(F.col("id").alias(number)), "contaminated")
        few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return numbered.join(F.broadcast(gone) if few else gone, number, "left_anti").select(*[numbered[c] for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, counts, found in by_shard(batches, text_col, phrases, window):
            hits = [sum(b - a for a, b in found.spans.get(i, ())) for i in range(len(counts))]
            clean = [not _contaminated(n, h, share) for n, h in zip(counts, hits)]
            at = 0
            for rows in held:
                yield rows.filter(pa.array(clean[at : at + rows.num_rows], pa.bool_()))
                at += rows.num_rows

    return docs.mapInArrow(run, docs.schema)
