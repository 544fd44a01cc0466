"""Language identification by unigrams whose segmentation is marginalised out.

The pieces are those of a fixed public vocabulary of byte strings, all single
bytes among them.  A language is a probability for each piece.  A text is read
as units: runs of letters in lower case, a run of more than ``UNIT_LETTERS`` cut
after each so many, each unit with a space before it.  A unit's probability is
the sum over all ways to cut it into pieces, by the forward algorithm; a text's
the product over its units, and with the languages' shares as prior Bayes' rule
gives the posterior, which is the score.

Learning is expectation maximisation: expected piece counts by forward and
backward sums over the units of a sample, added up by Spark, then normalised with
``PRIOR_COUNT`` more for each piece.  The sample is bounded: of each language the
``SAMPLE_ROWS`` training rows with the smallest hash of their id.  The driver
sees sums only, one for each piece and language.  Scoring covers every unit of
every text; a worker remembers what it found for up to ``REMEMBERED`` units.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so
is every text if nothing was learned; training rows without id, language or
letter teach nothing; of rows with the same id and language one is learned from;
equal posteriors go to the language that sorts first; very long texts are read
in blocks of ``BLOCK_UNITS`` units; repeated rows are judged one by one; an empty
table gives an empty result; columns other than id, text and language are
ignored.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, release, strings
from .sample import smallest_hashes, training_text
from .storage import discard, saved

SAMPLE_ROWS = 2000
ITERATIONS = 3
PRIOR_COUNT = 0.01
UNIT_LETTERS = 32
REMEMBERED = 400_000
BLOCK_UNITS = 200_000

UNKNOWN = "und"

_UNITS = re.compile(rf"[^\W\d_]{{1,{UNIT_LETTERS}}}")

#: Characters of a text up to which its units are taken at once.
_SHORT = 1 << 20


def held_out(id_col: str) -> Column:
    """Whether a row may not be learned from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(training_text(id_col)) % 4 == 2


def units_of(text: str) -> Iterator[bytes]:
    return (b" " + m.group().encode() for m in _UNITS.finditer(text.lower()))


def _blocks(text: str) -> Iterator[list[str]]:
    """The units of a text, without the space, in blocks."""
    if len(text) <= _SHORT:
        if block := _UNITS.findall(text.lower()):
            yield block
        return
    found = (m.group() for m in _UNITS.finditer(text.lower()))
    while block := list(islice(found, BLOCK_UNITS)):
        yield block


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Pieces and their numbers, from a file of (base64 piece, rank) lines."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    missing = {bytes([b]) for b in range(256)} - set(pieces)
    return {p: i for i, p in enumerate(dict.fromkeys([*pieces, *sorted(missing)]))}


class Lattices:
    """All ways to cut units of one length into pieces."""

    def __init__(self, units: list[bytes], pieces: dict[bytes, int], longest: int):
        self.n, self.rows = len(units[0]), len(units)
        #: For each span that is a piece in some unit: its start and end, the
        #: units' rows and the pieces' numbers.
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        find = pieces.get
        for end in range(1, self.n + 1):
            for start in range(max(0, end - longest), end):
                ids = np.array([find(u[start:end], -1) for u in units])
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    self.edges.append((start, end, at, ids[at]))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all cuts up to each place (place, row,
        language), of pieces with the logarithms ``logs`` (piece, language)."""
        sums = np.full((self.n + 1, self.rows, logs.shape[1]), -np.inf)
        sums[0] = 0
        for start, end, at, ids in self.edges:
            sums[end, at] = np.logaddexp(sums[end, at], sums[start, at] + logs[ids])
        return sums

    def expected(self, logs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected number of times that each piece is used, of units that occur
        ``weights`` times, in one language with the logarithms ``logs``."""
        before = self.forward(logs[:, None])[:, :, 0]
        after = np.full((self.n + 1, self.rows), -np.inf)
        after[self.n] = 0
        for start, end, at, ids in reversed(self.edges):
            after[start, at] = np.logaddexp(after[start, at], after[end, at] + logs[ids])
        counts = np.zeros(len(logs))
        for start, end, at, ids in self.edges:
            share = np.exp(before[start, at] + logs[ids] + after[end, at] - before[self.n, at])
            counts += np.bincount(ids, share * weights[at], len(logs))
        return counts


class PieceTable:
    """Piece numbers of many byte strings at once, by 64-bit hashes that roll over
    a unit: a table of slots, and further ones for pieces whose slot was taken."""

    _FACTOR = 0x9E3779B97F4A7C15
    _BITS = 20

    def __init__(self, pieces: dict[bytes, int]):
        self.longest = max(map(len, pieces))
        self.lengths = sorted({len(p) for p in pieces})
        self._sizes = np.array([len(p) for p in pieces], float)
        self.hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self._powers = np.array([pow(self._FACTOR, k, 2**64) for k in range(self.longest + 1)], np.uint64)
        self._tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(pieces), dtype=np.int32)
        while len(left):
            spread = np.uint64(pow(0xBF58476D1CE4E5B9, 2 * len(self._tables) + 1, 2**64))
            slots = self._slots(self.hashes[left], spread)
            table = np.full(1 << self._BITS, -1, np.int32)
            table[slots] = left
            self._tables.append((spread, table))
            left = left[table[slots] != left]

    def _hash(self, piece: bytes) -> int:
        h = 0
        for byte in piece:
            h = (h * self._FACTOR + byte + 1) % 2**64
        return h

    def _slots(self, hashes: np.ndarray, spread: np.uint64) -> np.ndarray:
        return (hashes * spread) >> np.uint64(64 - self._BITS)

    def rolled(self, units: list[bytes], width: int) -> np.ndarray:
        """The hashes of all beginnings (place, row) of units of at most ``width`` bytes."""
        rows = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(len(units), width)
        out = np.zeros((width + 1, len(units)), np.uint64)
        for k in range(width):
            out[k + 1] = out[k] * np.uint64(self._FACTOR) + rows[:, k] + np.uint64(1)
        return out

    def find(self, rolled: np.ndarray, start: int, end: int) -> np.ndarray:
        """For each row the number of the piece from ``start`` to ``end``, or -1."""
        hashes = rolled[end] - rolled[start] * self._powers[end - start]
        out = np.full(len(hashes), -1, np.int32)
        for spread, table in self._tables:
            found = table[self._slots(hashes, spread)]
            hit = (self.hashes[found] == hashes) & (found >= 0)
            out[hit] = found[hit]
        return out

    def scaled(self, logs: np.ndarray) -> np.ndarray:
        """Probabilities times ``exp(SCALE)`` for each byte of a piece."""
        return np.exp(logs + SCALE * self._sizes[:, None])


#: By how much the sums are scaled up for each byte, so that those of long units
#: don't vanish; where they do, they are taken again in logarithms.
SCALE = 4.0

#: Units up to these many bytes are worked on together.
WIDTHS = [6, 8, 10, 12, 15, 19, 25, 34]


def unit_sums(units: list[bytes], pieces: dict[bytes, int], table: PieceTable, scaled: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all cuts of each unit (unit, language)."""
    sizes = np.array([len(u) for u in units])
    out = np.empty((len(units), logs.shape[1]))
    low = 0
    while low < sizes.max():
        width = next((w for w in WIDTHS if w > low), 0) or int(sizes[sizes > low].min())
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        if not len(rows):
            continue
        rolled = table.rolled([units[i] for i in rows], width)
        sums = np.zeros((width + 1, len(rows), logs.shape[1]))
        sums[0] = 1
        for end in range(1, width + 1):
            for size in table.lengths:
                if size > end:
                    break
                ids = table.find(rolled, end - size, end)
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    sums[end, at] += sums[end - size, at] * scaled[ids[at]]
        whole = sums[sizes[rows], np.arange(len(rows))]
        with np.errstate(divide="ignore"):
            out[rows] = np.log(whole) - SCALE * sizes[rows, None]
    lost = np.flatnonzero(~np.isfinite(out).all(1))
    for places in by_length([units[i] for i in lost]):
        at = lost[places]
        out[at] = Lattices([units[i] for i in at], pieces, table.longest).forward(logs)[-1]
    return out


def by_length(units: list[bytes]) -> list[list[int]]:
    places = defaultdict(list)
    for i, unit in enumerate(units):
        places[len(unit)].append(i)
    return list(places.values())


@dataclass
class LanguageModel:
    """Languages in their order, the logarithms of their shares, and of the
    pieces' probabilities in each (piece, language)."""

    languages: list[str]
    shares: np.ndarray
    logs: np.ndarray
    vocabulary: str

    def scorer(self) -> Callable[[list[str]], list[tuple[str, float]]]:
        pieces = read_vocabulary(self.vocabulary)
        table, logs = PieceTable(pieces), self.logs.astype(float)
        scaled = table.scaled(logs)
        known: dict[str, int] = {}
        found = np.empty((1024, len(self.languages)))

        def learn(new: list[str]) -> None:
            nonlocal found
            at = len(known)
            if at + len(new) > len(found):
                found = np.concatenate([found, np.empty((max(len(found), len(new)), found.shape[1]))])
            found[at : at + len(new)] = unit_sums([b" " + w.encode() for w in new], pieces, table, scaled, logs)
            known.update(zip(new, range(at, at + len(new))))

        def text_sums(units: list[str], sizes: list[int]) -> np.ndarray:
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set(units) - known.keys())
            if new:
                learn(new)
            rows = found[np.fromiter(map(known.__getitem__, units), np.int64, len(units))]
            return np.add.reduceat(rows, np.cumsum([0, *sizes[:-1]]), axis=0)

        def score(texts: list[str]) -> list[tuple[str, float]]:
            if not self.languages:
                return [(UNKNOWN, 0.0)] * len(texts)
            total = np.zeros((len(texts), len(self.languages)))
            letters = np.zeros(len(texts), bool)
            units: list[str] = []
            sizes: list[int] = []
            owners: list[int] = []

            def flush() -> None:
                if units:
                    np.add.at(total, owners, text_sums(units, sizes))
                    units.clear(), sizes.clear(), owners.clear()

            for i, text in enumerate(texts):
                for block in _blocks(text):
                    letters[i] = True
                    units.extend(block)
                    sizes.append(len(block))
                    owners.append(i)
                    if len(units) >= BLOCK_UNITS:
                        flush()
            flush()
            total += self.shares
            best = total.argmax(1)
            weights = np.exp(total - total.max(1, keepdims=True))
            posterior = 1 / weights.sum(1)
            return [(self.languages[b], float(p)) if ok else (UNKNOWN, 0.0) for b, p, ok in zip(best, posterior, letters)]

        return score


def _unit_counts(sample: DataFrame) -> DataFrame:
    """(lang, unit, n): how often each unit occurs in the sample."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            counts: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch, "text")):
                counts.update((lang, unit) for unit in units_of(text))
            return [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]

        return work

    parts = map_batches(sample, make, "lang string, unit binary, n long", rows_at_once=256)
    return parts.groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def _expected_counts(units: DataFrame, languages: list[str], logs: np.ndarray, vocabulary: str) -> np.ndarray:
    """One step's expected counts (piece, language)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = read_vocabulary(vocabulary)
        longest = max(map(len, pieces))
        totals = np.zeros(logs.shape)
        for batch in batches:
            release()
            langs = np.array([languages.index(x) for x in batch.column("lang").to_pylist()], int)
            all_units = batch.column("unit").to_pylist()
            weights = np.array(batch.column("n").to_pylist(), float)
            for lang in set(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                for places in by_length([all_units[i] for i in own]):
                    at = own[places]
                    lattices = Lattices([all_units[i] for i in at], pieces, longest)
                    totals[:, lang] += lattices.expected(logs[:, lang], weights[at])
        piece, lang = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece), pa.array(lang), pa.array(totals[piece, lang])], names=["piece", "lang", "count"]
        )

    sums = units.mapInArrow(work, "piece long, lang long, count double").groupBy("piece", "lang").agg(F.sum("count").alias("count"))
    found = sums.toArrow()  # at most a row for each piece and language
    out = np.zeros(logs.shape)
    out[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["count"].to_numpy()
    return out


def train(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """Learn from the bounded sample of training rows."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    ).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    chosen, pairs = smallest_hashes(rows, "lang", SAMPLE_ROWS)
    # SAMPLE_ROWS ids of each language are broadcast.
    sample = rows.join(F.broadcast(chosen.drop("h")), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    units = saved(_unit_counts(sample), "language-units")
    learned = [r["lang"] for r in units.select("lang").distinct().collect()]
    counts = {r["lang"]: r["count"] for r in pairs.groupBy("lang").count().collect()}
    languages = sorted(learned)
    shares = np.array([counts[x] for x in languages], float)
    size = len(read_vocabulary(vocabulary))
    logs = np.full((size, len(languages)), -np.log(size))
    for _ in range(ITERATIONS if languages else 0):
        counts_now = _expected_counts(units, languages, logs, vocabulary) + PRIOR_COUNT
        logs = np.log(counts_now / counts_now.sum(0))
    discard(units, pairs)
    return LanguageModel(languages, np.log(shares / max(shares.sum(), 1)), logs.astype(np.float32), vocabulary)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred`` and ``score``, its posterior
    probability.  No shuffle."""

    def make():
        score = model.scorer()

        def work(batch: pa.RecordBatch) -> list:
            found = score(strings(batch, "text"))
            return [batch.column("id"), [x for x, _ in found], [p for _, p in found]]

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(rows, make, "id long, lang_pred string, score double", rows_at_once=2048)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
