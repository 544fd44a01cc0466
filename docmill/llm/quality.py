"""Quality by compression: two zstandard dictionaries, one built from good and
one from bad labelled texts.

A text is cut into blocks of ``BLOCK_BYTES`` bytes, so that the dictionary tells
on all of it and not on its beginning only, and every block is compressed with
either dictionary.  The difference of the two sizes, summed over the blocks and
normalised by the text's length, says which class the text resembles; a logistic
calibration with that one feature and an intercept turns it into a score.

The labelled sample is cut in two halves.  Each half builds a pair of
dictionaries whose calibration is fitted on the other half, so on texts that
these dictionaries don't hold; a score is made of the mean of both log odds.

The sample is bounded: per class the ``SAMPLE_ROWS`` labelled training ids
with the smallest hashes, their texts of at most ``SAMPLE_BYTES`` each.  Labels
are learned from training rows alone; scores are functions of the text.

Edge cases: a null text scores as the empty text; where the sample lacks a
class the score is the smoothed share of good labels; labels without an id or a
value are left out; a null id counts as the empty string for the split;
repeated rows are scored one by one; an empty table gives an empty result;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, release, utf8
from .sample import smallest_hashes, training_text
from .storage import discard

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 32_768

#: Of the sample, this many rows of each class at most build a dictionary.
DICTIONARY_ROWS = 1000

#: Picked by two-fold cross-validation inside the training rows of one table.
DICTIONARY_BYTES = 64_000
BLOCK_BYTES = 512
LEVEL = 3

#: Weight of the penalty on the slope, for each row.
RIDGE = 1e-3


def held_out(id_col: str) -> Column:
    """Whether a row may not be learned from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(training_text(id_col)) % 3 == 1


@dataclass
class QualityModel:
    """Pairs of dictionaries (good, bad), each with its calibration (intercept,
    slope); plain values, so it pickles.  Without any, scores are ``share``."""

    share: float
    parts: list[tuple[bytes, bytes, float, float]]

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        pairs = [compressors(good, bad) for good, bad, _, _ in self.parts]

        def score(texts: list[bytes]) -> np.ndarray:
            if not pairs:
                return np.full(len(texts), self.share)
            odds = [a + b * size_differences(texts, p) for p, (_, _, a, b) in zip(pairs, self.parts)]
            return 1 / (1 + np.exp(-np.clip(np.mean(odds, axis=0), -30, 30)))

        return score


def compressors(good: bytes, bad: bytes) -> list:
    import zstandard as zs

    return [
        zs.ZstdCompressor(
            level=LEVEL,
            dict_data=zs.ZstdCompressionDict(d),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        for d in (good, bad)
    ]


def size_differences(texts: list[bytes], pair: list) -> np.ndarray:
    """Bytes that the bad dictionary needs more than the good one, for each
    byte of the text (a few bytes are added, so that tiny texts stay near 0)."""
    good, bad = (c.compress for c in pair)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        blocks = [text[at : at + BLOCK_BYTES] for at in range(0, len(text), BLOCK_BYTES)]
        out[i] = sum(len(bad(b)) - len(good(b)) for b in blocks) / (len(text) + 16)
    return out


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the texts' blocks, or the texts' own end where
    they are too few."""
    import zstandard as zs

    texts = texts[:DICTIONARY_ROWS]
    blocks = [t[at : at + BLOCK_BYTES] for t in texts for at in range(0, len(t), BLOCK_BYTES)]
    try:
        return zs.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zs.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of a logistic regression on one standardised feature.

    The penalised loss is strictly convex in the slope, and each Newton step is
    halved until it lowers the loss enough, so the fit can't run away."""
    mean, scale = x.mean(), x.std() or 1.0
    z = np.stack([np.ones(len(x)), (x - mean) / scale], axis=1)
    ridge = np.diag([1e-9, RIDGE]) * len(y)
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * w @ ridge @ w
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (p - y) + ridge @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, slope)
        now, gain, part = loss(w), slope @ step, 1.0
        if gain <= 1e-12 * len(y):
            break
        while loss(w - part * step) > now - 1e-4 * part * gain and part > 1e-9:
            part /= 2
        w = w - part * step
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


def fit(rows: list[tuple[bytes, int]]) -> QualityModel:
    """Build the dictionaries and the calibrations from labelled texts; of equal
    texts with the same label one counts, lest a copy stands in both halves."""
    rows = list(dict.fromkeys(rows))
    classes = [[t for t, q in rows if q == 1], [t for t, q in rows if q != 1]]
    model = QualityModel((len(classes[0]) + 1) / (len(rows) + 2), [])
    if min(map(len, classes)) < 4:
        return model
    for half in (0, 1):
        pair = [_dictionary(c[1 - half :: 2]) for c in classes]
        seen = [c[half::2] for c in classes]
        x = size_differences(seen[0] + seen[1], compressors(*pair))
        y = np.repeat([1.0, 0.0], list(map(len, seen)))
        model.parts.append((*pair, *calibrate(x, y)))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on the bounded sample of labelled training rows; labels that are
    repeated count once."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.filter(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("id"))
    chosen, pairs = smallest_hashes(marked, "quality", SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # At most 2 x SAMPLE_ROWS ids and labels are broadcast.
    sample = (
        texts.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
        .join(F.broadcast(chosen.drop("h")), "id")
        .groupBy("id", "quality")  # of rows with the same id, one
        .agg(F.min("text").alias("text"), F.xxhash64("id").alias("h"))
        .toArrow()
        .to_pylist()
    )
    discard(pairs)
    sample.sort(key=lambda r: (r["h"], r["id"], r["quality"]))
    return fit([((r["text"] or "").encode(), r["quality"]) for r in sample])


def quality_scores(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    No shuffle: each text is compressed where it lies, by every dictionary."""

    def make():
        score = model.scorer()

        def work(batch: pa.RecordBatch) -> list:
            return [batch.column("id"), score(utf8(batch, "text")).tolist()]

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(rows, make, "id long, score double")
    return out.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, all columns kept."""
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            release()
            if batch.num_rows:
                good = score(utf8(batch, text_col)) >= least
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(work, schema)
