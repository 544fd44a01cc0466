"""Semantic breakpoints within oversized chunks; see ``breaks`` for stored vectors."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import row_function
from ..functions.embedding import Embedder, model_of


def breakpoints(vectors: list[list[float]], percentile: float = 95.0) -> list[int]:
    """Positions after which neighbouring vectors are farther apart than the
    percentile of all such distances (linear interpolation, strictly more).
    Both are rounded before they are compared, so that equal distances stay equal."""
    v = np.asarray(vectors, float)
    sizes = np.linalg.norm(v, axis=1)
    product = sizes[:-1] * sizes[1:]
    cosine = np.divide((v[:-1] * v[1:]).sum(1), product, out=np.zeros(len(product)), where=product > 0)
    distance = np.round(1 - cosine, 9)
    return np.flatnonzero(distance > np.round(np.percentile(distance, percentile), 9)).tolist() if len(distance) else []


def semantic_pieces(text: str, embed: Embedder, percentile: float = 95.0) -> list[str]:
    """Sentences grouped between breakpoints of their three-sentence windows."""
    sentences = re.split(r"(?<=[.?!])\s+", text)
    if len(sentences) == 1:
        return [text]
    windows = [" ".join(sentences[max(0, i - 1) : i + 2]) for i in range(len(sentences))]
    pieces, start = [], 0
    for at in breakpoints(embed(windows), percentile):
        pieces.append(" ".join(sentences[start : at + 1]))
        start = at + 1
    pieces.append(" ".join(sentences[start:]))
    return [p for p in pieces if p]


def split_oversized(chunks: Column | str, max_size: int, model: str = "hashing-64") -> Column:
    """Normal chunks in order, then the pieces of chunks of more than
    ``max_size`` characters.  A chunk that gives one piece, or fails, stays as it
    is and unflagged.  All texts of a row are sent to Python at once."""
    array = F.col(chunks) if isinstance(chunks, str) else chunks
    known = model_of(model)
    big = lambda c: F.length(c["content"]) > max_size

    def run(texts: list[str]) -> list[list[str] | None]:
        out = []
        for text in texts:
            try:
                out.append(semantic_pieces(text, known.embedder()))
            except Exception:  # noqa: BLE001  a failed split keeps the chunk
                out.append(None)
        return out

    oversized = F.filter(array, big)
    texts = F.transform(oversized, lambda c: c["content"])
    split = row_function(run, T.ArrayType(T.ArrayType(T.StringType()))).asNondeterministic()
    pieces = F.when(F.size(oversized) > 0, split(texts)).otherwise(F.array().cast("array<array<string>>"))

    def expand(pair: Column) -> Column:
        chunk, found = pair["chunk"], pair["pieces"]
        split = F.transform(
            found,
            lambda p: F.struct(
                p.alias("content"),
                chunk["headers"].alias("headers"),
                F.lit(True).alias("is_semantic_split"),
                F.lit(None).cast("boolean").alias("is_combined"),
            ),
        )
        return F.when(F.size(found) > 1, split).otherwise(F.array(chunk))

    paired = F.zip_with(oversized, pieces, lambda c, p: F.struct(c.alias("chunk"), p.alias("pieces")))
    return F.concat(F.filter(array, lambda c: ~big(c)), F.flatten(F.transform(paired, expand)))
