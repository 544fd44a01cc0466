"""Alternative chunkers: recursive by header level, by token budget, and the
statistical one, whose threshold is searched for in each document."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import row_function
from ..functions.embedding import Embedder, model_of
from ..functions.retry import retrying
from .headers import sections
from .semantic import breakpoints


def _rewritten(section: dict) -> dict:
    """A section as its header trail, then its text without header lines."""
    trail = "".join(f"{'#' * int(k[-1])} {v}\n" for k, v in section["headers"].items())
    body = re.sub(r"^#+\s.*$", "", section["content"], flags=re.MULTILINE).strip()
    return {"content": trail + body, "headers": section["headers"]}


def recursive_sections(text: str, max_size: int = 1000, level: int = 1, max_level: int = 6) -> list[dict]:
    """Split at the levels up to ``level``; a piece of more than ``max_size``
    characters is split again one level deeper, ``max_level`` deep at most."""
    out = []
    for section in sections(text, level):
        if len(section["content"]) > max_size and level < max_level:
            out += [_rewritten(s) for s in recursive_sections(section["content"], max_size, level + 1, max_level)]
        else:
            out.append(_rewritten(section))
    return out


def budget_pieces(
    text: str, embed: Embedder, least: int = 200, most: int = 2000, percentile: float = 95.0
) -> list[str]:
    """Sentences grouped at breakpoints, with ``least`` to ``most`` words in a
    piece where sentences allow it; NUL characters are taken out of each piece."""
    sentences = re.split(r"(?<=[.?!])\s+", text)
    cuts = set(breakpoints(embed(sentences), percentile)) if len(sentences) > 1 else set()
    pieces: list[list[str]] = [[]]
    size = 0
    for i, sentence in enumerate(sentences):
        words = len(sentence.split())
        if size and (size + words > most or (size >= least and i - 1 in cuts)):
            pieces.append([])
            size = 0
        pieces[-1].append(sentence)
        size += words
    return [" ".join(p).replace("\0", "") for p in pieces if p]


def context_similarities(vectors: list[list[float]], window: int = 2) -> np.ndarray:
    """Of each vector from the second on the cosine with the mean of the
    ``window`` vectors before it (as many as there are), rounded so that equal ones
    stay equal; 0 where either has no length."""
    v = np.asarray(vectors, float)
    sums = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)])
    at = np.arange(1, len(v))
    before = np.maximum(at - window, 0)
    context = (sums[at] - sums[before]) / (at - before)[:, None]
    product = np.linalg.norm(context, axis=1) * np.linalg.norm(v[1:], axis=1)
    cosine = np.divide((context * v[1:]).sum(1), product, out=np.zeros(len(product)), where=product > 1e-9)
    return np.round(cosine, 9)


def search_threshold(
    similarity: np.ndarray, tokens: list[int], least: int = 200, most: int = 2000, slack: int = 10, step: float = 0.01
) -> float:
    """The threshold under which a similarity splits, found by bisection within
    one standard deviation of the median similarity: too small splits (by their
    median) lower it, too large ones raise it, until the median lies between
    ``least`` and ``most`` tokens, give or take ``slack``, or the range is used up.
    Where even the upper bound is negative, no threshold is tried and nothing splits:
    it is minus infinity."""
    middle, spread = round(float(np.median(similarity)), 9), round(float(np.std(similarity)), 9)
    low, high = max(0.0, middle - spread), min(1.0, middle + spread)
    total = np.concatenate([[0], np.cumsum(tokens)])
    threshold = float("-inf")
    while low <= high:
        threshold = (low + high) / 2
        ends = np.concatenate([[0], np.flatnonzero(similarity < threshold) + 1, [len(tokens)]])
        median = float(np.median(np.diff(total[ends])))
        if least - slack <= median <= most + slack:
            break
        if median < least:
            high = threshold - step
        else:
            low = threshold + step
    return threshold


def statistical_pieces(
    text: str, embed: Embedder, least: int = 200, most: int = 2000, window: int = 2
) -> list[str]:
    """Sentences, with the whitespace after them, grouped where their similarity
    to the ``window`` sentences before falls under the document's own threshold.

    A split is made only if the piece then has ``least`` words and fewer than
    ``most``; a piece that the next sentence would take beyond ``most`` ends before
    it, if it has ``least``.  Pieces put together are the text, but for NUL
    characters, which are taken out of each piece."""
    cuts = [m.end() for m in re.finditer(r"(?<=[.?!])\s+", text)]
    sentences = [text[a:b] for a, b in pairwise([0, *cuts, len(text)]) if a < b]
    tokens = [len(s.split()) for s in sentences]
    ends: set[int] = set()
    if len(sentences) > 1:
        similarity = context_similarities(embed(sentences), window)
        ends = set(np.flatnonzero(similarity < search_threshold(similarity, tokens, least, most)).tolist())
    pieces: list[list[str]] = [[]]
    size = 0
    for i, sentence in enumerate(sentences):
        after = size + tokens[i]
        splits = i in ends and least <= after < most
        if not splits and after > most and size >= least:
            pieces.append([])
            after = tokens[i]
        pieces[-1].append(sentence)
        size = after
        if splits:
            pieces.append([])
            size = 0
    return ["".join(p).replace("\0", "") for p in pieces if p]


def chunk_text(text: Column | str, method: str = "semantic", model: str = "hashing-64", attempts: int = 3) -> Column:
    """Pieces of a text by "semantic" (statistical), "markdown" or "budget"; a
    text that fails is tried up to ``attempts`` times."""
    known = model_of(model)
    if method == "semantic":
        work = lambda t: statistical_pieces(t, known.embedder())
    elif method == "budget":
        work = lambda t: budget_pieces(t, known.embedder())
    elif method == "markdown":
        work = lambda t: [s["content"] for s in recursive_sections(t)]
    else:
        raise ValueError("Invalid method for chunking")

    run = row_function(lambda t: retrying(lambda: work(t), attempts), T.ArrayType(T.StringType()))
    return run(F.col(text) if isinstance(text, str) else text)
