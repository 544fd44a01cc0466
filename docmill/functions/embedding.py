"""Embedders: functions from a list of texts to a list of vectors.

No model can be fetched here, so the default is a deterministic hashing
embedder; any function of the same shape can take its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..errors import EmbeddingError

_TOKENS = re.compile(r"\w+").findall

Embedder = Callable[[list[str]], list[list[float]]]


class _Places(dict):
    """Of each token twice its place in the vector, plus one where it counts
    negatively; remembered for a bounded number of tokens."""

    MOST = 200_000

    def __init__(self, dimensions: int):
        super().__init__()
        self._dimensions = dimensions

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
        # The first bit is the sign, the rest the place.
        place = (h & ((1 << 63) - 1)) % self._dimensions
        self[token] = code = 2 * place + (0 if h >> 63 else 1)
        return code


class HashingEmbedder:
    """Signed token counts by the tokens' md5, scaled to length one."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self._places = _Places(dimensions)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        codes: list[int] = []
        sizes = []
        for text in texts:
            before = len(codes)
            codes += map(self._places.__getitem__, _TOKENS(text.lower()))
            sizes.append(len(codes) - before)
        width = 2 * self.dimensions
        at = np.repeat(np.arange(len(texts)) * width, sizes) + np.array(codes, np.int64)
        counts = np.bincount(at, minlength=len(texts) * width).reshape(len(texts), self.dimensions, 2)
        out = (counts[:, :, 0] - counts[:, :, 1]).astype(float)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 0).tolist()


Factory = Callable[[], Embedder]

#: Factories by model name, and how often a name was registered.
_MODELS: dict[str, Factory] = {"hashing-64": HashingEmbedder}
_TIMES: dict[str, int] = {}

#: Models that this process has made.
_LOADED: dict[tuple[str, int], Embedder] = {}


def register(name: str, make: Factory) -> None:
    """Let ``make`` build the model ``name``; it is called once in each worker."""
    _MODELS[name] = make
    _TIMES[name] = _TIMES.get(name, 0) + 1


@dataclass(frozen=True)
class Model:
    """A model by name, with its factory: what a task gets to make it from.

    An unknown name has no factory; asking for its embedder raises, in the task,
    so that it becomes the message of the rows that wanted it."""

    name: str
    times: int
    make: Factory | None

    def embedder(self) -> Embedder:
        key = (self.name, self.times)
        if key not in _LOADED:
            if self.make is None:
                raise EmbeddingError(f"no embedder is registered as {self.name}")
            try:
                _LOADED[key] = self.make()
            except Exception as error:
                raise EmbeddingError(f"Failed to initialize embeddings: {error}") from error
        return _LOADED[key]


def model_of(name: str) -> Model:
    """To be called on the driver, where models are registered."""
    return Model(name, _TIMES.get(name, 0), _MODELS.get(name))


def embedder(name: str) -> Embedder:
    """The embedder itself, in this process."""
    return model_of(name).embedder()
