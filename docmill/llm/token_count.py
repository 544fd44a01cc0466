"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is put through the merges on its own; those
that come out as one token are *whole tokens*.  The driver proves them once for a
file and ships the list to the tasks.  A pre-token that is a whole
token then counts as one without any merging, and only the rest is merged.
Since pre-tokens never influence one another, the sum is the exact number of
tokens the tokenizer gives.

Edge cases: a null or empty text has no tokens; special strings inside a text
count as one token each, as the tokenizer does by default; texts with code
points whose Unicode class differs between regular-expression libraries are cut
by the tokenizer's own pre-tokenizer, and its pieces take the same shortcut; repeated rows are counted one by
one; an empty table gives an empty result; columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, strings
from .bpe import SAFE_TEXT, byte_alphabet

#: Fixed value: the byte-level pre-token pattern of the public tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Merged pre-tokens that a worker remembers; beyond that it starts afresh.
REMEMBERED = 400_000

#: Longer pre-tokens are merged each time they occur.
LONGEST_REMEMBERED = 64


def prove_whole_tokens(tokenizer) -> frozenset[str]:
    """The texts that the tokenizer's merges turn into exactly one token.

    Vocabulary strings which aren't UTF-8 on their own cannot be a pre-token
    and are left out.
    """
    to_byte = {c: b for b, c in byte_alphabet().items()}
    found = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        tokens = tokenizer.model.tokenize(piece)
        if len(tokens) != 1:
            continue
        try:
            found.append(bytes(to_byte[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    return frozenset(found)


class _Costs(dict):
    """Tokens of a pre-token: one for whole tokens, else counted by merging."""

    def __init__(self, whole: frozenset[str], merge):
        super().__init__(dict.fromkeys(whole, 1))
        self._whole, self._merge = whole, merge
        self._most = len(whole) + REMEMBERED
        self._alphabet = {b: c for b, c in byte_alphabet().items()}

    def __missing__(self, word: str) -> int:
        mapped = word.encode().decode("latin-1").translate(self._alphabet)
        n = len(self._merge(mapped))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self._most:
                self.clear()
                self.update(dict.fromkeys(self._whole, 1))
            self[word] = n
        return n


class TokenCounter:
    """Counts tokens of whole texts for one byte-level BPE file and its whole
    tokens, which are proved here unless they are given."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self._special = (
            regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
            if special
            else None
        )
        self._find = regex.compile(PATTERN).findall
        proved = prove_whole_tokens(self._tokenizer) if whole is None else whole
        self._costs = _Costs(proved, self._tokenizer.model.tokenize)
        self._bytes = {ord(c): b for b, c in byte_alphabet().items()}

    def _plain(self, text: str) -> int:
        if SAFE_TEXT(text):
            return sum(map(self._costs.__getitem__, self._find(text)))
        pieces = self._tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return sum(self._costs[p.translate(self._bytes).encode("latin-1").decode()] for p, _ in pieces)

    def count(self, text: str) -> int:
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        parts = self._special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> tuple[str, ...]:
    """The whole tokens of a vocabulary file, sorted."""
    from tokenizers import Tokenizer

    return tuple(sorted(prove_whole_tokens(Tokenizer.from_file(path))))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str, whole: tuple[str, ...]) -> TokenCounter:
    """One counter for each worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = TokenCounter(path, frozenset(whole))
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame,
    vocab_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens).  No shuffle: one pass over the texts."""

    whole = whole_tokens(vocab_path)

    def make():
        count = counter(vocab_path, whole).count

        def work(batch: pa.RecordBatch) -> list:
            texts = strings(batch, "text")
            n = [count(t) for t in texts]
            return [
                batch.column("id"),
                [len(t.encode()) for t in texts],
                n,
                [k > limit for k in n],
            ]

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_batches(rows, make, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
