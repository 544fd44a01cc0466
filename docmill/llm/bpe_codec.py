"""BPE encoding and decoding by speculation and verification.

For each distinct word a greedy longest match over the vocabulary *proposes*
tokens.  A sequence of tokens is what the merges give if and only if each
token's own symbols merge to that token and each adjacent pair of tokens,
merged from its symbols, comes out as that pair again.  The first condition is
proved once for the vocabulary; the second is *verified* for all proposed
pairs of a block of words at once, against a sorted table of pairs whose
answers are known.  Only words with a pair that fails are merged exactly.

Edge cases: a null or empty text has no tokens and decodes to the empty text;
special strings inside a text become their own token; words of any length are
encoded whole; repeated rows are encoded one by one; an empty table gives an
empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, strings
from .bpe import SAFE_TEXT, byte_alphabet

#: Fixed value: the word pattern of the public word-level vocabulary file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words and pairs that a worker remembers; beyond that it starts afresh.
REMEMBERED_WORDS = 400_000
REMEMBERED_PAIRS = 2_000_000

#: Longer words are encoded each time they occur.
LONGEST_REMEMBERED = 64

#: Characters of text whose words are looked up together.
BLOCK_CHARS = 250_000

_PAIR = 1 << 20  # tokens are numbered below this
_NEVER = 1 << 60  # the rank of a pair that doesn't merge


class BpeCodec:
    """Encoder and decoder for one vocabulary file with word-end merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._end = model["end_of_word_suffix"] or ""
        self._vocab: dict[str, int] = model["vocab"]
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (self._vocab | self._special).items()}
        self.token_of = [names.get(i, "") for i in range(max(names) + 1)]
        # pair of ids -> rank, and rank -> merged id
        pairs = [(self._vocab[a], self._vocab[b]) for a, b in model["merges"]]
        self._rank = {a * _PAIR + b: r for r, (a, b) in enumerate(pairs)}
        self._merged = [self._vocab[a + b] for a, b in model["merges"]]
        self._library = Tokenizer.from_file(path)
        self._split_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))) + ")").split
            if self._special
            else None
        )
        self._find = regex.compile(WORDS).findall
        self._alphabet = byte_alphabet()
        self._prove()
        self._pairs = np.empty(0, np.int64)
        self._pair_ok = np.empty(0, bool)
        self._ids: dict[str, bytes] = {}
        self.exact_words = self.proposed_words = 0

    # -- vocabulary ---------------------------------------------------------

    def _symbols(self, token: str) -> list[int] | None:
        """The ids of the symbols that merging a token starts from."""
        ended = bool(self._end) and token.endswith(self._end) and token != self._end
        body = token[: len(token) - len(self._end)] if ended else token
        pieces = list(body)
        if ended:
            pieces[-1] += self._end
        try:
            return [self._vocab[p] for p in pieces]
        except KeyError:
            return None

    def _prove(self) -> None:
        """Keep for proposals the tokens that their own symbols merge to."""
        self._parts, self._inner, self._last = {}, {}, {}
        self._reach = {}  # the longest token that begins with two (or one) characters
        for token, i in self._vocab.items():
            symbols = self._symbols(token)
            if symbols is None or self.merge(symbols) != [i]:
                continue
            self._parts[i] = symbols
            if self._end and token.endswith(self._end) and token != self._end:
                body = token[: len(token) - len(self._end)]
                self._last[body] = i
            else:
                body = token
                self._inner[body] = i
            for opening in (body[:2], body[:1]):
                self._reach[opening] = max(self._reach.get(opening, 1), len(body))
        if not self._end:
            self._last = self._inner

    # -- exact merging ------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """The merges themselves: lowest rank first, leftmost among equals."""
        if len(ids) > 40:
            return self._merge_long(ids)
        ids, rank, merged = list(ids), self._rank.get, self._merged
        ranks = [rank(a * _PAIR + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [merged[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] * _PAIR + ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank(ids[i - 1] * _PAIR + ids[i], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self._rank.get(ids[i] * _PAIR + ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self._merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]

    # -- speculation and verification ---------------------------------------

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None where it comes to no token."""
        inner, last, reach = self._inner.get, self._last.get, self._reach.get
        out, at, n = [], 0, len(word)
        while at < n:
            most = reach(word[at : at + 2], 1)
            end = at + most
            if end >= n:
                token = last(word[at:])
                if token is not None:
                    out.append(token)
                    return out
                end = n - 1
            while end > at:
                token = inner(word[at:end])
                if token is not None:
                    break
                end -= 1
            else:
                return None
            out.append(token)
            at = end
        return None

    def _pair_holds(self, key: int) -> bool:
        a, b = divmod(key, _PAIR)
        return self.merge(self._parts[a] + self._parts[b]) == [a, b]

    def verify(self, proposals: list[list[int]]) -> np.ndarray:
        """For each proposal, whether all its adjacent pairs hold."""
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((i for p in proposals for i in p), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        keys = flat[:-1] * _PAIR + flat[1:]
        within = np.ones(len(flat), bool)
        within[starts] = False
        distinct, back = np.unique(keys[within[1:]], return_inverse=True)
        at = np.searchsorted(self._pairs, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self._pairs)
        known[inside] = self._pairs[at[inside]] == distinct[inside]
        ok = np.empty(len(distinct), bool)
        ok[known] = self._pair_ok[at[known]]
        new = distinct[~known]
        ok[~known] = [self._pair_holds(int(k)) for k in new]
        if len(self._pairs) + len(new) > REMEMBERED_PAIRS:
            self._pairs, self._pair_ok = distinct, ok.copy()
        elif len(new):
            self._pairs = np.concatenate([self._pairs, new])
            order = np.argsort(self._pairs)
            self._pairs = self._pairs[order]
            self._pair_ok = np.concatenate([self._pair_ok, ok[~known]])[order]
        holds = np.ones(len(flat), bool)
        holds[within] = ok[back]
        return np.logical_and.reduceat(holds, starts) if len(starts) else np.empty(0, bool)

    def _learn(self, words: list[str]) -> None:
        """Encode distinct words and remember their ids and decoded text."""
        mapped = [w.encode().decode("latin-1").translate(self._alphabet) for w in words]
        proposals = [self.propose(m) for m in mapped]
        some = [i for i, p in enumerate(proposals) if p is not None]
        good = self.verify([proposals[i] for i in some])
        failed = {i for i, p in enumerate(proposals) if p is None}
        failed.update(i for i, ok in zip(some, good.tolist()) if not ok)
        self.proposed_words += len(words)
        self.exact_words += len(failed)
        pack = [struct.Struct(f"<{n}I").pack for n in range(65)]
        for i, word in enumerate(words):
            if i in failed:
                m = mapped[i]
                ids = self.merge([self._vocab[c] for c in m[:-1]] + [self._vocab[m[-1] + self._end]])
            else:
                ids = proposals[i]
            self._ids[word] = pack[len(ids)](*ids) if len(ids) < 65 else np.array(ids, "<u4").tobytes()

    # -- whole texts --------------------------------------------------------

    def _words(self, text: str) -> list[str]:
        if SAFE_TEXT(text) and "Σ" not in text:
            return self._find((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        plain = self._library.normalizer.normalize_str(text)
        back = {c: b for b, c in self._alphabet.items()}
        return [
            bytes(back[c] for c in piece).decode()
            for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)
        ]

    def _pieces(self, text: str) -> list[str]:
        """Words, with special strings standing for themselves."""
        if self._split_special is None or not any(s in text for s in self._special):
            return self._words(text)
        out = []
        for part in self._split_special(text):
            if part in self._special:
                out.append(part)
            elif part:
                out.extend(self._words(part))
        return out

    def encode_block(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids (packed, little-endian, 32 bits) and decoded text of each text."""
        pieces = [self._pieces(t) for t in texts]
        if len(self._ids) > REMEMBERED_WORDS:
            self._ids.clear()
        for token, i in self._special.items():
            self._ids[token] = np.array([i], "<u4").tobytes()
        new = set().union(*pieces).difference(self._ids)
        if new:
            self._learn(list(new))
        ids = self._ids.__getitem__
        packed = [b"".join(map(ids, p)) for p in pieces]
        for word in new:
            if len(word) > LONGEST_REMEMBERED:
                del self._ids[word]
        return [(p, self.decode(np.frombuffer(p, "<u4").tolist())) for p in packed]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_block([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: these files name no decoder."""
        return " ".join(map(self.token_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec for each worker process and vocabulary file."""
    return BpeCodec(path)


def bpe_round_trip(
    docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit
    integers) and ``decoded``, the text that the ids decode to.

    No shuffle: one pass over the texts, block by block."""

    def make():
        encode = codec(vocab_path).encode_block

        def work(batch: pa.RecordBatch) -> list:
            texts = strings(batch, "text")
            pairs, block, size = [], [], 0
            for t in texts:
                block.append(t)
                size += len(t)
                if size >= BLOCK_CHARS:
                    pairs += encode(block)
                    block, size = [], 0
            pairs += encode(block)
            return [
                batch.column("id"),
                [len(i) // 4 for i, _ in pairs],
                [i for i, _ in pairs],
                [d for _, d in pairs],
            ]

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_batches(rows, make, "id long, n_tokens long, ids binary, decoded string", rows_at_once=256)
    return out.withColumnRenamed("id", id_col)
