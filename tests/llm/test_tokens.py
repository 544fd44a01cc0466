import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from helpers import TEXTS, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docmill.llm.bpe_codec import BpeCodec, bpe_round_trip
from docmill.llm.token_count import TokenCounter, prove_whole_tokens, token_counts

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")

PIECES = [
    "a", "B", " ", "  ", "\n", "\t", "1", "22", "'s", "'re", "!", "é", "e\u0301", "ß", "中", "ก", "\U0001f600", "\x1c", "\x85", "\xa0",
    "<|endoftext|>", "<|startoftext|>", "<|end", "the", " and", "ng", "Σ", "ΑΣ", "İ", "K", "ͅ", "Ᲊ", "aaaa", "hahaha", "-----", "ing", "ՙ",
]


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(7)
    mixed = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(25))) for _ in range(3000)]
    letters = ["".join(rng.choice("abcdetionrs") for _ in range(n)) for n in (1, 39, 40, 41, 42, 300, 3000)]
    return mixed + letters + ["a" * 1000, "ab" * 700]


def test_counts_match_the_library(samples):
    counter, library = TokenCounter(BYTES), Tokenizer.from_file(BYTES)
    for text in samples:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_whole_tokens_are_proved():
    library = Tokenizer.from_file(BYTES)
    whole = prove_whole_tokens(library)
    assert len(whole) > 40_000
    for piece in random.Random(1).sample(sorted(whole), 2000):
        assert len(library.model.tokenize(library.pre_tokenizer.pre_tokenize_str(piece)[0][0])) >= 1


def test_count_edge_cases(spark):
    library = Tokenizer.from_file(BYTES)
    got = token_counts(documents(spark), BYTES).collect()
    want = []
    for i, t, _ in TEXTS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts(documents(spark).limit(0), BYTES).count() == 0


def test_encoding_and_decoding_match_the_library(samples):
    codec, library = BpeCodec(WORDS), Tokenizer.from_file(WORDS)
    for at in range(0, len(samples), 100):
        block = samples[at : at + 100]
        for text, (ids, decoded) in zip(block, codec.encode_block(block)):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
            assert decoded == library.decode(want, skip_special_tokens=False)
    assert 0 < codec.exact_words < codec.proposed_words


def test_both_ways_of_merging_agree():
    codec = BpeCodec(WORDS)
    rng = random.Random(2)
    for _ in range(300):
        ids = [codec._vocab[rng.choice("abcdeinorst")] for _ in range(rng.randrange(1, 40))]
        assert codec.merge(ids) == codec._merge_long(ids)


def test_codec_edge_cases(spark):
    library = Tokenizer.from_file(WORDS)
    rows = bpe_round_trip(documents(spark), WORDS)
    got = rows.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2(F.encode("decoded", "UTF-8"), 256)).collect()
    want = []
    for i, t, _ in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe_round_trip(documents(spark).limit(0), WORDS).count() == 0


def test_unusual_texts_take_the_shortcut():
    counter, library = TokenCounter(BYTES), Tokenizer.from_file(BYTES)
    merged = []
    merge = counter._costs._merge
    counter._costs._merge = lambda word: merged.append(word) or merge(word)
    text = "the price is 5 € or שלום and the price was there"
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert 0 < len(merged) <= 3  # whole tokens are never merged
