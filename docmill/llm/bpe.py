"""Byte alphabet and the test for plain texts that the two BPE operators share."""

from __future__ import annotations

from functools import lru_cache

import regex


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: bytes
    that are printable in Latin-1 stand for themselves, the others for the
    code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = {}, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


#: Code points outside these ranges may be letters in one Unicode version and
#: unassigned in another, so texts that hold any go through the tokenizer
#: library's own pre-tokenizer.
_OTHER = regex.compile(r"[^\x00-՗Ḁ-ỿ -⁤ぁ-ゖ゠-ヿ一-龥가-힣]")


def SAFE_TEXT(text: str) -> bool:
    """Whether pre-tokens can be cut with this process's own regex tables."""
    return text.isascii() or _OTHER.search(text) is None
