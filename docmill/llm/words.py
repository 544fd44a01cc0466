"""Words of whole texts as bytes, cut at C speed."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z and turns every byte in 00-2F, 3A-60 and 7B-7F into a space.
#: Bytes from 80 on belong to characters outside ASCII and stay.
_TABLE = bytes(
    b + 32
    if 0x41 <= b <= 0x5A
    else 32
    if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F
    else b
    for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """The matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z was
    lower-cased; other letters keep their case."""
    return text.translate(_TABLE).split()


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` neighbouring codes (unsigned 64-bit)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * factor + codes[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * factor
    return out
