"""Fill-in-the-middle transformation of whole texts.

A text is cut into units (runs of ASCII letters, any other character alone).  Two
cuts at unit ends, drawn from a hash of the document's id, part it into prefix,
middle and suffix, which are put in the order prefix, suffix, middle (``psm``) or
suffix, prefix, middle (``spm``), each behind its mark; some texts stay plain.

The work is a pandas UDF over Arrow batches: the regex library's matches leave
their end offsets in a compact array, two lookups in it give the cuts, hashlib
gives the seeds and the digests.  No shuffle, no state between rows.

Edge cases: a null text counts as empty; an empty text, and one that holds a
mark, stays plain, so every output can be put together again; a null id is
seeded like an empty one; repeated rows give repeated rows; units are counted
over whole texts of any length, eight bytes each; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Of a hundred texts, those with a draw from here on stay plain.
PLAIN_FROM = 90

#: Of a hundred others, those with a draw below this are in the order ``spm``.
SPM_BELOW = 20

_COLUMNS = [
    ("n", T.LongType()),
    ("form", T.StringType()),
    ("prefix_chars", T.LongType()),
    ("middle_chars", T.LongType()),
    ("output_sha256", T.StringType()),
    ("restored_sha256", T.StringType()),
    ("output", T.StringType()),
]


def draws(doc_id: str) -> list[int]:
    """Four numbers of 32 bits from the decimal id."""
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    import regex

    # The library caches compiled patterns.
    return array("q", (m.end() for m in regex.finditer(r"[A-Za-z]+|[^A-Za-z]", text)))


def transform(doc_id: str, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output)."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    a, b = (ends[cut - 1] if cut else 0 for cut in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of.

    Its parts hold no mark, and no mark begins within another, so the first place
    of each mark is the one that was put in."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _transformed(doc_id: Column, text: Column, texts: bool) -> Column:
    names = [name for name, _ in _COLUMNS if texts or name != "output"]
    kind = T.StructType([T.StructField(name, t) for name, t in _COLUMNS if name in names])

    @F.pandas_udf(kind)
    def run(ids: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for doc_id, body in zip(ids, bodies):
            n, form, prefix, middle, output = transform(doc_id, body)
            rows.append((n, form, prefix, middle, _digest(output), _digest(restore(output, form)), output)[: len(names)])
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    empty = F.lit("")
    return run(F.coalesce(doc_id.cast("long").cast("string"), empty), F.coalesce(text.cast("string"), empty))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row: the id, ``n`` (units), ``form`` (plain, psm, spm),
    ``prefix_chars``, ``middle_chars`` (null if plain), ``output_sha256``,
    ``restored_sha256`` (of the text put together again from the output) and, with
    ``texts``, the ``output`` itself."""
    made = docs.select(
        F.col(id_col).cast("long").alias(id_col), _transformed(F.col(id_col), F.col(text_col), texts).alias("made")
    )
    return made.select(id_col, "made.*")
