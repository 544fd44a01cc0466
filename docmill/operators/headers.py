"""Markdown headers: context of a text, and the split by headers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import row_function
from ..functions.text import strip

_LINE = r"(?mdU)^(#{1,6})\s+(.+)$"


def header_context(c: Column | str) -> Column:
    """The headers in force at a text's end, as a map "Header n" to title.

    A header of some level sets that level and clears the deeper ones.  Code
    fences aren't minded."""
    text = F.col(c) if isinstance(c, str) else c
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_LINE), 1).alias("mark"),
        F.regexp_extract_all(text, F.lit(_LINE), 2).alias("title"),
    )
    kind = "map<string,string>"

    def step(acc: Column, x: Column) -> Column:
        key = F.concat(F.lit("Header "), F.length(x["mark"]).cast("string"))
        above = F.map_filter(acc, lambda k, _: k < key)  # one digit, so text order is level order
        return F.map_concat(above, F.create_map(key, strip(x["title"]))).cast(kind)

    last = F.aggregate(found, F.create_map().cast(kind), step)
    return F.map_filter(last, lambda _, v: v != "")


_SECTION = T.ArrayType(
    T.StructType(
        [
            T.StructField("content", T.StringType()),
            T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        ]
    )
)


def _fence(line: str) -> str:
    """The marker that a line opens a code fence with, or nothing."""
    if line.startswith("```") and line.count("```") == 1:
        return "```"
    return "~~~" if line.startswith("~~~") else ""


def _blocks(text: str, deepest: int) -> list[tuple[list[str], dict[str, str]]]:
    """Lines grouped between headers and blank lines, with the trail in force."""
    trail: list[tuple[int, str]] = []
    blocks: list[tuple[list[str], dict[str, str]]] = []
    lines: list[str] = []
    headers: dict[str, str] = {}
    fence = ""

    def close() -> None:
        nonlocal lines
        if lines:
            blocks.append((lines, headers))
            lines = []

    for raw in text.split("\n"):
        line = "".join(ch for ch in raw.strip() if ch.isprintable())
        if fence:
            if line.startswith(fence):
                fence = ""
            lines.append(line)
            continue
        fence = _fence(line)
        found = None if fence else re.match(r"(#+)(?: |$)", line)
        if found and len(found[1]) <= deepest:
            level = len(found[1])
            close()
            while trail and trail[-1][0] >= level:
                trail.pop()
            trail.append((level, line[level:].strip()))
            headers = {f"Header {n}": title for n, title in trail}
            lines.append(line)
        elif line:
            lines.append(line)
        else:
            close()
    close()
    return blocks


def sections(text: str, deepest: int = 6) -> list[dict]:
    """Split a Markdown text by its headers; header lines stay.

    Neighbouring blocks with equal headers are joined, and so is a block that
    ends in a header line with the deeper block under it."""
    out: list[tuple[list[str], dict[str, str]]] = []
    for lines, headers in _blocks(text, deepest):
        content = "\n".join(lines)
        if out:
            parts, above = out[-1]
            tail = parts[-1].rsplit("\n", 1)[-1]
            if above == headers or (len(above) < len(headers) and tail.startswith("#")):
                out[-1] = ([*parts, content], headers)
                continue
        out.append(([content], headers))
    return [{"content": "  \n".join(parts), "headers": headers} for parts, headers in out]


def split_by_headers(c: Column | str, max_level: int = 6) -> Column:
    """Sections of a Markdown text as an array of (content, headers).

    Markdown's line states don't fit SQL's expressions, so this is the one
    Python function of the chunker's path, sent in Arrow batches.  A section
    without headers of the split levels gets the context of its own text; so does
    the whole text where splitting fails."""

    def run(text: str) -> list[dict]:
        try:
            found = sections(text, max_level)
        except Exception:  # noqa: BLE001  a failed split keeps the text
            found = [{"content": text, "headers": {}}]
        return [{"content": s["content"], "headers": list(s["headers"].items())} for s in found]

    # Marked as nondeterministic so that no later Python function is folded into
    # the same projection, where Spark 4.1 fails to take both out.
    found = row_function(run, _SECTION).asNondeterministic()(F.col(c) if isinstance(c, str) else c)
    return F.transform(
        found,
        lambda s: F.struct(
            s["content"].alias("content"),
            F.when(F.size(s["headers"]) > 0, s["headers"]).otherwise(header_context(s["content"])).alias("headers"),
        ),
    )
