"""Text expressions, all inside the JVM.

Whitespace follows Unicode plus the four information separators (1C to 1F),
and a line ends at a line feed alone, hence the (?mdU) flags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\s\x1c-\x1f"
WORD = rf"(?U)[^{_SPACE}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(c: Column | str) -> Column:
    """Runs of anything but whitespace."""
    return F.regexp_count(_col(c), F.lit(WORD))


def char_count(c: Column | str) -> Column:
    """Code points."""
    return F.length(_col(c))


def strip(c: Column | str) -> Column:
    """Without whitespace at both ends (``trim`` only takes spaces)."""
    return F.regexp_replace(_col(c), rf"(?U)\A[{_SPACE}]+|[{_SPACE}]+\z", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or nothing but whitespace."""
    return F.coalesce(~_col(c).rlike(WORD), F.lit(True))


def remove_nul(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\0"), F.lit(""))


def sentences(c: Column | str) -> Column:
    """Cut at whitespace that follows a full stop, question or exclamation mark."""
    return F.split(_col(c), r"(?<=[.?!])\s+")


def title_in_first_lines(c: Column | str, lines: int = 10) -> Column:
    """The first level-1 header among the first lines, else "Untitled"."""
    head = F.slice(F.split(strip(c), "\n"), 1, lines)
    stripped = F.transform(head, strip)
    found = F.filter(stripped, lambda x: x.rlike(r"(?dU)\A#\s+.+\z"))
    first = F.try_element_at(found, F.lit(1))
    return F.coalesce(strip(F.regexp_extract(first, r"(?dU)\A#\s+(.+)\z", 1)), F.lit("Untitled"))


def title_anywhere(c: Column | str) -> Column:
    """The first level-1 header of the whole text, else null.

    The blank after the mark may span lines, so a lone mark takes its title
    from the next line that has text."""
    found = F.regexp_extract(strip(c), r"(?mdU)^#\s+(.+)$", 1)
    return F.nullif(strip(found), F.lit(""))


def strip_header_lines(c: Column | str) -> Column:
    """Without any header line, stripped."""
    return strip(F.regexp_replace(_col(c), r"(?mdU)^#+\s.*$", ""))


def header_keys(levels: int | Column) -> Column:
    """An array of (mark, name) for the levels from 1 on."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(levels) if isinstance(levels, int) else levels),
        lambda i: F.struct(
            F.repeat(F.lit("#"), i).alias("mark"), F.concat(F.lit("Header "), i.cast("string")).alias("name")
        ),
    )


def header_lines(headers: Column | str) -> Column:
    """A header map written as Markdown lines, by level."""
    entries = F.array_sort(F.map_entries(_col(headers)))
    lines = F.transform(
        entries,
        lambda e: F.concat(
            F.repeat(F.lit("#"), F.split_part(e["key"], F.lit(" "), F.lit(2)).cast("int")),
            F.lit(" "),
            e["value"],
            F.lit("\n"),
        ),
    )
    return F.array_join(lines, "")
