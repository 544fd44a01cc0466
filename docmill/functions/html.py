"""HTML to Markdown with ATX headings, on the standard library's parser.

Nothing is taken out as boilerplate: navigation and footers stay; scripts,
styles, comments and the doctype go.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import row_function

_DROPPED = {"script", "style"}
_MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}
_BLOCKS = {"p", "div", "article", "section", "nav", "footer", "header", "main", "table", "tr", "form", "title"}


class _Writer(HTMLParser):
    """Collects Markdown; open tags that are never closed are closed at the end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self._frames: list[list[str]] = [[]]  # text of the open inline tags
        self._open: list[tuple[str, dict]] = []
        self._lists: list[list] = []  # kind and counter of open lists
        self._dropped = 0
        self._pre = 0

    def _put(self, text: str) -> None:
        self._frames[-1].append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROPPED:
            self._dropped += 1
        elif self._dropped:
            return
        elif tag in _MARKS or tag == "a":
            self._open.append((tag, dict(attrs)))
            self._frames.append([])
        elif re.fullmatch("h[1-6]", tag):
            self._put(f"\n\n{'#' * int(tag[1])} ")
        elif tag in _BLOCKS:
            self._put("\n\n")
        elif tag in ("ul", "ol"):
            self._put("\n" if self._lists else "\n\n")
            self._lists.append([tag, 0])
        elif tag == "li":
            kind = self._lists[-1] if self._lists else ["ul", 0]
            kind[1] += 1
            mark = "*" if kind[0] == "ul" else f"{kind[1]}."
            self._put("\n" + "  " * max(0, len(self._lists) - 1) + mark + " ")
        elif tag == "br":
            self._put("  \n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag == "img":
            seen = dict(attrs)
            self._put(f"![{seen.get('alt') or ''}]({seen.get('src') or ''})")
        elif tag == "pre":
            self._pre += 1
            self._put("\n\n```\n")
        elif tag == "blockquote":
            self._put("\n\n> ")

    def _close(self) -> None:
        tag, attrs = self._open.pop()
        text = "".join(self._frames.pop())
        core = text.strip()
        if not core:
            self._put(text)
            return
        lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
        if tag == "a":
            href = attrs.get("href")
            self._put(f"{lead}[{core}]({href}){tail}" if href else text)
        else:
            self._put(f"{lead}{_MARKS[tag]}{core}{_MARKS[tag]}{tail}")

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self._dropped = max(0, self._dropped - 1)
        elif self._dropped:
            return
        elif tag in _MARKS or tag == "a":
            if any(t == tag for t, _ in self._open):
                while self._open[-1][0] != tag:
                    self._close()
                self._close()
        elif re.fullmatch("h[1-6]", tag) or tag in _BLOCKS or tag == "blockquote":
            self._put("\n\n")
        elif tag in ("ul", "ol"):
            if self._lists:
                self._lists.pop()
            self._put("" if self._lists else "\n\n")
        elif tag == "pre":
            self._pre = max(0, self._pre - 1)
            self._put("\n```\n\n")

    def handle_data(self, data: str) -> None:
        if not self._dropped:
            self._put(data if self._pre else re.sub(r"\s+", " ", data))

    def text(self) -> str:
        while self._open:
            self._close()
        out = "".join(self._frames[0])
        out = re.sub(r"(?m)^[ \t]+(?=[^ \t*\d])", "", out)
        out = re.sub(r"(?m)(?<! ) $", "", out)
        return re.sub(r"\n(?:[ \t]*\n)+", "\n\n", out).strip()


#: What may be a reference by name, with or without its semicolon; none is longer.
_NAMED = re.compile("&([A-Za-z][A-Za-z0-9]{0,31};?)")


def _only_unended(html: str, names: Collection[str]) -> str:
    """The page with references that lack their semicolon made plain text, but
    for those of ``names``."""

    def plain(found: re.Match) -> str:
        text = found[1]
        if text in html5 and text.endswith(";"):
            return found[0]
        # As parsers do: the longest name that needs no semicolon.
        name = next((text[:n] for n in range(len(text), 1, -1) if text[:n] in html5), None)
        return found[0] if name is None or name in names else f"&amp;{text}"

    return _NAMED.sub(plain, html)


def markdown_of(html: str, unended: Collection[str] | None = None) -> str:
    writer = _Writer()
    writer.feed(html if unended is None else _only_unended(html, unended))
    writer.close()
    return writer.text()


def html_to_markdown(html: Column | str, unended: Collection[str] | None = None) -> Column:
    """Markdown of a stored page; null stays null.  Parsing HTML needs a state
    machine, hence Python, in Arrow batches.

    ``unended`` names the character references that are read without their
    semicolon, too; by default all that HTML allows (``&quot`` is a quote)."""

    run = row_function(partial(markdown_of, unended=unended), T.StringType())
    return run(F.col(html) if isinstance(html, str) else html)


def first_heading(html: Column | str) -> Column:
    """The text between the first h1 tags, in the JVM; empty if there is none."""
    return F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
