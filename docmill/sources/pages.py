"""HTML sources: stored pages, and pages fetched from the network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FetchError
from ..functions.html import html_to_markdown
from ..functions.retry import retrying
from .fetch import http_get


def pages_as_markdown(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Stored pages as (id, source, markdown)."""
    return pages.select(id_col, F.col(url_col).alias("source"), html_to_markdown(html_col).alias("markdown"))


def fetched(
    urls: DataFrame, url_col: str = "url", get: Callable[[str], str | None] = http_get, attempts: int = 1
) -> DataFrame:
    """(url, html, error): each address fetched by ``get``, up to ``attempts``
    times with growing pauses unless the error lasts; a failed one has no html.
    ``fetch.polite_pages`` spares the hosts, too."""

    def fetch(url: str) -> tuple[str | None, str | None]:
        lasting: list[FetchError] = []

        def once() -> str | None:
            try:
                html = get(url)
            except FetchError as error:
                if not error.lasting:
                    raise
                lasting.append(error)
                return None
            if html is None:
                raise FetchError("no content")
            return html

        try:
            html = retrying(once, attempts)
        except OSError as error:
            return None, str(error)
        return html, str(lasting[0]) if lasting else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [fetch(u) for u in batch["url"]]
            yield pd.DataFrame({"url": batch["url"], "html": [a[0] for a in answers], "error": [a[1] for a in answers]})

    return urls.select(F.col(url_col).alias("url")).mapInPandas(run, "url string, html string, error string")


def write_markdown(pages: DataFrame, path: str, id_col: str = "page_id", folders: int = 1024) -> None:
    """The pages' Markdown as text files under ``path``, each headed by a comment
    line with the page's id; pages are dealt over ``folders`` folders by their
    id's hash, so the number of folders doesn't grow with the pages."""
    text = F.concat(F.lit("<!-- "), F.col(id_col).cast("string"), F.lit(" -->\n"), "markdown")
    folder = F.pmod(F.xxhash64(id_col), F.lit(folders)).alias("folder")
    pages.filter("markdown is not null").select(folder, text.alias("value")).write.partitionBy("folder").text(path)
