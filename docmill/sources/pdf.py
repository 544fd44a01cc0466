"""PDF sources.  The parser is a plug-in: a function from a file's bytes to the
texts of its pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PageParser = Callable[[bytes], list[str]]


def pdf_pages(spark: SparkSession, path: str, parser: PageParser) -> DataFrame:
    """(path, page_no, text, error) of every file under ``path``; a file that
    can't be parsed has one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(file, i + 1, t, None) for i, t in enumerate(parser(bytes(content)))]
                except Exception as error:  # noqa: BLE001  one bad file isn't the job's end
                    rows = [(file, None, None, f"An error occurred during PDF parsing: {error}")]
                yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")


def join_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, markdown): page texts in order, joined by a line feed; null for a
    file without pages."""
    of_page = F.when(F.col("page_no").isNotNull(), F.struct("page_no", "text"))
    texts = F.transform(F.array_sort(F.collect_list(of_page)), lambda p: p["text"])
    return pages.groupBy(key).agg(F.when(F.count("page_no") > 0, F.array_join(texts, "\n")).alias("markdown"))


def page_preview(pages: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` pages of each file that has a text, in order."""
    return pages.filter(F.col("page_no") <= n).orderBy("path", "page_no")
