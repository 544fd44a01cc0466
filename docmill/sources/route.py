"""Which parser a source goes to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_kind(source: Column | str) -> Column:
    """html for web addresses (also of PDFs), pdf by the ending, else unsupported."""
    s = F.col(source) if isinstance(source, str) else source
    return (
        F.when(s.rlike(r"\A(?i)https?://"), "html")
        .when(F.endswith(F.lower(s), F.lit(".pdf")), "pdf")
        .otherwise("unsupported")
    )
