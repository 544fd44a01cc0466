"""Small tables with every edge case, and plain restatements to compare with."""

import re

EXTRA = [
    "id", "h", "fp", "key", "row", "run", "component", "node", "url", "html", "score", "batch", "gone_id", "Gone_H", "hashes", "n",
    "__docmill_hash", "__docmill_id", "__docmill_edge", "__docmill_hash_", "spans", "grams", "items", "digest",
]

TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta.", "src0"),
    (2, "Alpha beta gamma delta epsilon zeta.", "src1"),
    (2, "Alpha beta gamma delta epsilon zeta.", "src1"),  # repeated row
    (3, None, "src0"),
    (4, "", None),
    (5, "   \n\t ", "src0"),
    (None, "Alpha beta gamma delta epsilon zeta.", "src2"),
    (None, "only without id", "src2"),
    (6, "Éa ß 中文 text <|endoftext|> 'S don't 12345 \x1c x​y", "src3/repo"),
    (7, "word " * 40_000, "src0"),
    (8, "x" * 100_000, "src0"),
    (9, "Released under the MIT License. password = \"abcdEFGH12345678\"", "src4/a"),
    (10, "two words", "src0"),
    (-5, "ΑΣ İK test", "src0"),
]


def documents(spark, rows=TEXTS, extra=True):
    df = spark.createDataFrame(
        [(i, t, "en", s, len(t or "")) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in EXTRA})
    return df


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


class Links:
    """Classes of linked items, each named by its least item."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
