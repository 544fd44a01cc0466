"""License statements by diagonal voting.

All rolling word k-gram hashes of all texts are joined by Spark to the k-grams
of license templates.  A match at text position p and template position t votes
for the diagonal p - t.  Votes are counted by (text, template, diagonal),
diagonals at most ``GAP`` words apart are merged (words put in or left out),
and each merged span is verified word by word against the text: it names the
template's license where the template is no more edits away (words replaced, put
in or left out) than ``COVERED_OF_100`` per cent of its words leave free, the
words that tell the license from others in place, in their order.  Of spans that
lie within one another the one with more words in place stays.

Votes are keyed by the text's hash, so copies vote once and repeated or missing
ids do no harm.  The template table is fixed and small, hence broadcast.  The
spans go back to the texts by a broadcast only while they are at most
``BROADCAST_SPANS``, else by a sort-merge join whose hot keys Spark splits.

A diagonal needs one whole k-gram.  Templates name their k-grams so that every
span which verification accepts leaves at least one of them whole, wherever its
edits stand (tests try all places), and verification looks as far to either side
of a diagonal as edits can lead: of a template
with words that must stand, k-grams around those; ``K`` words, and fewer for the
shortest templates.

Edge cases: a null or empty text has no words, no labels and score 0; texts
shorter than a k-gram get base labels only; repeated rows are judged one by
one; an empty table gives an empty result; columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import map_batches, utf8
from .storage import saved
from .words import alnum_words, rolling

K = 3
SIZES = (2, 3)
GAP = 3
COVERED_OF_100 = 80
BROADCAST_SPANS = 200_000

#: Phrases whose words name a license wherever they stand.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Label, statement in lower-case words, words that must stand.
TEMPLATES = [
    ("mit", "released under the mit license", "mit"),
    ("mit", "licensed under the mit license", "mit"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this"
        " software and associated documentation files the software to deal in the software"
        " without restriction",
        "",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file"
        " except in compliance with the license",
        "apache 2",
    ),
    ("gpl-3", "licensed under the gnu general public license version 3", "general 3"),
    (
        "gpl-3",
        "under the terms of the gnu general public license as published by the free software"
        " foundation either version 3 of the license or at your option any later version",
        "general 3",
    ),
    ("gpl-2", "licensed under the gnu general public license version 2", "general 2"),
    (
        "gpl-2",
        "under the terms of the gnu general public license as published by the free software"
        " foundation either version 2 of the license or at your option any later version",
        "general 2",
    ),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "lesser 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero 3"),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla 2",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are"
        " permitted provided that the following conditions are met",
        "",
    ),
    ("cc-by", "licensed under cc by 4 0", "by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc 4"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "unencumbered",
    ),
]


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all rolling k-grams, for each k in ``SIZES``."""
    codes = _codes(words)
    parts = [rolling(codes, k) for k in SIZES]
    return np.concatenate([np.arange(len(x)) for x in parts]), np.concatenate(parts).view(np.int64)


def edits_of(n: int) -> int:
    """How many of a template's n words may be edited."""
    return n - -(-n * COVERED_OF_100 // 100)


def gram_places(statement: list[str], must: set[str]) -> tuple[int, list[int]]:
    """(k, places): the k-grams that a template is found by.

    At most n - ceil(COVERED * n) edits leave a run of at least (n - edits) /
    (edits + 1) words; where that is less than ``K``, and words must stand, the
    shorter k-grams that hold one of those do."""
    n = len(statement)
    replaced = edits_of(n)
    k = min(K, -(-(n - replaced) // (replaced + 1)))
    places = range(n - k + 1)
    return k, [t for t in places if k == K or not must or must & set(statement[t : t + k])]


def template_grams(spark: SparkSession) -> DataFrame:
    """(h, template, t): the k-grams of every template and where they stand."""
    rows = []
    for i, (_, statement, must) in enumerate(TEMPLATES):
        k, places = gram_places(statement.split(), set(must.split()))
        hashes = rolling(_codes(statement.encode().split()), k).view(np.int64)
        rows += [(int(hashes[t]), i, t) for t in places]
    return spark.createDataFrame(rows, "h long, template int, t int")


def candidate_spans(texts: DataFrame) -> DataFrame:
    """(key, spans): merged diagonals as an array of (template, diagonals).

    ``texts`` has ``key``, the text's hash, and ``text``."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            grams = [_grams(alnum_words(t)) for t in utf8(batch, "text")]
            ends = pa.array(np.cumsum([0, *(len(p) for p, _ in grams)]), pa.int32())
            flat = [pa.array(np.concatenate([g[i] for g in grams])) for i in (0, 1)]
            return [batch.column("key"), *(pa.ListArray.from_arrays(ends, x) for x in flat)]

        return work

    rows = map_batches(texts, make, "key long, p array<long>, h array<long>", rows_at_once=512)
    flat = rows.select("key", F.explode(F.arrays_zip("p", "h")).alias("g")).select("key", "g.p", "g.h")
    matches = flat.join(F.broadcast(template_grams(texts.sparkSession)), "h")
    votes = (
        matches.select("key", "template", "t", (F.col("p") - F.col("t")).alias("diagonal"))
        .distinct()
        .groupBy("key", "template", "diagonal")
        .agg(F.count("*").alias("votes"))
    )
    by_diagonal = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > GAP
    merged = (
        votes.withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("opens").over(by_diagonal))
        .groupBy("key", "template", "span")
        .agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    )
    # No span is left out for few votes: verification decides on all of them.
    return merged.groupBy("key").agg(F.collect_list(F.struct("template", "diagonals")).alias("spans"))


class _Judge:
    """Places of phrases and verified spans of one text."""

    def __init__(self):
        self.phrases = [(f" {p} ".encode(), label) for p, label in PHRASES]
        self.templates = [(label, s.encode().split(), set(m.encode().split())) for label, s, m in TEMPLATES]

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        joined = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in self.phrases:
            at, seen, place = joined.find(phrase), 0, 0
            while at >= 0:
                place += joined.count(b" ", seen, at)
                found.append((place, label))
                seen, at = at, joined.find(phrase, at + 1)
        return found

    def align(self, words: list[bytes], template: int, diagonal: int):
        """The template's best place near a diagonal, as (edits, start, end, words
        in place), or None.

        Words are replaced, put in or left out at one edit each, as many as a
        template may lack words, and those that must stand are not replaced or left
        out.  So places rise with the template's words, and no more words are put
        in than edits are free.  The table covers the diagonals within that reach."""
        _, statement, must = self.templates[template]
        n, free = len(statement), edits_of(len(statement))
        low = diagonal - free
        width = 2 * free + 1
        # A column for each diagonal; a cell is (edits, -words in place, first, last).
        row = [(0, 0, -1, -1) if 0 <= low + k <= len(words) else None for k in range(width)]
        for t, word in enumerate(statement):
            lost = word in must
            after: list = []
            for k in range(width):
                p = t + low + k  # the text's word that the template's would stand at
                best = None
                if row[k] is not None and 0 <= p < len(words):
                    edits, hits, first, _ = row[k]
                    if words[p] == word:
                        best = (edits, hits - 1, first if first >= 0 else p, p)
                    elif not lost:
                        best = (edits + 1, *row[k][1:])
                if k + 1 < width and row[k + 1] is not None and not lost:
                    out = (row[k + 1][0] + 1, *row[k + 1][1:])
                    best = out if best is None else min(best, out)
                if k and after[k - 1] is not None and p < len(words):
                    put_in = (after[k - 1][0] + 1, *after[k - 1][1:])
                    best = put_in if best is None else min(best, put_in)
                after.append(best if best is not None and best[0] <= free else None)
            row = after
            if not any(row):
                return None
        edits, hits, first, last = min(c for c in row if c is not None)
        return edits, first, last + 1, -hits

    def accepted(self, words: list[bytes], template: int, diagonals: list[int]) -> list[tuple]:
        """(coverage, label, start, end, words in place) of the template's places
        on or near the diagonals; of places that overlap the best one."""
        label, statement, _ = self.templates[template]
        found = {place for d in diagonals if (place := self.align(words, template, d))}
        kept: list[tuple] = []
        ends: list[int] = []
        starts: list[int] = []
        for _, start, end, hits in sorted(found):
            at = bisect(starts, start)
            if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or end <= starts[at]):
                starts.insert(at, start)
                ends.insert(at, end)
                kept.append((hits / len(statement), label, start, end, hits))
        return kept

    def verify(self, words: list[bytes], template: int, diagonals: list[int]):
        """The best of the accepted places, or None."""
        return next(iter(self.accepted(words, template, diagonals)), None)


def outermost(found: list[tuple]) -> list[tuple]:
    """Without spans that lie within one of another template with more words in
    place: "affero" put into the general license's words names the other one."""
    found = sorted(found, key=lambda v: (v[2], -v[3], -v[4]))
    kept: list[tuple] = []
    open_: list[tuple] = []  # kept spans that may hold the next ones
    for v in found:
        open_ = [w for w in open_ if w[3] > v[2]]
        if not any(w[3] >= v[3] and w[4] > v[4] for w in open_):
            kept.append(v)
            open_.append(v)
    return kept


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_base`` (places of phrases), ``first_word``
    and ``last_word`` (their smallest and largest start, or null),
    ``base_labels``, ``labels`` and ``spans`` (``label:start:end`` in words, of
    all verified spans), each comma-joined, and ``score``: the best coverage,
    1 where a phrase stands."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    spans = saved(candidate_spans(keyed.filter("text is not null").select("key", "text")), "license-spans")
    few = spans.limit(BROADCAST_SPANS + 1).count() <= BROADCAST_SPANS
    joined = keyed.join(F.broadcast(spans) if few else spans, "key", "left").select("id", "text", "spans")

    def make():
        judge = _Judge()

        def work(batch: pa.RecordBatch) -> list:
            out = defaultdict(list)
            for text, spans in zip(utf8(batch, "text"), batch.column("spans").to_pylist()):
                words = alnum_words(text)
                places = judge.places(words)
                found = outermost(
                    [v for s in spans or () for v in judge.accepted(words, s["template"], s["diagonals"])]
                )
                base = {label for _, label in places}
                starts = [p for p, _ in places]
                out["n"].append(len(words))
                out["base"].append(len(places))
                out["first"].append(min(starts, default=None))
                out["last"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {v[1] for v in found})))
                out["spans"].append(",".join(f"{v[1]}:{v[2]}:{v[3]}" for v in sorted(found, key=lambda v: v[2:4] + v[1:2])))
                out["score"].append(max([1.0 if places else 0.0, *(v[0] for v in found)]))
            return [batch.column("id"), *out.values()]

        return work

    out = map_batches(
        joined,
        make,
        "id long, n_words long, n_base long, first_word long, last_word long,"
        " base_labels string, labels string, spans string, score double",
    )
    return out.withColumnRenamed("id", id_col)
