"""Secret scan with corpus-wide ownership frequency.

Detectors find candidates in every whole text.  The hashes of their values are
aggregated over the whole corpus by distinct repositories and distinct owners:
a value that many owners hold is a copied example, one that a single owner
holds and that is irregular enough is a live-looking credential.  Values are
only ever kept as hashes.

Detectors of the fixed base kinds always keep their spans.  The further kinds
(provider prefixes, bearer headers, web tokens, credentials in addresses,
private keys) add a span only where the ownership says live-looking.  A base
finding that is live-looking adds one more span of kind ``live`` over its value.

The counts are sums of partial counts, so a value in a third of all rows meets
in no single task.  They are written before they go back to the findings: by a
broadcast while they are at most ``BROADCAST_ROWS`` values, else by a join with
plain exchanges on both sides, which Spark splits where a key is hot.

Edge cases: a null text has no findings; a null repository counts as one
repository of its own, named by the empty string; texts of any length are
scanned whole; repeated rows are each scanned and, having the same repository,
don't raise ownership; an empty table gives an empty result; columns other than
id, text and repository are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, strings
from .storage import saved

#: The base kinds in order, with pattern, group of the value,
#: least length of that group.
BASE = [
    (
        "assign",
        re.compile(
            r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        8,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    # Runs are matched greedily from their start, so demanding 32 at once drops
    # the same matches as looking at the length afterwards.
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
]

#: Kinds whose spans depend on ownership.
MORE = [
    ("prefixed", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"), 0, 16),
    ("bearer", re.compile(r"\bBearer\x20+([A-Za-z0-9._~+/-]{20,}=*)"), 1, 20),
    # Of a run's places where a token could begin the first is tried alone, since all
    # end where the run does; so a long run is read once.
    (
        "webtoken",
        regex.compile(
            r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=\beyJ))\KeyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"
        ),
        0,
        30,
    ),
    ("login", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:([^\s/@]{6,})@"), 1, 6),
    ("privatekey", re.compile(r"-----BEGIN [A-Z ]*?PRIVATE KEY-----([A-Za-z0-9+/=\s]{40,})"), 1, 40),
]

#: A text can only hold a match of these kinds if it holds one of these strings.
_HINTS = {
    "assign": (":", "="),
    "access": ("AKIA",),
    "prefixed": ("gh", "sk-", "xox", "AIza"),
    "bearer": ("Bearer",),
    "webtoken": ("eyJ",),
    "login": ("://",),
    "privatekey": ("PRIVATE KEY",),
}

#: Kinds in the order in which spans with the same start are listed.
KINDS = [k[0] for k in BASE + MORE] + ["live"]

BROADCAST_ROWS = 300_000

#: A value that this many distinct owners hold is a copied example.
EXAMPLE_OWNERS = 3

#: Bits of entropy per character below which a value looks like a placeholder.
LIVE_ENTROPY = 2.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) if n else 0.0


def findings_of(text: str) -> list[tuple[int, int, int, int, int, str]]:
    """(start, kind number, end, value's start and end, value) of every match
    whose value is long enough."""
    found = []
    for number, (kind, pattern, group, least) in enumerate(BASE + MORE):
        if kind in _HINTS and not any(h in text for h in _HINTS[kind]):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), number, m.end(), *m.span(group), m.group(group)))
    found.sort()
    return found


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str) -> DataFrame:
    """One row per document, with its findings as parallel arrays."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            all_found = [findings_of(t) for t in strings(batch, "text")]
            return [
                batch.column("id"),
                batch.column("repo"),
                [[f[1] for f in x] for x in all_found],
                [[f[0] for f in x] for x in all_found],
                [[f[2] for f in x] for x in all_found],
                [[f[3] for f in x] for x in all_found],
                [[f[4] for f in x] for x in all_found],
                [[hashlib.sha256(f[5].encode()).hexdigest()[:32] for f in x] for x in all_found],
                [[entropy(f[5]) >= LIVE_ENTROPY for f in x] for x in all_found],
            ]

        return work

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.col(text_col).cast("string").alias("text"),
    )
    found = map_batches(
        rows,
        make,
        "id long, repo string, kinds array<int>, starts array<long>, ends array<long>,"
        " value_starts array<long>, value_ends array<long>, digests array<string>, irregular array<boolean>",
    )
    return found.withColumn("row", F.monotonically_increasing_id())


def owner_of(repo: Column) -> Column:
    """The part of a repository's name before its first slash."""
    return F.substring_index(repo, "/", 1)


def ownership(findings: DataFrame) -> DataFrame:
    """(digest, n_repos, n_owners) over all findings."""
    held = findings.select("digest", "repo").distinct().withColumn("owner", owner_of(F.col("repo")))
    by_owner = held.groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the scanned documents (``row``, ``id`` and their findings as
    arrays), and the findings one by one (``row``, ``kind``, ``start``, ``end``,
    the value's own ``value_start`` and ``value_end``, its ``digest``,
    ``n_repos``, ``n_owners``, ``verdict``: example, live or unclear)."""
    scanned = saved(scan(docs, id_col, text_col, repo_col), "secret-scan")
    arrays = ["kinds", "starts", "ends", "value_starts", "value_ends", "digests", "irregular"]
    flat = scanned.select(
        "row", "repo", F.explode(F.arrays_zip(*arrays)).alias("f")
    ).select(
        "row",
        "repo",
        F.col("f.kinds").alias("kind_number"),
        F.col("f.starts").alias("start"),
        F.col("f.ends").alias("end"),
        F.col("f.value_starts").alias("value_start"),
        F.col("f.value_ends").alias("value_end"),
        F.col("f.digests").alias("digest"),
        F.col("f.irregular").alias("irregular"),
    )
    verdict = (
        F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example")
        .when((F.col("n_owners") == 1) & F.col("irregular"), "live")
        .otherwise("unclear")
    )
    owned = saved(ownership(flat), "secret-owners")
    few = owned.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    judged = flat.join(F.broadcast(owned) if few else owned, "digest").select(
        "row",
        F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_number") + 1).alias("kind"),
        "kind_number",
        "start",
        "end",
        "value_start",
        "value_end",
        "digest",
        "n_repos",
        "n_owners",
        verdict.alias("verdict"),
    )
    return scanned, judged


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of (start, kind_number, end) structs."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind_number"] + 1), s["start"], s["end"]),
        ),
        ",",
    )


def added_spans(judged: DataFrame) -> DataFrame:
    """(row, added): what the ownership adds to the base spans of a document."""
    base = F.col("kind_number") < len(BASE)
    span = F.struct(
        F.when(base, F.col("value_start")).otherwise(F.col("start")).alias("start"),
        F.when(base, F.lit(len(KINDS) - 1)).otherwise(F.col("kind_number")).alias("kind_number"),
        F.when(base, F.col("value_end")).otherwise(F.col("end")).alias("end"),
    )
    return judged.filter(F.col("verdict") == "live").groupBy("row").agg(F.collect_set(span).alias("added"))


def base_spans() -> Column:
    """The base findings of a scanned row as (start, kind_number, end) structs."""
    zipped = F.arrays_zip("starts", "kinds", "ends")
    shaped = F.transform(
        zipped,
        lambda z: F.struct(
            z["starts"].alias("start"), z["kinds"].alias("kind_number"), z["ends"].alias("end")
        ),
    )
    return F.filter(shaped, lambda s: s["kind_number"] < len(BASE))
