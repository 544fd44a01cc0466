"""Merkle manifest of a dataset: a root for the whole, a subroot for each group,
and for each row the proof that leads from its leaf to the root.

Rows become leaves by hashing their fields with their lengths.  Leaves get
their place in the group by a sort over sampled ranges, whose partitions are
counted and whose counts are added up, so that a group of any size is ordered by
many tasks.  Then the tree grows level by level with windows: rows of one parent
form a partition of the window, and the ordered full frame, collected as a list,
is the parent's preimage and holds every row's sibling.  A parent is carried on by
its first row alone, so each stands once in the next level's list.

``LEVELS`` levels are made within one exchange, by (group, block of
``2 ** LEVELS`` leaves); the blocks' own hashes are the leaves of the next step,
and what is above a block is joined to it by (group, block).  So no task, frame or
list grows with the group, the largest frame has ``2 ** LEVELS`` rows, and the
steps number log(rows) / ``LEVELS``.

Trees are binary: of every two consecutive nodes, the last alone where their
number is odd, the hash is their parent, until one node is left; a single leaf is
its own root.  The subroots, in the order of their groups, grow into the root in
the same way.

Edge cases: nulls in any field hash as ``-``; a null group is a group of its own,
before all others; rows of one group with equal ids, or none (first), follow in
the order of their leaves, so repeated rows are leaves of their own; empty and
very long texts are fields like any other; an empty table gives an empty result;
columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import discard, saved

#: Levels made within one exchange.
LEVELS = 10

#: Rows of a side up to which a join broadcasts it, each of about a kilobyte
#: at most; beyond, it is a sort-merge join.
BROADCAST_ROWS = 20_000

#: Rows of a shuffle's partition that may be many more than a task should sort;
#: beyond them the session's number of partitions is raised.
PARTITION_ROWS = 4_000_000

#: The first bits of ``monotonically_increasing_id`` number the partition.
_ROW_BITS = 33


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def group_key(c: Column) -> Column:
    """A group as a string that isn't null, in the order of the groups' UTF-8
    bytes with null first."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Sizes:
    """Of a ranked table: its rows, groups, and the largest group's rows."""

    rows: int
    groups: int
    most: int

    @property
    def blocks(self) -> int:
        """At most as many blocks as this."""
        return (self.rows >> LEVELS) + self.groups

    def above(self) -> Sizes:
        return Sizes(self.blocks, self.groups, ((self.most - 1) >> LEVELS) + 1)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """``table``, to be broadcast if it has few rows."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _partitions(spark: SparkSession, rows: int) -> list[int]:
    """The number of partitions as an argument, if the session's is too small."""
    wanted = rows // PARTITION_ROWS + 1
    return [wanted] if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, Sizes]:
    """A saved table's ``rows`` with ``idx``, the place in its group ``g`` by
    ``order`` from 0 on, and ``size``, the group's rows."""
    parts = _partitions(rows.sparkSession, rows.count())
    spread = rows.repartitionByRange(*parts, "g", *order).sortWithinPartitions("g", *order)
    placed = saved(spread.withColumn("place", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("part", F.shiftright("place", _ROW_BITS))
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("place").alias("start"))
    # A group has a row for each partition here, at most.
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(
        counts.select(
            "g",
            "part",
            "n",
            (F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("before"),
            "start",
            F.sum("n").over(Window.partitionBy("g")).alias("size"),
        ),
        "merkle-offsets",
    )
    found = offsets.agg(F.count("*"), F.sum("n"), F.count_if(F.col("before") == 0), F.max("size")).first()
    out = placed.join(_small(offsets.drop("n"), found[0]), ["g", "part"])
    out = out.withColumn("idx", F.expr("place - start + before")).drop("place", "part", "start", "before")
    return out, Sizes(*(x or 0 for x in found[1:]))


def _few_ranked(rows: DataFrame, n: int) -> tuple[DataFrame, Sizes]:
    """As ``ranked`` by ``own``, for one group of a block's rows at most."""
    idx = (F.row_number().over(Window.partitionBy("g").orderBy("own")) - 1).cast("long")
    return rows.select("*", idx.alias("idx"), F.lit(n).cast("long").alias("size")), Sizes(n, min(n, 1), n)


def _climb_block(nodes: DataFrame, sizes: Sizes) -> DataFrame:
    """``nodes`` (g, idx, size, h) with ``block``, ``top``, the hash above them
    after ``LEVELS`` levels, and ``path``: at each level that their tree has, the
    sibling's digest, empty where there is none.  One statement, a window for
    each level."""
    spread = nodes.withColumn("block", F.shiftright("idx", LEVELS)).repartition(
        *_partitions(nodes.sparkSession, sizes.rows), "g", "block"
    )
    made = "SELECT *, h AS top, cast(array() AS array<binary>) AS path FROM {nodes}"
    for level in range(min(LEVELS, max(sizes.most - 1, 0).bit_length())):
        # Of a node's rows the first alone counts; a last node may have no sibling.
        made = f"""
            SELECT * EXCEPT (run, top, path),
                   CASE WHEN shiftright(size - 1, {level}) > 0 THEN sha2(cast(array_join(run, '') AS binary), 256)
                        ELSE top END AS top,
                   CASE WHEN shiftright(size - 1, {level}) > 0 THEN concat(path, array(coalesce(unhex(
                        try_element_at(run, 2 - cast(shiftright(idx, {level}) & 1 AS int))), X''))) ELSE path END AS path
            FROM (SELECT *, collect_list(CASE WHEN idx & {(1 << level) - 1} = 0 THEN top END) OVER (
                      PARTITION BY g, block, shiftright(idx, {level + 1}) ORDER BY idx
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run
                  FROM ({made}))"""
    return nodes.sparkSession.sql(made, nodes=spread)


def climb(nodes: DataFrame, sizes: Sizes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grow the trees over ``nodes`` (g, idx, size, h and others).

    Three tables: the nodes with their ``block`` and the ``path`` within it; what
    is above each block (g, block, ``above``); and the roots (g, h)."""
    stepped = saved(_climb_block(nodes, sizes), "merkle-paths")
    tops = stepped.filter(F.col("idx").bitwiseAND((1 << LEVELS) - 1) == 0).select(
        "g", F.col("block").alias("idx"), (F.shiftright(F.col("size") - 1, LEVELS) + 1).alias("size"), F.col("top").alias("h")
    )
    if sizes.most <= 1 << LEVELS:
        above = tops.select("g", F.col("idx").alias("block"), F.array().cast("array<binary>").alias("above"))
        return stepped, above, tops.select("g", "h")
    lower, upper, roots = climb(tops, sizes.above())
    joined = lower.select("g", "idx", "block", "path").join(_small(upper, sizes.above().blocks), ["g", "block"])
    above = joined.select("g", F.col("idx").alias("block"), F.concat("path", "above").alias("above"))
    return stepped, above, roots


def merkle_manifest(rows: DataFrame) -> DataFrame:
    """Trees over a saved table's ``rows`` (``g`` from ``group_key``, ``id``,
    ``leaf``, and columns of the caller's that go along).

    Gives the rows with ``subroot``, ``root`` and ``proof``: an array of
    (``sibling`` as hex text, empty where a node has none; ``odd``, whether the node
    is the right one), from the leaf to the root."""
    others = [c for c in rows.columns if c not in ("g", "leaf")]
    nodes, sizes = ranked(rows, ["id", "leaf"])
    leaves, above, subroots = climb(nodes.withColumnRenamed("leaf", "h"), sizes)

    named = saved(subroots.select(F.lit("").alias("g"), F.col("g").alias("own"), F.col("h")), "merkle-subroots")
    groups, group_sizes = _few_ranked(named, sizes.groups) if sizes.groups <= 1 << LEVELS else ranked(named, ["own"])
    group_paths, group_above, roots = climb(groups, group_sizes)
    root = roots.first()
    top = group_paths.join(_small(group_above, group_sizes.blocks), ["g", "block"]).select(
        F.col("own").alias("g"),
        F.col("h").alias("subroot"),
        F.col("idx").alias("group_idx"),
        F.concat("path", "above").alias("group_path"),
    )
    blocks = saved(above.join(_small(top, sizes.groups), "g"), "merkle-above")
    discard(named)

    def sided(path: str, at: str) -> str:
        return f"transform({path}, (s, l) -> named_struct('sibling', lower(hex(s)), 'odd', shiftright({at}, l) & 1 = 1))"

    proof = F.expr(f"concat({sided('concat(path, above)', 'idx')}, {sided('group_path', 'group_idx')})")
    return leaves.join(_small(blocks, sizes.blocks), ["g", "block"]).select(
        *others,
        F.col("h").alias("leaf"),
        "subroot",
        F.lit(root["h"] if root else None).cast("string").alias("root"),
        proof.alias("proof"),
    )


def proof_digest(proof: str = "proof") -> Column:
    """The hash of a proof's siblings, in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["sibling"]), "").cast("binary"), 256)


def folded_root(leaf: str, proof: str = "proof") -> Column:
    """The root that a leaf and a proof lead to."""
    return F.expr(
        f"""aggregate({proof}, {leaf}, (h, s) -> sha2(cast(CASE
            WHEN s.sibling = '' THEN h WHEN s.odd THEN concat(s.sibling, h) ELSE concat(h, s.sibling) END AS binary), 256))"""
    )


def _tampered(id_col: str, value: str) -> Column:
    """A count that is one too many where 7 divides the crc32 of the decimal id
    (a null id counts as the empty string); decimals, so that none overflows."""
    text = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    more = (F.crc32(text.cast("binary")) % 7 == 0).cast("int")
    return F.col(value).cast("decimal(20,0)") + more


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of a ``documents`` table, by language, checked against a
    copy some of whose counts were tampered with: per row ``doc_id``, ``leaf``,
    ``subroot``, ``root``, ``proof``, ``folded_root`` (from the copy's leaf and the
    proof) and ``verified``."""
    known = [F.col(c) for c in ("doc_id", "source", "lang")]
    rows = saved(
        docs.select(
            group_key(F.col("lang")).alias("g"),
            F.col("doc_id").cast("long").alias("id"),
            leaf_of(*known, F.col("n_chars"), F.col("text")).alias("leaf"),
            leaf_of(*known, _tampered("doc_id", "n_chars"), F.col("text")).alias("seen"),
        ),
        "merkle-leaves",
    )
    out = merkle_manifest(rows).withColumn("folded_root", folded_root("seen"))
    return out.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        "proof",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
