"""Exact duplicates by a content sort.

Sampled splitters range-partition the normalised bytes, an external sort puts
equal texts next to each other, and each text is compared in full with its
neighbour.  The order is (first ``PREFIX`` characters, 64-bit hash, text, id);
the splitters are taken from (prefix, hash, id), so that what sampling brings
to the driver has a bounded size per row, and so that a group of any size,
even a third of all rows, is dealt over as many partitions as it fills.

A group that reaches past a partition's end leaves one *run* in each partition
that it touches.  Only the runs that stand first or last in their partition can
do so: they carry their whole text, are put together by it, and the result,
at most a few rows for each partition, is handed back to their rows.

Edge cases: a null text counts as the empty text; rows with a null id come
after all others of their group, and a group of only such rows keeps one of
them with a null ``keep_id``; of repeated rows (equal text and id) one is kept;
an empty table gives an empty result; columns other than the id and the text
are ignored, or kept where rows are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import arrow_schema, release, struct_of, unused
from .storage import saved

#: Characters of the text in the sort key before its hash.  They only set the
#: order; equality is decided on whole texts.
PREFIX = 64

#: Rows that are put out at once.
ROWS_AT_ONCE = 10_000

_RUNS = struct_of(
    "id long, keep_id long, group_size long, kept boolean, text_sha256 string,"
    " run long, run_text string"
)


class _Run:
    """Equal neighbouring texts within one partition."""

    __slots__ = ("ids", "number", "text")

    def __init__(self, text: str, number: int):
        self.text, self.number, self.ids = text, number, []


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn one sorted partition into rows with their run's keeper and size.

    The runs under the current hash wait in memory as their ids and one text;
    a partition's first and last hash give boundary runs.
    """
    schema = arrow_schema(_RUNS)
    base = TaskContext.get().partitionId() << 40
    waiting: list[_Run] = []
    key = first_key = None
    number = 0
    out: list[list] = [[] for _ in schema]

    def settle(boundary: bool) -> Iterator[pa.RecordBatch]:
        """Put out the waiting runs, never more than ``ROWS_AT_ONCE`` rows at a time."""
        for run in waiting:
            sha = hashlib.sha256(run.text.encode()).hexdigest()
            tag = base | run.number if boundary else None
            for at in range(0, len(run.ids), ROWS_AT_ONCE):
                ids = run.ids[at : at + ROWS_AT_ONCE]
                n = len(ids)
                out[0].extend(ids)
                out[1].extend([run.ids[0]] * n)
                out[2].extend([len(run.ids)] * n)
                out[3].extend([i == 0 for i in range(at, at + n)])
                out[4].extend([sha] * n)
                out[5].extend([tag] * n)
                out[6].extend([run.text if boundary and i == 0 else None for i in range(at, at + n)])
                if len(out[0]) >= ROWS_AT_ONCE:
                    yield flush()
        waiting.clear()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema
        )
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        release()
        for ident, text, h in zip(
            batch.column("id").to_pylist(),
            batch.column("text").to_pylist(),
            batch.column("h").to_pylist(),
        ):
            if h != key:
                if waiting:
                    yield from settle(boundary=key == first_key)
                if first_key is None:
                    first_key = h
                key = h
            if not waiting or waiting[-1].text != text:
                waiting.append(_Run(text, number))
                number += 1
            waiting[-1].ids.append(ident)
    yield from settle(boundary=True)
    if out[0]:
        yield flush()


def _leads_of(text_col: str, hash_col: str, edge_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first row of each run of a sorted partition, all columns kept.

    Rows are marked whose hash is the partition's first or last one, since
    their run may go on in another partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key = text = None
        waiting: list[pa.RecordBatch] = []  # leads under the current hash

        def marked(rows: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
            at = rows.schema.get_field_index(hash_col)
            kept = [i for i in range(rows.num_columns) if i != at]
            return pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in kept), pa.array([edge] * rows.num_rows, pa.bool_())],
                names=[*(rows.schema.names[i] for i in kept), edge_col],
            )

        for batch in batches:
            release()
            hashes = batch.column(hash_col).to_pylist()
            leads = []
            for i, (h, t) in enumerate(zip(hashes, batch.column(text_col).to_pylist())):
                t = t or ""
                if h != key or t != text:
                    leads.append(i)
                    first = h if first is None else first
                key, text = h, t
            moved = [w for w in waiting if w.column(hash_col)[0].as_py() != key]
            waiting = [w for w in waiting if w.column(hash_col)[0].as_py() == key]
            for rows in moved:
                yield marked(rows, False)
            for edge, chosen in (
                (True, [i for i in leads if hashes[i] == first]),
                (False, [i for i in leads if hashes[i] not in (first, key)]),
            ):
                if chosen:
                    yield marked(batch.take(pa.array(chosen)), edge)
            held = [i for i in leads if hashes[i] == key and key != first]
            if held:
                waiting.append(batch.take(pa.array(held)))
        for rows in waiting:
            yield marked(rows, True)

    return work


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min"
) -> DataFrame:
    """``docs`` with one row of each group of equal texts (null: empty), all
    columns kept: the content sort itself carries the rows, and only the runs at
    partition ends, a few rows for each partition, are compared once more."""
    order = F.desc_nulls_last if keep == "max" else F.asc_nulls_last
    text = F.coalesce(F.col(text_col), F.lit(""))
    hash_col, own_id, edge = (unused(f"__docmill_{x}", docs.columns) for x in ("hash", "id", "edge"))
    keyed = docs.withColumns({hash_col: F.xxhash64(text), own_id: F.col(id_col).cast("long")})
    key = (F.substring(text, 1, PREFIX), F.col(hash_col))
    ordered = keyed.repartitionByRange(*key, order(own_id)).sortWithinPartitions(*key, text, order(own_id))
    schema = T.StructType(
        [f for f in keyed.schema.fields if f.name != hash_col] + [T.StructField(edge, T.BooleanType())]
    )
    leads = saved(ordered.mapInArrow(_leads_of(text_col, hash_col, edge), schema), "content-sort")
    first = Window.partitionBy(text).orderBy(order(own_id))
    edges = leads.filter(F.col(edge)).withColumn(hash_col, F.row_number().over(first)).filter(F.col(hash_col) == 1)
    return leads.filter(~F.col(edge)).unionByName(edges.drop(hash_col)).drop(edge, own_id)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Per row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep`` names the id that stays in each group, "min" or "max".
    ``normalise`` maps the text column to what is compared; by default texts
    must be identical as they stand.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    order = F.desc_nulls_last if keep == "max" else F.asc_nulls_last
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select(
        "id", "text", F.xxhash64("text").alias("h"), F.substring("text", 1, PREFIX).alias("p")
    )
    ordered = keyed.repartitionByRange("p", "h", order("id")).sortWithinPartitions(
        "p", "h", "text", order("id")
    )
    runs = saved(
        ordered.select("id", "text", "h").mapInArrow(_compare_neighbours, _RUNS), "content-sort"
    )

    group = Window.partitionBy("run_text")
    first = group.orderBy(order("keep_id"), "run")
    merged = (
        runs.filter(F.col("run_text").isNotNull())
        .select(
            "run",
            F.first("keep_id").over(first).alias("m_keep"),
            F.sum("group_size").over(group).alias("m_size"),
            (F.row_number().over(first) == 1).alias("m_first"),
        )
    )
    # A partition has two boundary runs (more only where 64-bit hashes clash),
    # so this side holds a few rows for each partition at any input size.
    joined = runs.drop("run_text").join(F.broadcast(merged), "run", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("m_size").isNull(), F.col("keep_id")).otherwise(F.col("m_keep")).alias("keep_id"),
        F.coalesce("m_size", "group_size").alias("group_size"),
        (F.col("kept") & F.coalesce("m_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )
