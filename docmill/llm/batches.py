"""Arrow plumbing shared by the operators that work on one document at a time.

Every helper keeps memory bounded by one Arrow batch: a batch is turned into
Python values, worked on and dropped before the next is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
}


_SPARK = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
}


def struct_of(columns: str) -> T.StructType:
    """A schema from "name type, ..." (flat types and ``array<type>``), read
    without a session so that modules can hold it."""
    fields = []
    for column in columns.split(","):
        name, kind = column.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        of = _SPARK[inner]
        fields.append(T.StructField(name, of if inner == kind else T.ArrayType(of)))
    return T.StructType(fields)


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type Spark expects for a column of ``kind``."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return _ARROW[kind.simpleString()]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, arrow_type(f.dataType)) for f in schema.fields])


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    ddl: str,
    rows_at_once: int = 2048,
) -> DataFrame:
    """Run ``make()(batch)`` over every Arrow batch of ``df``, in slices of
    ``rows_at_once`` rows.

    ``make`` is called once in each task, so whatever it loads (vocabularies,
    automata, models) is loaded there.  The function that it returns gives one
    list or array per column of ``ddl``.
    """
    schema = struct_of(ddl)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            release()
            if work is None:
                work = make()
            for at in range(0, batch.num_rows, rows_at_once):
                columns = work(batch.slice(at, rows_at_once))
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                        for c, f in zip(columns, arrow)
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give back what Arrow keeps of memory that it no longer uses; workers live
    on between tasks, and two of them share an executor's memory."""
    pa.default_memory_pool().release_unused()


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a string column; null counts as empty."""
    return [s or "" for s in batch.column(name).to_pylist()]


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as it takes to differ from all
    ``columns`` (names are compared as Spark does, whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
