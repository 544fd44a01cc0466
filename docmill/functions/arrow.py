"""Python functions of one column, with memory bounded by slices of a batch.

Spark sends up to 10,000 rows in an Arrow batch, and a function that is called
for each row by Spark holds all of them as Python values, with all its results.
Here a batch is worked on in slices, of which only one is in Python values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of a slice; a longer row is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 64, 2 << 20


def slices(batch: pa.Array, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in pieces of at most ``rows`` values and about ``most`` bytes."""
    at = 0
    while at < len(batch):
        n = rows
        while n > 1 and batch.slice(at, n).nbytes > most:
            n //= 2
        yield batch.slice(at, n)
        at += n


def row_function(work: Callable[[Any], Any], kind: T.DataType) -> Callable:
    """A Spark function that gives ``work`` of each value; null stays null.
    Maps among the results are lists of pairs."""
    made = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # Workers live on between tasks and share an executor's memory.
            pa.default_memory_pool().release_unused()
            for piece in slices(batch):
                yield pa.array([None if v is None else work(v) for v in piece.to_pylist()], made)

    return run
