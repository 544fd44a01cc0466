"""Top-k search by inverted lists, for many queries at once (an addition of ours,
like ``store.nearest``).

``build_index`` trains centroids on a bounded sample and stores every vector in
the list of its nearest centroid; lists are partitions of a Parquet table.  Beside
the vector a row has a code: what the vector, scaled to length one, differs by from
the centroid, in whole numbers of one byte, with the length of what the code leaves out.

``search_index`` asks the lists nearest to each query, ``probes`` of them, so files
of other lists aren't read.  Codes alone decide on candidates: with the length left
out they bound a similarity from both sides, so none of the ``k`` best of the asked
lists is lost.  Then the candidates' own vectors decide.  With as many probes as
there are lists the answer is that of a full comparison.

A list is searched in blocks of about ``BLOCK_ROWS`` rows, so a list of any size is
shared out, and each block's queries are worked on some at a time.  The driver
holds the sample, the centroids and the lists' sizes.

Vectors that are null, without length or of another size than most of the sample
aren't indexed, and such queries have no answer; of queries of equal id one is
answered; equal similarities go to the smaller id; rows of equal id are found
each; an empty table gives an index in which
nothing is found.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine_similarity

SAMPLE_ROWS = 50_000
MOST_LISTS = 16_384
ITERATIONS = 10
BLOCK_ROWS = 50_000

#: Queries compared with a block at once.
QUERY_ROWS = 512

#: Probed lists up to which the scan is told their names.
NAMED_LISTS = 2_000


def _units(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors are fit, and these scaled to length one."""
    fit = np.array([v is not None and len(v) == size and None not in v for v in vectors], bool)
    rows = np.array([v for v, ok in zip(vectors, fit) if ok], np.float64).reshape(-1, size)
    length = np.sqrt((rows * rows).sum(1))
    good = np.isfinite(length) & (length > 0)
    fit[np.flatnonzero(fit)[~good]] = False
    return fit, rows[good] / length[good, None]


def train_centroids(rows: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Directions around which the rows, of length one, are grouped: Lloyd's steps
    from rows far from each other; a group that runs empty takes the row that fits
    its own worst."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(lists, len(rows)):
        weight = np.maximum(1 - near, 0)
        at = int(rng.choice(len(rows), p=weight / weight.sum())) if weight.sum() > 1e-9 else int(rng.integers(len(rows)))
        chosen.append(at)
        near = np.maximum(near, rows @ rows[at])
    centroids = rows[chosen].copy()
    for _ in range(ITERATIONS):
        similarity = rows @ centroids.T
        own = similarity.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        length = np.sqrt((sums * sums).sum(1))
        worst = np.argsort(similarity.max(1))
        for k, lost in enumerate(np.flatnonzero(length < 1e-9)):
            sums[lost], length[lost] = rows[worst[k % len(rows)]], 1.0
        centroids = sums / length[:, None]
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder: centroids, and each list's number of blocks."""

    path: str
    size: int
    centroids: np.ndarray
    blocks: np.ndarray


def build_index(
    vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None
) -> VectorIndex:
    """Store the index of a table's vectors under ``path``; without ``lists``
    there are about as many as the square root of the rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    n = rows.count()
    # Rows under a hash that twice as many as wanted lie under; the smallest of them.
    near = rows.withColumn("h", F.xxhash64("id"))
    share = (2.0 * SAMPLE_ROWS + 100) / max(n, 1)
    if share < 1:
        near = near.filter(F.col("h").cast("double") < share * 2.0**64 - 2.0**63)
    sample = near.orderBy("h", "id").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].to_pylist()
    sizes = Counter(len(v) for v in sample if v is not None)
    size = sizes.most_common(1)[0][0] if sizes else 1
    units = _units(sample, size)[1]
    lists = min(lists or int(max(n, 1) ** 0.5) or 1, MOST_LISTS, max(len(units), 1))
    centroids = train_centroids(units, lists) if len(units) else np.zeros((1, size))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, unit = _units(batch.column("vector").to_pylist(), size)
            own = (unit @ centroids.T).argmax(1).astype(np.int32) if len(unit) else np.zeros(0, np.int32)
            rest = unit - centroids[own]
            scale = np.maximum(np.abs(rest).max(1, initial=0) / 127, 1e-12).astype(np.float32)
            codes = np.clip(np.round(rest / scale[:, None]), -127, 127).astype(np.int8)
            left = rest - codes.astype(np.float64) * scale[:, None]
            missed = (np.sqrt((left * left).sum(1)) + 1e-6).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own),
                    batch.column("id").filter(pa.array(fit)),
                    batch.column("vector").filter(pa.array(fit)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(scale),
                    pa.array(missed),
                ],
                names=["list", "id", "vector", "code", "scale", "missed"],
            )

    vector = rows.schema["vector"].dataType.simpleString()
    kind = f"list int, id long, vector {vector}, code binary, scale float, missed float"
    made = rows.mapInArrow(assign, kind)
    made.select("list").groupBy("list").count().write.parquet(f"{path}/sizes")
    counted = {r["list"]: r["count"] for r in spark.read.parquet(f"{path}/sizes").collect()}
    blocks = np.array([-(-counted.get(k, 0) // BLOCK_ROWS) for k in range(len(centroids))])
    many = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1) if blocks.max() > 1 else F.lit(1)
    placed = made.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int"))
    placed.repartition("list", "block").write.partitionBy("list").parquet(f"{path}/lists")
    meta = json.dumps({"size": size, "centroids": centroids.tolist(), "blocks": blocks.tolist()})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
    return VectorIndex(path, size, centroids, blocks)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return VectorIndex(path, meta["size"], np.array(meta["centroids"]), np.array(meta["blocks"]))


def _asked(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """(query, list, block, q): each query for each block of its nearest lists."""
    size, centroids, blocks = index.size, index.centroids, index.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, unit = _units(batch.column("vector").to_pylist(), size)
            ids = batch.column("query").filter(pa.array(fit)).to_pylist()
            nearest = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes]
            out = [
                (query, int(k), b, q)
                for query, own, q in zip(ids, nearest, unit.tolist())
                for k in own
                for b in range(int(blocks[k]))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())))],
                names=["query", "list", "block", "q"],
            )

    return queries.mapInArrow(run, "query long, list int, block int, q array<double>")


def _candidates(centroids: np.ndarray, k: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(query, list, id) of a block's rows that may be among a query's best."""
    found: list[pd.DataFrame] = []
    if len(left) and len(right):
        own = int(right["list"].iloc[0])
        codes = np.frombuffer(b"".join(right["code"]), np.int8).reshape(len(right), -1)
        rows = centroids[own] + codes * right["scale"].to_numpy(np.float64)[:, None]
        missed, ids = right["missed"].to_numpy(np.float64), right["id"].to_numpy()
        for at in range(0, len(left), QUERY_ROWS):
            part = left.iloc[at : at + QUERY_ROWS]
            near = np.array(part["q"].tolist()) @ rows.T
            low = near - missed
            bound = np.partition(low, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(part), -np.inf)
            which, row = np.nonzero(near + missed >= bound[:, None])
            found.append(pd.DataFrame({"query": part["query"].to_numpy()[which], "list": own, "id": ids[row]}))
    return pd.concat(found) if found else pd.DataFrame({"query": [], "list": [], "id": []}).astype("int64")


def search_index(
    queries: DataFrame, index: VectorIndex, k: int = 10, probes: int = 8, query_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query, id, similarity, place): the ``k`` rows most similar to each query
    among those of the ``probes`` lists nearest to it."""
    spark = queries.sparkSession
    plain = queries.select(F.col(query_col).cast("long").alias("query"), F.col(vector_col).alias("vector"))
    asked = _asked(plain, index, min(probes, len(index.centroids)))
    if not index.blocks.any():  # an index without rows
        return spark.createDataFrame([], "query long, id long, similarity double, place int")
    table = spark.read.parquet(f"{index.path}/lists")
    if probes < len(index.centroids):
        named = [r["list"] for r in asked.select("list").distinct().limit(NAMED_LISTS + 1).collect()]
        if len(named) <= NAMED_LISTS:
            table = table.filter(F.col("list").isin(named))
    codes = table.select("list", "block", "id", "code", "scale", "missed")
    found = (
        asked.groupBy("list", "block")
        .cogroup(codes.groupBy("list", "block"))
        .applyInPandas(partial(_candidates, index.centroids, k), "query long, list int, id long")
    )
    whole = found.distinct().join(table.select("list", "id", "vector"), ["list", "id"])
    wanted = plain.dropDuplicates(["query"]).select("query", F.col("vector").alias("q"))
    cosine = cosine_similarity(F.col("q"), F.col("vector"))
    scored = whole.join(wanted, "query").select("query", "id", cosine.alias("similarity"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("place", best).filter(F.col("place") <= k)
