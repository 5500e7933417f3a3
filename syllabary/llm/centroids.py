"""Centroid clustering with an incremental distance matrix.

Every vector is a row of a table in the shared folder that keeps its exact integer dot product with every centroid. When centroids
move, a dot product changes by the vector's components at the places where that centroid has changed, times the changes; nothing
else is multiplied again. Squared distances come from the dot products and the two norms, the nearest centroid is their argmin.
The sums that make the next centroids are kept as well: only vectors that changed their cluster are added and taken away.

A round is one pass over the table and one small aggregate: a task's partial sums are a row for each cluster and component, so k
times the dimension of them meet, whatever the input, and the driver holds the centroids alone. Each state is written, so a lost
executor costs its own tasks; the state before it is deleted.

Vectors that are null, hold null or non-finite components or have another length take no part. Components are floor(scale * x), x
as double; from ``LARGE`` on (in size) they are an error, as squared distances would not fit into a long. Every row is clustered,
those with one id, equal vectors and null ids too. Seeds are the vectors with the smallest hashes of their ids, equal hashes by
their components, null ids last; with fewer vectors than k there are as many centroids as vectors. Ties go to the smaller number;
an empty cluster keeps its centroid. An empty table gives no rows. Columns besides the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabary.llm.common import Scratch

#: From here on a component is too large: with 2^26 in 64 dimensions a squared distance stays under 2^60.
LARGE = 1 << 26

_STATE = "vec_id long, x array<int>, dots array<long>, before int, cluster int, distance long"
_STATE_ARROW = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("dots", pa.list_(pa.int64())), ("before", pa.int32()), ("cluster", pa.int32()), ("distance", pa.int64())])
_SUMS = "cluster int, place int, total long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(matrix.ravel()).cast(kind))


def moved_dots(x: np.ndarray, dots: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """Dot products after the centroids have changed by ``changes`` (a row a centroid): only nonzero changes are multiplied."""
    out = dots.copy()
    for centroid, change in enumerate(changes):
        at = np.flatnonzero(change)
        if len(at):
            out[:, centroid] += x[:, at] @ change[at]
    return out


def _assigned(x: np.ndarray, dots: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector from its dot products and the centroids' squared norms."""
    away = norms[None, :] - 2 * dots  # the vector's own norm is the same for all
    nearest = away.argmin(1)
    return nearest.astype(np.int32), (x * x).sum(1) + away[np.arange(len(x)), nearest]


def _advance(changes: np.ndarray, centroids: np.ndarray, first: bool):
    """States (or vectors, the ``first`` time, whose centroids change from nothing) to the states under ``centroids``."""
    k, width = centroids.shape
    norms = (centroids * centroids).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            dots = np.zeros((len(x), k), np.int64) if first else _matrix(batch.column(2), k)
            before = pa.array(np.full(len(x), -1, np.int32)) if first else batch.column(3)
            dots = moved_dots(x, dots, changes)
            cluster, distance = _assigned(x, dots, norms)
            columns = [batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), _lists(dots, pa.int64()), before, pa.array(cluster), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, schema=_STATE_ARROW)

    return run


def _sums(k: int, width: int):
    """Rows (x, before, cluster) that changed their cluster to what that changes in the clusters' sums; the last place is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            x = np.concatenate([_matrix(batch.column(0), width), np.ones((len(batch), 1), np.int64)], axis=1)
            for sign, column in ((-1, 1), (1, 2)):
                own = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(own[own >= 0]):
                    total[c] += sign * x[own == c].sum(0)
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[cluster, place])], names=["cluster", "place", "total"])

    return run


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, salt: str = "1:", id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector after ``rounds`` updates."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "centroids")
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    small = F.when(F.forall(values, lambda v: F.abs(v * scale) < LARGE), values).otherwise(F.raise_error(F.lit(f"a component is {LARGE} or more")).cast("array<double>"))
    whole = F.transform(small, lambda v: F.floor(v * scale).cast("int"))
    fit = rows.filter((F.size(vector) == width) & finite).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("x"))
    table = scratch.keep(fit, "vectors")
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = table.select(hashed.alias("hash"), "x").orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).collect()  # k rows
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], out)
    centroids, totals = np.array([r["x"] for r in seeds], np.int64), np.zeros((len(seeds), width + 1), object)
    state = scratch.keep(table.mapInArrow(_advance(centroids, centroids, True), _STATE), "state-0")
    scratch.drop("vectors")
    for number in range(1, rounds + 1):
        changed = state.filter("before <> cluster").select("x", "before", "cluster").mapInArrow(_sums(len(centroids), width), _SUMS)
        for r in changed.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():  # k times the width
            totals[r["cluster"], r["place"]] += int(r["total"])
        moved = centroids.copy()
        for c in range(len(centroids)):
            if totals[c, width]:
                moved[c] = [s // totals[c, width] for s in totals[c, :width]]
        changes, centroids = moved - centroids, moved
        if not changes.any():
            break
        rest = state.withColumn("before", F.col("cluster"))
        state = scratch.keep(rest.mapInArrow(_advance(changes, centroids, False), _STATE), f"state-{number}")
        scratch.drop(f"state-{number - 1}")
    inertia = {r["cluster"]: int(r["total"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, n, sum(inertia.values()), shas[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(*[x.split()[0] for x in out.split(", ")])  # k rows
