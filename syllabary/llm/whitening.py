"""Embedding whitening by polarisation covariance.

Vectors are made of integers, and every distinct one is fitted once. Of each dimension, and of the sum of each pair of dimensions,
one number is aggregated: the exact sum of the squared centred values, in integers of any length, centred as n * x - S so that no
division comes before the end. A pair's covariance is half of what the variance of the sum has over the two variances. The
driver assembles these width * (width + 1) / 2 numbers into the covariance matrix, and ``eigh`` of it gives the components.

Spark drops the repeats (by a shuffle that combines equal vectors before it), sums a row for each dimension or pair and task, and
projects the rows where they lie. No task and no driver holds more than a batch of vectors and the matrix.

Rows whose vector is null or holds null or non-finite entries take no part; entries are floor(scale * c), c as double, and from
``LARGE`` on (in size) an error. Rows that repeat, share an id or have a null id each get their results. Vectors of different
lengths are fitted apart, each length by itself; empty vectors have no components. A component whose eigenvalue is zero (to double
precision, as with fewer distinct vectors than dimensions) has a null ``whitened``, and takes no part in ``identity_error``, which
is null if there is no other; ``explained`` is null where the trace is zero. ``deviation`` is exact while it fits into a long and
the largest long beyond; ``deviation_exact`` has all digits. An empty table gives no rows. Columns besides the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.llm.common import Scratch

LARGE = 1 << 46
#: Vectors that a task looks at together.
ROWS = 2048
_MASK31, _MASK32, _LONGEST = (1 << 31) - 1, (1 << 32) - 1, (1 << 63) - 1
_SQUARES = "a int, b int, total decimal(38,0)"
_SQUARES_ARROW = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("total", pa.decimal128(38, 0))])
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_exact decimal(38,0)"
_OUT_ARROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("deviation_exact", pa.decimal128(38, 0))])


def exact_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of a matrix of longs or Python integers."""
    if x.dtype == object:
        return [int(v) for v in x.sum(0)]
    return [(int(a) << 32) + int(b) for a, b in zip((x >> 32).sum(0), (x & _MASK32).sum(0), strict=True)]


def square_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the squares of the columns."""
    if x.dtype == object:
        return exact_sums(x * x)
    most = int(np.abs(x).max(initial=0))
    if most * most * max(len(x), 1) < _LONGEST:
        return [int(v) for v in np.einsum("ij,ij->j", x, x)]
    if most < 1 << 31:
        return exact_sums(x * x)
    high, low = x >> 31, x & _MASK31
    return [(a << 62) + (b << 32) + c for a, b, c in zip(exact_sums(high * high), exact_sums(high * low), exact_sums(low * low), strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in longs where sums of two of them fit, else in Python integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    return x * n - np.array(sums, np.int64) if most < 1 << 60 else x.astype(object) * n - np.array(sums, object)


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            some = batch.slice(start, ROWS)
            yield some, some.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), width)


def _rows(found: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)] + [pa.array([Decimal(found[k]) for k in keys], pa.decimal128(38, 0))], schema=_SQUARES_ARROW)


def _sum(width: int):
    """Vectors to (dimension, 0, sum), and (width, 0, number of vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for _, x in _matrices(batches, 0, width):
            total = [a + b for a, b in zip(total, [*exact_sums(x), len(x)], strict=True)]
        yield _rows({(i, 0): v for i, v in enumerate(total)})

    return run


def _square(width: int, n: int, sums: list[int]):
    """Vectors to the sums of squared centred values of each dimension (a, a) and of each pair's sum (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(a, b): 0 for a in range(width) for b in range(a, width)}
        for _, x in _matrices(batches, 0, width):
            z = centred(x, n, sums)
            for a in range(width):
                own = [*square_sums(z[:, a : a + 1]), *square_sums(z[:, a : a + 1] + z[:, a + 1 :])]
                for b, v in enumerate(own, a):
                    total[a, b] += v
        yield _rows(total)

    return run


def _summed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """The totals of each key: width * (width + 1) / 2 at most."""
    return {(r["a"], r["b"]): int(r["total"]) for r in rows.groupBy("a", "b").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}


def covariance(squares: dict[tuple[int, int], int], width: int, n: int) -> np.ndarray:
    """The covariance matrix of the vectors, by polarisation; each entry is rounded once."""
    out = np.empty((width, width))
    for a in range(width):
        for b in range(a, width):
            cross = 2 * squares[a, a] if a == b else squares[a, b] - squares[a, a] - squares[b, b]
            out[a, b] = out[b, a] = float(Fraction(cross, 2 * n**3))
    return out


def components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) by falling eigenvalue, ``most`` of them; the largest entry of each is positive.
    Eigenvalues that are zero to double precision are zero."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:most], vectors.T[::-1][:most]
    values = np.where(values > len(matrix) * np.finfo(float).eps * max(values.max(initial=0), 0), values, 0.0)
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]


def _projections(z: np.ndarray, n: int, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The centred vectors on each component, over the root of its eigenvalue; nan where that is zero."""
    with np.errstate(divide="ignore"):
        scaled = vectors.T / np.sqrt(np.where(values > 0, values, np.nan))
    return (z / n).astype(np.float64) @ scaled


def _project(width: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _matrices(batches, 1, width):
            z, k = centred(x, n, sums), len(values)
            white = _projections(z, n, values, vectors).ravel()
            away, each = square_sums(z.T), pa.array(np.repeat(np.arange(len(some)), k))
            columns = [
                some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))), pa.array(np.full(len(each), n)), pa.array([min(v, _LONGEST) for v in away], pa.int64()).take(each),
                pa.array(white, from_pandas=True), pa.array(np.tile(explained, len(some)), from_pandas=True), pa.array(map(Decimal, away), pa.decimal128(38, 0)).take(each),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT_ARROW)

    return run


def _moments(width: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    """Vectors to the sums of their projections and of the products of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        total = np.zeros(k + k * k)
        for _, x in _matrices(batches, 0, width):
            white = _projections(centred(x, n, sums), n, values, vectors)
            total += np.concatenate([white.sum(0), (white.T @ white).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "total"])

    return run


def whiten(rows: DataFrame, most: int = 4, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` (and ``deviation_exact``) of each row, for its first
    ``most`` components."""
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    small = F.when(F.forall(values, lambda v: F.abs(v * scale) < LARGE), values).otherwise(F.raise_error(F.lit(f"an entry is {LARGE} or more")).cast("array<double>"))
    fit = rows.filter(F.col(vector).isNotNull() & finite & (F.size(vector) > 0))
    whole = fit.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(small, lambda v: F.floor(v * scale)).alias("x"))
    distinct = scratch.keep(whole.select("x").distinct(), "distinct")
    lengths = sorted(r["width"] for r in distinct.select(F.size("x").alias("width")).distinct().collect())  # lengths of vectors: few
    parts, errors = [], []
    for width in lengths:
        own = distinct.filter(F.size("x") == width)
        found = _summed(own.mapInArrow(_sum(width), _SQUARES))
        sums, n = [found[i, 0] for i in range(width)], found[width, 0]
        matrix = covariance(_summed(own.mapInArrow(_square(width, n, sums), _SQUARES)), width, n)
        eigenvalues, vectors = components(matrix, most)
        moments = own.mapInArrow(_moments(width, n, sums, eigenvalues, vectors), "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
        total = np.array([r["total"] for r in moments.orderBy("place").collect()]) / n  # most * (most + 1) numbers
        k = len(eigenvalues)
        off = total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)
        errors.append(np.abs(off[np.ix_(eigenvalues > 0, eigenvalues > 0)]).max(initial=-1))
        parts.append(whole.filter(F.size("x") == width).mapInArrow(_project(width, n, sums, eigenvalues, vectors, float(np.trace(matrix))), _OUT))
    error = max(errors, default=-1.0)
    out = spark.createDataFrame([], _OUT) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    names = [x.split()[0] for x in _OUT.split(", ")]
    return out.withColumn("identity_error", F.lit(float(error) if error >= 0 else None).cast("double")).select(*names[:-1], "identity_error", names[-1])
