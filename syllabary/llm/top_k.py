"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

Rows are packed where they lie: every ``SHARD`` vectors of a task become one row with their ball tree, every ``BLOCK`` queries one
row. Each block of queries meets each shard once; blocks have numbers of their own, and only those meet the shards before the
vectors travel. The shards are dealt into groups, and a task takes the shards of a (block,
group) one after the other while it holds the block's best scores so far, so that the kth score found in one shard prunes the
next. In a shard, a node is bounded by centre and radius: q.c + |q| r; leaves are opened in the order of their bounds, and a query
is done with a shard when its next bound lies under its kth score. The best of all groups then meet, k rows of each a query.

Nothing is broadcast, no task holds more than one block and one shard, and results do not depend on how rows are dealt.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part; a vector is compared with
those of its own length; rows that share the query's id are its own; equal scores go to the smaller id, equal rows are each
candidates. Scores are exact, whatever the components: vectors with a component of ``LARGE`` or more lie in shards and blocks of
their own, which are searched without a tree in integers of any length; ranks are those of the exact scores, and a score beyond
64 bits is given as the nearest long. Columns besides the two named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabary.llm.common import Scratch

SHARD, BLOCK, LEAF = 4096, 2048, 64
#: From here on a component of the integer vectors is large.
LARGE = 1 << 40
_LOW, _HIGH = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)
#: No score, among integers of any length; among those of 64 bits it is ``_LOW``.
_NONE = float("-inf")


def integers(components: list[float]) -> list[int]:
    """floor(256 x) of each component."""
    return [math.floor(256.0 * x) if abs(x) < 1 << 53 else 256 * int(x) for x in components]


def sortable(x: int) -> str:
    """A string that stands among those of other integers as the integer does."""
    digits = str(abs(x))
    return f"1{len(digits):04d}{digits}" if x >= 0 else f"0{9999 - len(digits):04d}" + digits.translate(_NINES)


_NINES = str.maketrans("0123456789", "9876543210")
_PACKED = pa.schema([("dim", pa.int32()), ("large", pa.bool_()), ("number", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("nodes", pa.binary())])
_PACKED_DDL = "dim int, large boolean, number long, ids binary, vectors binary, nodes binary"
_FOUND = "dim int, block long, place int, query_id long, vec_id long, score long, exact string"


def ball_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes); a node is (first row, end, left child or -1 for a leaf, right child, radius, centre...)."""
    order, nodes = np.arange(len(vectors)), []
    open_nodes = [(0, len(vectors), -1, 0)]
    points = vectors.astype(np.float64)
    while open_nodes:
        low, high, parent, side = open_nodes.pop()
        own = points[order[low:high]]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        at = len(nodes)
        nodes.append([low, high, -1, -1, away.max(), *centre])
        if parent >= 0:
            nodes[parent][2 + side] = at
        if high - low > LEAF:
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            rank = np.argsort(own @ (other - far), kind="stable")
            order[low:high] = order[low:high][rank]
            middle = (low + high) // 2
            open_nodes += [(low, middle, at, 0), (middle, high, at, 1)]
    return order, np.array(nodes)


class Best:
    """The best k of a block of queries so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.points = vectors.astype(np.float64)
        self.norms = np.sqrt((self.points**2).sum(1))
        self.scores = np.full((len(ids), k), _LOW)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def search(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray) -> None:
        """Branch and bound over one shard's tree; every row of a shard without one."""
        if not len(nodes) or self.vectors.dtype == object:
            mine, theirs = self.vectors.astype(object), vectors.astype(object)
            for row in range(len(self.ids)):
                self._merge(np.array([row]), (mine[row : row + 1] @ theirs.T), ids)
            return
        low, high, left, right = (nodes[:, i].astype(np.int64) for i in range(4))
        bounds = self.points @ nodes[:, 5:].T + self.norms[:, None] * nodes[:, 4]
        bounds += 1e-9 * (1 + np.abs(bounds)) + 1e-9 * self.norms[:, None] * (1 + np.abs(nodes[:, 5:]).max(initial=0))
        for at in np.flatnonzero(left >= 0):  # parents come before their children
            for child in (left[at], right[at]):
                bounds[:, child] = np.minimum(bounds[:, child], bounds[:, at])
        leaves = np.flatnonzero(left < 0)
        bounds = bounds[:, leaves]
        ranks = np.argsort(-bounds, axis=1, kind="stable")
        most = float(np.abs(vectors).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(vectors.shape[1], 1)
        kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
        mine, points = self.vectors.astype(kind), vectors.astype(kind)
        active = np.arange(len(self.ids))
        for step in range(len(leaves)):
            leaf = ranks[active, step]
            go = bounds[active, leaf] >= self.scores[active, -1]
            active, leaf = active[go], leaf[go]
            if not len(active):
                return
            for one in np.unique(leaf):
                rows = active[leaf == one]
                a, b = low[leaves[one]], high[leaves[one]]
                self._merge(rows, mine[rows] @ points[a:b].T, ids[a:b])

    def _merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.dtype == object or self.scores.dtype == object:
            if self.scores.dtype != object:
                self.scores = np.where(self.scores == _LOW, _NONE, self.scores.astype(object))
            for row, found in zip(rows.tolist(), scores.tolist(), strict=True):
                held = [*zip(self.scores[row], self.found[row].tolist(), strict=True), *((int(x), i) for x, i in zip(found, ids.tolist(), strict=True) if i != self.ids[row])]
                for place, (score, one) in enumerate(sorted(held, key=lambda x: (-x[0], x[1]))[: self.k]):
                    self.scores[row, place], self.found[row, place] = score, one
            return
        own = ids[None, :] == self.ids[rows][:, None]
        scores = np.where(own, _LOW, scores.astype(np.int64))
        named = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        named = np.concatenate([self.found[rows], named], axis=1)
        # ~x turns the order of integers round without overflow.
        order = np.lexsort((named, ~scores), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(named, order, 1)

    def best(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(row of the query, id, score) of everything found."""
        rows, places = np.nonzero(self.scores != (_NONE if self.scores.dtype == object else _LOW))
        return rows, self.found[rows, places], [int(x) for x in self.scores[rows, places]]


def _unpacked(large: bool, vectors: bytes, n: int, dim: int) -> np.ndarray:
    if not large:
        return np.frombuffer(vectors, np.int64).reshape(n, dim)
    out = np.empty((n, dim), object)
    for i, row in enumerate(np.frombuffer(vectors).reshape(n, dim).tolist()):
        out[i] = integers(row)
    return out


def _packer(size: int, tree: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[int, list]]] = {}
        task, made = TaskContext.get().partitionId(), 0

        def packed(key: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal made
            rows, (dim, large) = held.pop(key), key
            ids = np.array([r[0] for r in rows], np.int64)
            vectors, nodes = np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim), b""
            if not large:
                vectors = np.floor(256.0 * vectors).astype(np.int64)
            if tree and not large:
                order, found = ball_tree(vectors)
                ids, vectors, nodes = ids[order], vectors[order], found.tobytes()
            made += 1
            return pa.RecordBatch.from_pylist([{"dim": dim, "large": large, "number": (task << 32) + made, "ids": ids.tobytes(), "vectors": vectors.tobytes(), "nodes": nodes}], _PACKED)

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = len(vector), any(abs(x) >= LARGE >> 8 for x in vector)
                held.setdefault(key, []).append((vec_id, vector))
                if len(held[key]) >= size:
                    yield packed(key)
        for key in list(held):
            yield packed(key)

    return run


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key = None, None

        def out() -> pa.RecordBatch:
            rows, ids, scores = best.best()
            n = len(rows)
            longs = [min(max(x, _LOW), _HIGH) for x in scores]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0], np.int32)), pa.array(np.full(n, key[1], np.int64)), pa.array(rows.astype(np.int32)), pa.array(best.ids[rows]), pa.array(ids), pa.array(longs, pa.int64()), pa.array(map(sortable, scores), pa.string())], names=[x.split()[0] for x in _FOUND.split(", ")])

        for batch in batches:
            for i in range(len(batch)):
                dim, block, group, shard, large, ids, vectors, nodes = (x[0] for x in batch.slice(i, 1).to_pydict().values())
                ids = np.frombuffer(ids, np.int64)
                vectors = _unpacked(large, vectors, len(ids), dim)
                if shard is None:  # the block of queries stands before its shards
                    if best is not None:
                        yield out()
                    best, key = Best(ids, vectors, k), (dim, block, group)
                elif key == (dim, block, group):
                    best.search(ids, vectors, np.frombuffer(nodes).reshape(-1, 5 + dim))
        if best is not None:
            yield out()

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each row where ``is_query``, on integers floor(256 x)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "top-k")
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = rows.filter(F.col(id_column).isNotNull() & values.isNotNull() & finite)
    columns = F.col(id_column).cast("long").alias("id"), values.alias("v")
    shards = scratch.keep(fit.select(*columns).mapInArrow(_packer(SHARD, tree=True), _PACKED_DDL), "shards")
    blocks = scratch.keep(fit.filter(is_query).select(*columns).mapInArrow(_packer(BLOCK, tree=False), _PACKED_DDL), "blocks")
    # Few blocks: each shard is split among few tasks' groups; many blocks: they alone make enough tasks.
    numbers = blocks.select("dim", F.col("number").alias("block"))  # a row for each BLOCK queries
    tasks = 2 * spark.sparkContext.defaultParallelism
    groups = numbers.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.lit(tasks) / F.count("*"))).cast("long").alias("groups"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group")
    asked = blocks.join(groups, "dim").select("dim", F.col("number").alias("block"), every, F.lit(None).cast("long").alias("shard"), "large", "ids", "vectors", "nodes")
    # The pairs are made of numbers; the vectors of a shard join them afterwards.
    shard_numbers = shards.select("dim", F.col("number").alias("shard")).join(groups, "dim").withColumn("group", F.pmod(F.xxhash64("shard"), F.col("groups")))
    pairs = shard_numbers.join(numbers, "dim").select("dim", "block", "group", "shard")
    met = pairs.join(shards.withColumnRenamed("number", "shard"), ["dim", "shard"]).select("dim", "block", "group", "shard", "large", "ids", "vectors", "nodes")
    dealt = asked.unionByName(met).repartition("dim", "block", "group").sortWithinPartitions("dim", "block", "group", F.col("shard").asc_nulls_first())
    found = dealt.mapInArrow(_searcher(k), _FOUND)
    place = F.row_number().over(Window.partitionBy("dim", "block", "place").orderBy(F.desc("exact"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
