"""Packing token ids into fixed-length sequences by cutting-stock column generation.

Documents are tokenised once. What exceeds a sequence is cut off in pieces of its full length; the remaining pieces fall into
classes of ``GRAIN`` tokens. Short pieces of one length are bundled first, so many together that hardly anything is lost to the
next multiple of ``GRAIN``. The histogram of lengths (bounded by the sequence length, whatever the data) goes to the driver, where a linear program over patterns of classes is solved by column generation: a knapsack by dynamic programming prices the
columns. Patterns are rounded down, and first-fit decreasing packs the small rest, whose size depends on the number of classes
alone. Pieces are ranked within their length by (task, place in the task), a prefix sum over tasks, and each rank falls into one
pattern's sequences. No window holds more than the pieces of one sequence or the tasks of one class.

Null or empty texts are their end id. Repeated rows are packed each. An empty table gives no sequences. Columns besides doc_id
and text are ignored; a null doc_id is carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syllabary.llm import tokens
from syllabary.llm.common import TOGETHER, Scratch, text_of, together

GRAIN = 16
#: Pieces shorter than this are bundled, in bundles of at most twice as many tokens; a bundle loses so much of its length or less,
#: where some number of pieces allows that.
SHORT, LOST = 512, 0.004


def bundle(length: int) -> int:
    """How many pieces of a length make a bundle: the fewest that lose little to the next multiple of ``GRAIN``, or else the least."""
    loss = [-(k * length) % GRAIN / (k * length) for k in range(1, max(1, 2 * SHORT // length) + 1)]
    return next((k for k, x in enumerate(loss, 1) if x <= LOST), loss.index(min(loss)) + 1)


def solve(demand: np.ndarray, capacity: int, gap: float = 5e-4) -> list[tuple[np.ndarray, float]]:
    """Patterns (how often each size 1..capacity is cut) and their real counts, for ``demand[size - 1]`` pieces of each size.

    Revised simplex on one row a size. It ends when the pricing knapsack finds no better column, or when the bound that its
    value gives (total of the duals over that value) is within ``gap`` of the present total.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    d = demand[sizes - 1].astype(float)
    times = capacity // sizes
    columns = np.diag(times).astype(float)
    inverse = np.diag(1.0 / times)
    x = d / times
    jitter = d * (1 + 1e-7 * np.cos(np.arange(m)))  # no ties in the ratio test
    x = jitter / times
    for _ in range(40 * m + 200):
        duals = inverse.sum(0)
        value, column = _knapsack(sizes, duals, capacity)
        if value <= 1 + 1e-9 or x.sum() <= (1 + gap) * float(duals @ jitter) / value:
            break
        step = inverse @ column
        fit = np.flatnonzero(step > 1e-9)
        ratios = x[fit] / step[fit]
        out = fit[ratios.argmin()]
        t = max(ratios.min(), 0.0)
        x = np.maximum(x - t * step, 0)
        x[out] = t
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = column
    found = []
    for j in np.flatnonzero(x > 0):
        pattern = np.zeros(capacity, np.int64)
        pattern[sizes - 1] = columns[:, j].astype(np.int64)
        found.append((pattern, float(x[j])))
    return found


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable column that fits, by dynamic programming over capacities."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if k := upto[w]:
            values = best[w - sizes[:k]] + worth[:k]
            i = values.argmax()
            if values[i] > best[w]:
                best[w], took[w] = values[i], i
    column, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            column[took[w]] += 1
            w -= sizes[took[w]]
    return float(best[capacity]), column


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that hold every piece: rounded down, then first-fit decreasing for the rest."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, count in solve(demand, capacity):
        used = pattern > 0
        n = min(int(count + 1e-6), int((left[used] // pattern[used]).min()))
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    bins: list[list] = []
    for size in (np.flatnonzero(left)[::-1] + 1).tolist():
        rest, at = int(left[size - 1]), 0
        while rest:
            if at == len(bins):
                bins.append([capacity, np.zeros(capacity, np.int64)])
            if n := min(rest, bins[at][0] // size):
                bins[at][0] -= n * size
                bins[at][1][size - 1] += n
                rest -= n
            at += 1
    return out + [(pattern, 1) for _, pattern in bins]


class Seats:
    """Which sequence each piece goes to, by its length and its rank within that length."""

    def __init__(self, counts: dict[int, int], sequence: int):
        """``counts``: pieces of each length."""
        capacity = sequence // GRAIN
        demand = np.zeros(capacity, np.int64)
        #: By length: (first rank, pieces of a bundle, class, first number within the class).
        self.bundles: dict[int, list[tuple[int, int, int, int]]] = {}
        for length, n in sorted(counts.items()):
            if length == sequence:
                continue
            each = bundle(length) if length < SHORT else 1
            whole = n // each
            for first, size, many in ((0, each, whole), (whole * each, n - whole * each, 1)):
                if many and size:
                    kind = -(-length * size // GRAIN)
                    self.bundles.setdefault(length, []).append((first, size, kind, int(demand[kind - 1])))
                    demand[kind - 1] += many
        taken, base = np.zeros(capacity, np.int64), counts.get(sequence, 0)
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        # For each class: where each pattern's numbers begin, how many a sequence takes, and its first sequence.
        for pattern, n in plan(demand, capacity):
            for c in np.flatnonzero(pattern):
                ranges.setdefault(int(c) + 1, []).append((int(taken[c]), int(pattern[c]), base))
                taken[c] += n * pattern[c]
            base += n
        self.begins = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in ranges.items()}
        self.sequence = sequence

    def find(self, length: int, ranks: np.ndarray) -> np.ndarray:
        """Sequences of the pieces of one length with these ranks."""
        if length == self.sequence:
            return ranks
        found = np.zeros(len(ranks), np.int64)
        for first, size, kind, number in self.bundles[length]:
            here = ranks >= first
            own = number + (ranks[here] - first) // size
            low, each, base = self.begins[kind]
            k = np.searchsorted(low, own, side="right") - 1
            found[here] = base[k] + (own - low[k]) // each[k]
        return found


_PIECES = pa.schema([("task", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("rank", pa.int64()), ("packed", pa.binary())])
_PIECES_DDL = "task int, row long, doc_id long, start long, length long, doc_tokens long, rank long, packed binary"


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = 4096) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of every piece of ``doc_id, text``.

    ``ids`` are the piece's ids, little-endian unsigned 32-bit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, row = tokens.load(tokenizer), TaskContext.get().partitionId(), 0
        width, end = encoder.dtype.itemsize, np.array([end_id], encoder.dtype).tobytes()
        seen = np.zeros(sequence + 1, np.int64)
        for batch in batches:
            for some in together(batch, 1, most=2 * TOGETHER):
                rows = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // width
                    for start in range(0, total, sequence):
                        length = min(sequence, total - start)
                        rows.append((task, row, doc_id, start, length, total, int(seen[length]), ids[start * width : (start + length) * width]))
                        row += 1
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = scratch.keep(plain.mapInArrow(cut, _PIECES_DDL), "pieces")
    meta = pieces.drop("packed")
    per_task = scratch.keep(meta.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    totals = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most a row for each length
    seats = Seats({r["length"]: r["n"] for r in totals}, sequence)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            found = np.zeros(len(batch), np.int64)
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1)) if len(order) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here = order[a:b]
                found[here] = seats.find(int(lengths[here[0]]), ranks[here])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found)], names=["task", "row", "length", "sequence_id"])

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = meta.join(bases, ["task", "length"]).select("task", "row", "length", (F.col("base") + F.col("rank")).alias("rank"))
    seated = ranked.mapInArrow(place, "task int, row long, length long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy("task", "row").rowsBetween(Window.unboundedPreceding, -1)
    seated = seated.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("length")
    seated = scratch.keep(seated, "seated")
    width = tokens.load(tokenizer).dtype
    widen = F.udf(lambda b: np.frombuffer(b, width).astype("<u4").tobytes(), "binary", useArrow=True)
    joined = pieces.select("task", "row", "doc_id", "start", "length", "doc_tokens", "packed").join(seated, ["task", "row"])
    return joined.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", widen("packed").alias("ids"))
