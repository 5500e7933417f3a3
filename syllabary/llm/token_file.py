"""Token ids as a compact file: canonical length-limited Huffman codes over global counts.

A token file is a folder of four Parquet tables, written and read by Spark alone:

* ``codebook``: one row for each id that occurs, with its code length; canonical codes follow from the lengths.
* ``segments``: runs of whole documents in ascending doc_id order. Codes are packed least significant bit first. Every
  ``BLOCK`` tokens a new block starts, whose bit offset is a checkpoint; blocks decode independently of each other.
* ``parts``: tokens of each range of doc_ids (one row for each write task), from which the reader knows where each begins.

Passes: one shuffle by doc_id range (texts), then narrow passes only: tokenise, count, encode, decode. Only the counts of the
vocabulary and one row a task reach the driver.

Null or empty texts hold the end id alone; documents with a null doc_id come first; repeated rows are each written, ordered by
text hash; an empty table gives an empty file. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllabary.llm import tokens
from syllabary.llm.common import TOGETHER, Scratch, text_of, together

#: Tokens between two bit-offset checkpoints.
BLOCK = 256
#: Tokens of a segment, but for a single longer document.
SEGMENT = 1 << 19
#: Longest code; the decoding table has two to this power entries.
LONGEST = 18


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    merged, is_leaf = leaves, []
    for _ in range(longest):
        is_leaf.append(None)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1) if is_leaf[:-1] else np.empty(0)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        merged, is_leaf[-1] = both[rank], rank < len(leaves)
    take, found = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        found[:n] += 1
        take = 2 * (take - n)
    lengths[order] = found
    return lengths


class Codebook:
    """Canonical codes of given lengths, bits reversed for packing from the least significant bit."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint64)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.bits = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        widths = self.lengths[order]
        steps = np.uint64(1) << (np.uint64(self.bits) - widths)
        firsts = np.cumsum(steps) - steps  # each code, left-aligned
        plain = firsts >> (np.uint64(self.bits) - widths)
        turned = np.zeros(len(plain), np.uint64)
        for i in range(self.bits):
            here = widths > i
            turned[here] |= ((plain[here] >> np.uint64(i)) & np.uint64(1)) << (widths[here] - np.uint64(1 + i))
        self.codes[order] = turned
        self.table: np.ndarray | None = None
        self.order, self.turned, self.widths = order, turned, widths

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(checkpoints, payload) of ids."""
        if not len(ids):
            return b"", b""
        widths = self.lengths[ids]
        ends = np.cumsum(widths)
        at = ends - widths
        shifted = self.codes[ids] << (at & np.uint64(31))
        word = (at >> np.uint64(5)).astype(np.int64)
        firsts = np.flatnonzero(np.diff(word, prepend=-1))  # no code spans a whole word, so each word has a first code
        size = int((int(ends[-1]) + 31) >> 5)
        packed = np.zeros(size + 1, np.uint64)
        packed[word[firsts]] = np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), firsts)
        packed[word[firsts] + 1] += np.add.reduceat(shifted >> np.uint64(32), firsts)
        return at[::BLOCK].astype("<u8").tobytes(), packed[:size].astype("<u4").tobytes()

    def decode(self, checkpoints: bytes, payload: bytes, n: int) -> np.ndarray:
        """The n ids of a segment; its blocks advance together, one code of each a step."""
        if not n:
            return np.empty(0, np.uint32)
        if self.table is None:
            self.table = np.zeros(1 << self.bits, np.uint64)
            for width in np.unique(self.widths):
                here = self.widths == width
                entry = (self.order[here].astype(np.uint64) << np.uint64(8)) | width
                reach = np.arange(1 << (self.bits - int(width)), dtype=np.uint64) << width
                self.table[(self.turned[here][:, None] | reach[None, :]).ravel()] = np.repeat(entry, len(reach))
        padded = payload + bytes(8)
        words = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.zeros((BLOCK, len(at)), np.uint32)
        mask, last = (1 << self.bits) - 1, n - (len(at) - 1) * BLOCK
        for i in range(BLOCK):
            if i == last:  # the last block is over
                at = at[:-1]
            entry = self.table[(words[at >> 3] >> (at & 7).astype(np.uint32)) & mask]
            out[i, : len(at)] = entry >> np.uint64(8)
            at = at + (entry & np.uint64(255)).astype(np.int64)
        return out.T.ravel()[:n]


_IDS = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_SEGMENTS = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])
_IDS_DDL = "part int, row long, doc_id long, first long, n_tokens long, ids binary"
_SEGMENTS_DDL = "part int, row long, first long, doc_ids array<long>, sizes array<long>, checkpoints binary, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``doc_id, text`` with the tokenizer file ``tokenizer`` and write the token file ``path``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-ids")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row, first = tokens.load(tokenizer), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for some in together(batch, 1, most=8 * TOGETHER, rows=4000):
                ids = [x + end for x in encoder.encode(some.column(1).to_pylist())]
                sizes = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
                firsts = first + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(row, row + len(ids))), some.column(0), pa.array(firsts), pa.array(sizes), pa.array(ids, pa.binary())], schema=_IDS)
                row, first = row + len(ids), first + int(sizes.sum())

    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ids = scratch.keep(ranged.mapInArrow(tokenise, _IDS_DDL), "ids")
    wide = tokens.load(tokenizer).dtype

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for some in together(batch, 0):
                found = np.bincount(np.frombuffer(b"".join(some.column(0).to_pylist()), wide))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # At most one row for each entry of the vocabulary.
    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in rows), default=0), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codebook = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(codebook, "id long, width int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)

        def segment(held: list[dict]) -> pa.RecordBatch:
            checkpoints, payload = book.encode(np.frombuffer(b"".join(x["ids"] for x in held), wide))
            one = {k: held[0][k] for k in ("part", "row", "first")}
            return pa.RecordBatch.from_pylist([one | {"doc_ids": [x["doc_id"] for x in held], "sizes": [x["n_tokens"] for x in held], "checkpoints": checkpoints, "payload": payload}], _SEGMENTS)

        held, size = [], 0
        for batch in batches:
            for some in together(batch, 5, most=2 * TOGETHER):
                for x in some.to_pylist():
                    if held and (size + x["n_tokens"] > SEGMENT or (x["part"], x["row"]) != (held[-1]["part"], held[-1]["row"] + 1)):
                        yield segment(held)
                        held, size = [], 0
                    held.append(x)
                    size += x["n_tokens"]
        if held:
            yield segment(held)

    ids.mapInArrow(encode, _SEGMENTS_DDL).write.mode("overwrite").option("compression", "none").parquet(f"{path}/segments")
    ids.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    scratch.drop("ids")


def load(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a token file; ids are little-endian unsigned 32-bit integers."""
    book_rows = spark.read.parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    lengths = np.zeros(1 + max((r["id"] for r in book_rows), default=0), np.uint8)
    for r in book_rows:
        lengths[r["id"]] = r["width"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        for batch in batches:
            for i in range(len(batch)):
                x = batch.slice(i, 1).to_pylist()[0]
                sizes = np.array(x["sizes"], np.int64)
                ids = book.decode(x["checkpoints"], x["payload"], int(sizes.sum())).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cut = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), x["part"], np.int32)), pa.array(x["doc_ids"], pa.int64()), pa.array(starts + x["first"]), pa.array(sizes), pa.array(cut, pa.binary())], names=["part", "doc_id", "first", "n_tokens", "ids"])

    # One row for each task of the writer: its size follows the number of tasks, which the driver tracks anyway.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.parquet(f"{path}/parts").select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    found = spark.read.parquet(f"{path}/segments").mapInArrow(decode, "part int, doc_id long, first long, n_tokens long, ids binary")
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")
