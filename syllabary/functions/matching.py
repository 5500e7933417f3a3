"""Which aliases of a table stand in a text: a text is read once where it lies, whatever the number of aliases.

The table is written in blocks of bounded size to the folder that the whole cluster shares. A task takes a batch of texts as the bytes
that Arrow holds, looks the hashes of all their windows as long as an alias up in a block's sorted hashes, and compares what it finds
byte by byte. Texts are not shuffled and no pairs are made but those that are found. Work grows with the texts and, beyond
``MOST`` aliases, with the number of blocks, which a task reads one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Aliases, and bytes of them and their keys, in a block.
MOST, BYTES = 2_000_000, 64 << 20
#: Blocks that a Python worker keeps; bytes of texts that meet the blocks in one go; windows that are hashed in one go.
KEPT, TEXTS, WINDOWS = 4, 16 << 20, 1 << 17
#: Windows of a longer alias are looked for where one of its first bytes, so many at least, begins.
BEGIN = 4

_FACTOR, _INVERSE, _MIX = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64(0xD6E8FEB86659FD93)


def _powers(x: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))])


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and where each begins, with the end of the last; nulls are empty."""
    x = x.fill_null("").cast(pa.large_binary())
    _, begins, held = x.buffers()
    begins = np.frombuffer(begins, np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    return (np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)), begins


class _Sums:
    """Hashes of any windows of some bytes, from running sums of them times powers of a factor, modulo 2^64."""

    def __init__(self, data: np.ndarray, powers: np.ndarray, inverses: np.ndarray):
        self.sums, self.inverses = np.zeros(len(data) + 1, np.uint64), inverses
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverses[at]


class _Seen:
    """Most hashes that are not among the given ones; all of these."""

    def __init__(self, hashes: np.ndarray):
        bits = max(10, int(8 * len(hashes)).bit_length())
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.table[(hashes * _MIX) >> self.shift] = True

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        return self.table[(hashes * _MIX) >> self.shift]


class _Block:
    """Aliases of a block by their numbers of characters and bytes, most characters first, each group's hashes sorted."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.combine_chunks()
        texts = self.rows["alias"].combine_chunks() if len(rows) else pa.array([], pa.string())
        self.text, begins = _bytes(texts)
        self.begins, sizes = begins[:-1], np.diff(begins)
        self.chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int32)
        self.longest, self.empty = int(sizes.max(initial=0)), np.flatnonzero(sizes == 0)
        self.groups, every, first, long = [], [], [], sizes[sizes >= BEGIN]
        self.begin = int(long.min(initial=self.longest)) if len(long) else 0
        powers = _powers(_FACTOR, self.longest)
        order = np.lexsort((-sizes, -self.chars))
        order = order[sizes[order] > 0]
        for own in np.split(order, np.flatnonzero((np.diff(self.chars[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1) if len(order) else []:
            size, hashes = int(sizes[own[0]]), np.zeros(len(own), np.uint64)
            for k in range(size):
                hashes += (self.text[self.begins[own] + k].astype(np.uint64) + np.uint64(1)) * powers[k]
                if k + 1 == self.begin:
                    first.append(hashes.copy())
            by_hash = np.argsort(hashes, kind="stable")
            self.groups.append((int(self.chars[own[0]]), size, hashes[by_hash], own[by_hash]))
            every.append(hashes)
        self.seen = _Seen(np.concatenate(every)) if every else None
        self.first = _Seen(np.unique(np.concatenate(first))) if first else None

    def equal(self, hashes: np.ndarray, own: np.ndarray, size: int, data: np.ndarray, at: np.ndarray, hashed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``data``, alias): the windows that are an alias of the group."""
        near = np.searchsorted(hashes, hashed)
        while len(at):
            met = hashes[np.minimum(near, len(hashes) - 1)] == hashed
            met &= near < len(hashes)
            at, hashed, near = at[met], hashed[met], near[met]
            alias = own[near]
            same = np.ones(len(at), bool)
            for k in range(size):
                same &= self.text[self.begins[alias] + k] == data[at + k]
            yield at[same], alias[same]
            at, hashed, near = at[~same], hashed[~same], near[~same] + 1

    def hits(self, data: np.ndarray, begins: np.ndarray, only_longest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, alias): where aliases stand in the texts; ``only_longest``: a text's shorter ones may be left out."""
        last, many = int(begins[-1]), max(WINDOWS, self.longest)
        powers, inverses = _powers(_FACTOR, many + self.longest), _powers(_INVERSE, many)
        for start in range(int(begins[0]), last, many):
            windows = min(many, last - start)
            part = data[start : min(last, start + many + self.longest)]
            low, high = np.searchsorted(begins, start, "right") - 1, np.searchsorted(begins, start + windows, "left")
            own = begins[low : high + 1] - start  # texts that have windows here
            row = np.repeat(np.arange(high - low, dtype=np.int32), np.diff(np.clip(own, 0, windows)))
            sums, room, every = _Sums(part, powers, inverses), own[row + 1], np.arange(windows)
            near = every[every + self.begin <= len(part)] if self.first else every[:0]
            near = near[self.first.may_hold(sums.of(near, self.begin))] if self.first else near
            done, now = None, None
            for chars, size, hashes, aliases in self.groups:
                if chars != now and done is not None:
                    every, near, done = every[~done[row[every]]], near[~done[row[near]]], None
                now = chars
                at = near if size >= BEGIN else every
                at = at[at + size <= room[at]]
                hashed = sums.of(at, size)
                maybe = self.seen.may_hold(hashed)
                for place, alias in self.equal(hashes, aliases, size, part, at[maybe], hashed[maybe]):
                    if len(place):
                        yield row[place] + low, alias
                        if only_longest:
                            done = np.zeros(high - low, bool) if done is None else done
                            done[row[place]] = True


_kept: dict[str, _Block] = {}


def _block(at: str) -> _Block:
    """A block by its folder; a worker keeps some of the table that it looked at last."""
    if at not in _kept:
        table = at.rpartition("/")[0]
        for old in [x for x in _kept if x.rpartition("/")[0] != table] or ([next(iter(_kept))] if len(_kept) >= KEPT else []):
            del _kept[old]
        system, base = fs.FileSystem.from_uri(at)
        files = [x.path for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.base_name.endswith(".parquet")]
        read = [pq.ParquetFile(f, filesystem=system).read() for f in sorted(files)]
        _kept[at] = _Block(pa.concat_tables(read) if read else pa.table({"alias": pa.array([], pa.string())}))
    return _kept[at]


def _best(blocks: list[str], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """The key of the longest alias of each text, of equally long ones that of the least place; null where there is none."""
    data, begins = _bytes(texts)
    chars, place, found = np.full(len(texts), -1, np.int32), None, pa.nulls(len(texts), kind)
    for at in blocks:
        block = _block(at)
        if not len(block.rows):
            continue
        places = block.rows["place"].to_numpy()
        place = np.zeros(len(texts), places.dtype) if place is None else place
        took = np.full(len(texts), -1)

        def take(row: np.ndarray, alias: np.ndarray) -> None:
            order = np.lexsort((places[alias], -block.chars[alias], row))  # noqa: B023
            row, alias = row[order], alias[order]
            top = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else order
            row, alias = row[top], alias[top]
            long, least = block.chars[alias], places[alias]  # noqa: B023
            better = (long > chars[row]) | ((long == chars[row]) & (least < place[row]))  # noqa: B023
            row, alias = row[better], alias[better]
            chars[row], place[row], took[row] = long[better], least[better], alias  # noqa: B023

        for row, alias in block.hits(data, begins, only_longest=True):
            take(row, alias)
        if len(block.empty):
            rest = np.flatnonzero(chars < 0)
            take(rest, np.full(len(rest), block.empty[0]))
        keys = block.rows["key"].combine_chunks().cast(kind).take(pa.array(np.maximum(took, 0)))
        found = pc.if_else(pa.array(took >= 0), keys, found)
    return pc.if_else(texts.is_valid(), found, pa.scalar(None, kind))


def _all(blocks: list[str], texts: pa.Array) -> pa.Array:
    """The aliases of each text, each once, in no order; null for null."""
    data, begins = _bytes(texts)
    rows, aliases = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
    for at in blocks:
        block = _block(at)
        n, met = max(1, len(block.rows)), [np.zeros(0, np.int64)]
        for row, alias in block.hits(data, begins, only_longest=False):
            met.append(np.unique(row.astype(np.int64) * n + alias))
        met += [np.arange(len(texts)) * n + e for e in block.empty[:1]]
        row, alias = np.divmod(np.unique(np.concatenate(met)), n)
        rows.append(row)
        aliases.append(block.rows["alias"].combine_chunks().cast(pa.string()).take(pa.array(alias)) if len(alias) else aliases[0])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
    return pc.if_else(texts.is_valid(), pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(aliases).take(pa.array(order))), pa.scalar(None, pa.list_(pa.string())))


def _in_lots(look, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``look`` over so many batches together that their blocks are not read for each one."""
    held: list[pa.Array] = []
    for one in batches:
        held.append(one)
        if sum(x.nbytes for x in held) >= TEXTS:
            yield look(pa.concat_arrays(held))
            held = []
    if held:
        yield look(pa.concat_arrays(held))


class Aliases:
    """A table of aliases, ``alias`` and, for ``best``, ``key`` and ``place``, an alias once and none of them null, in blocks."""

    def __init__(self, rows: DataFrame, tables, aliases: int, size: int):
        n = max(1, -(-aliases // MOST), -(-size // BYTES))
        self.kind = rows.schema["key"].dataType if "key" in rows.columns else None
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("alias"), F.lit(n)).cast("int")).repartition("block")
        tables.keep(dealt, "blocks", by=("block",))
        self.blocks = [f"{tables.path}/blocks/block={i}" for i in range(n)]

    def best(self, text: Column) -> Column:
        """The key of the longest alias that stands in a text, of equally long ones that of the least place."""
        from pyspark.sql.pandas.types import to_arrow_type

        blocks, kind = self.blocks, to_arrow_type(self.kind)

        @F.arrow_udf(self.kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _in_lots(lambda x: _best(blocks, x, kind), batches)

        return run(text)

    def all(self, text: Column) -> Column:
        """All aliases that stand in a text, each once, in order."""
        blocks = self.blocks

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _in_lots(lambda x: _all(blocks, x), batches)

        return F.sort_array(run(text))
