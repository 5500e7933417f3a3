"""Language model of word classes: exchange clustering, class transitions and word emissions, smoothed.

Each word belongs to one class. P(word | word before) = P(class | class before) * P(word | class).

1. *Encode.* Documents become chunks: a row holds the words of up to ``CHUNK`` bytes of text, how often each stands in training
   documents, and the documents as numbers of those words. Texts are read once and never shuffled.
2. *Core.* The most frequent words, ``CORE`` at most, begin as classes of their own (as many as there are) or in the last class.
3. *Exchange.* In each round every core word is offered the class that raises the likelihood of the training text most, the others
   staying. Counts of the classes before and after each core word are summed by tasks as they read chunks, and met by blocks of
   words in a shuffle; the classes of the core (a bounded vector) are all that reaches the driver. Half of the words move in a
   round after the first, so that two do not change places for ever, and the classes with the best likelihood are kept.
4. *Insertion.* Every other word, however rare, goes to the class that explains its neighbours best (the same gain, to first order).
   A word's rows from all chunks meet in one task, in order; its total count and its class go back to each of those chunks.
5. *Transitions* of the classes are counted over all training documents, and every document is scored with them.

The count of a word is exact, since the word itself is the key. Smoothing: transitions by Witten-Bell towards the classes' shares;
emissions by absolute discounting with the count of words seen once and twice, whose mass a word that was never seen gets, summed
over the classes that may follow. After such a word the classes' shares stand for a row. All probabilities after a word sum to 1,
the unseen words counting as one.

Words are runs of other characters than the six of white space, A-Z in lower case, and a token ends each document, which stands
also before its first word. A null text is empty and has that one token. Rows that repeat, share an id or have a null id are each
learnt from and scored, null ids as training. Without training documents every score is 0. An empty table gives no rows. Columns
besides the two named are ignored. A text of any length is one task's work and lies in one chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.llm.common import Scratch, partitions, text_of

#: Bytes of text in a chunk (or one longer text); words that are exchanged in turn; words of a block of their counts.
CHUNK, CORE, BLOCK = 8 << 20, 1 << 14, 1 << 10
#: A word stands for the core if a chunk has it once in so many tokens: sixty times rarer than the core's rarest in a usual text.
CANDIDATE = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: docs: three rows of longs, of each document the id, the end of its words in ids, and flags (1: held out, 2: without an id).
_CHUNK = "chunk long, docs binary, ids binary, words array<binary>, counts array<long>"
_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
_OCCURRENCES = "word binary, chunk long, place int, n long, codes binary"
_FOUND = "chunk long, place int, c long, class int"


def numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word of the texts one after the other, where each text's words end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))  # the six characters between words
    turns = np.flatnonzero(np.diff(space, prepend=True))
    starts, stops = turns[::2], turns[1::2]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space].tobytes())]).dictionary_encode()
    ends = np.cumsum([len(x) + 1 for x in texts])
    return found.dictionary, np.asarray(found.indices), np.searchsorted(starts, ends)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) rows to chunks."""
    task, made = TaskContext.get().partitionId() << 32, 0
    doc_ids, held, texts, size = [], [], [], 0

    def chunk() -> pa.RecordBatch:
        nonlocal made
        made += 1
        words, ids, ends = numbered(texts)
        docs = np.array([[d or 0 for d in doc_ids], ends, [h + 2 * (d is None) for d, h in zip(doc_ids, held, strict=True)]], np.int64)
        learnt = np.repeat(~np.array(held, bool), np.diff(ends, prepend=0))
        counts = np.bincount(ids[learnt], minlength=len(words))
        row = [[task + made], [docs.tobytes()], [ids.tobytes()], pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), [counts]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(row, _CHUNK_ARROW, strict=True)], schema=_CHUNK_ARROW)

    for batch in batches:
        for i in range(len(batch)):
            doc_id, out, text = (batch.column(k)[i].as_py() for k in range(3))
            doc_ids.append(doc_id)
            held.append(out)
            texts.append(text.encode().translate(_LOWER))
            size += len(texts[-1])
            if size >= CHUNK:
                yield chunk()
                doc_ids, held, texts, size = [], [], [], 0
    if doc_ids:
        yield chunk()


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, counts) of chunks to (word, n) of those that are not rare."""
    for batch in batches:
        for i in range(len(batch)):
            counts = batch.column(1)[i].values.to_numpy()
            at = np.flatnonzero(counts >= max(1, int(counts.sum()) // CANDIDATE))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.take(pa.array(at)), pa.array(counts[at])], names=["word", "n"])


def most_frequent(counted: DataFrame, most: int = CORE) -> list[bytes]:
    """The most frequent words of ``counted`` (word, n), ``most`` at most, by falling count, then by word.

    Counts fall into some hundred steps of 5 %; the words of all steps that fit whole are the core, so no task sends more words than
    there are in it.
    """
    step = F.floor(F.log2("n") * 14).cast("int")
    steps = sorted((r["step"], r["words"]) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect())[::-1]
    total, least = 0, None
    for at, words in steps:
        total += words
        if total > most:
            break
        least = at
    if least is None:
        return []
    rows = counted.filter(step >= least).collect()  # ``most`` at most
    return [w for _, w in sorted((-r["n"], bytes(r["word"])) for r in rows)]


@dataclass(frozen=True)
class Core:
    """Words that are exchanged and their classes: 0 is the end of a document, ``k`` stands for all words outside the core."""

    words: tuple[bytes, ...]
    classes: np.ndarray
    k: int

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the core, or the core's size."""
        found = pc.index_in(words, value_set=pa.array(self.words, pa.binary()))
        return np.asarray(pc.fill_null(found, len(self.words))).astype(np.int64)

    def classes_of(self, places: np.ndarray) -> np.ndarray:
        return np.append(self.classes, self.k)[places]


def unpacked(docs: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends of the words, flags) of a chunk's documents."""
    return tuple(np.frombuffer(docs.as_buffer(), np.int64).reshape(3, -1))


def training(docs: pa.Scalar, ids: pa.Scalar, end: int) -> np.ndarray:
    """The words of a chunk's training documents with ``end`` between, before and after them; only ``end`` without any."""
    words, (_, stops, flags) = np.frombuffer(ids.as_buffer(), np.int32), unpacked(docs)
    starts, keep = np.concatenate([[0], stops[:-1]]), flags % 2 == 0
    if not keep.all():
        words = words[np.repeat(keep, stops - starts)]
        sizes = (stops - starts)[keep]
        stops = np.cumsum(sizes)
    return np.concatenate([[end], np.insert(words, stops, end)]).astype(np.int64) if keep.any() else np.array([end])


def _core_counts(core: Core):
    """(docs, ids, words) of chunks to counts: a row of packed counts for each block of core words, and for the class pairs.

    Of a core word: the classes before it, those after it, and itself after itself.
    """
    k1, size = core.k + 1, len(core.words)
    width = 2 * k1 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, pairs, any_rows = np.zeros((size, width), np.int64), np.zeros(k1 * k1, np.int64), False
        for batch in batches:
            for i in range(len(batch)):
                docs, ids, words = (batch.column(c)[i] for c in range(3))
                place = np.append(core.places(words.values), size)
                kind = np.append(core.classes_of(place[:-1]), 0)
                text = training(docs, ids, len(place) - 1)
                own, cls = place[text], kind[text]
                for start in range(0, len(text) - 1, 1 << 20):  # pairs of neighbours, a million at a time
                    a, b = slice(start, min(start + (1 << 20), len(text) - 1)), slice(start + 1, min(start + 1 + (1 << 20), len(text)))
                    first, second = own[a] < size, own[b] < size
                    itself = own[a][first & (own[a] == own[b])] * width + 2 * k1
                    at = np.concatenate([(own[b] * width + cls[a])[second], (own[a] * width + k1 + cls[b])[first], itself])
                    near += np.bincount(at, minlength=near.size).reshape(near.shape)
                    pairs += np.bincount(cls[a] * k1 + cls[b], minlength=len(pairs))
                any_rows = True
        if any_rows:
            blocks = [near[x : min(x + BLOCK, size)] for x in range(0, size, BLOCK)]
            packed = [zlib.compress(x.tobytes(), 1) for x in (pairs, *blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(blocks), dtype=np.int32)), pa.array(packed, pa.binary())], names=["block", "counts"])

    return run


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block after the other to one row a block."""
    block, total = None, None
    for batch in batches:
        for b, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), np.int64)
            if b != block and total is not None:
                yield pa.RecordBatch.from_pylist([{"block": block, "counts": total.tobytes()}], pa.schema([("block", pa.int32()), ("counts", pa.binary())]))
            block, total = b, counts if b != block else total + counts
    if total is not None:
        yield pa.RecordBatch.from_pylist([{"block": block, "counts": total.tobytes()}], pa.schema([("block", pa.int32()), ("counts", pa.binary())]))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """What the classes add to the log likelihood of the training text, from their counts of pairs."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(0)).sum() - xlogx(pairs.sum(1)).sum())


def gains(near: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """What each class adds to the likelihood if a word is put there, after it was taken from its ``own`` one: a row for each word.

    ``near`` holds the classes before each word, those after it, and itself after itself, as ``_core_counts`` gives them.
    """
    k1, rows = len(pairs), np.arange(len(near))
    before, after, itself = near[:, :k1].astype(float), near[:, k1 : 2 * k1].astype(float), near[:, -1].astype(float)
    n_in, n_out = before.sum(1), after.sum(1)
    left = np.repeat(pairs[None].astype(float), len(near), axis=0)  # the pairs without the word
    left[rows, own, :] -= after
    left[rows, :, own] -= before
    left[rows, own, own] += itself
    before[rows, own] -= itself
    after[rows, own] -= itself
    logs = xlogx(left)
    ins = xlogx(left + after[:, None, :]) - logs  # [word, class, class after]
    outs = xlogx(left + before[:, :, None]) - logs  # [word, class before, class]
    both = np.arange(k1)
    corner = xlogx(left[:, both, both] + before + after + itself[:, None]) - logs[:, both, both]
    gain = ins.sum(2) - ins[:, both, both] + outs.sum(1) - outs[:, both, both] + corner
    from_class, to_class = np.repeat(pairs.sum(1)[None].astype(float), len(near), axis=0), np.repeat(pairs.sum(0)[None].astype(float), len(near), axis=0)
    from_class[rows, own] -= n_out
    to_class[rows, own] -= n_in
    return gain - (xlogx(from_class + n_out[:, None]) - xlogx(from_class)) - (xlogx(to_class + n_in[:, None]) - xlogx(to_class))


def _exchange(core: Core, pairs: np.ndarray, turn: int):
    """(block, counts) rows to (word, class): the core words that gain by another class."""
    width = 2 * (core.k + 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = np.frombuffer(counts, np.int64).reshape(-1, width)
                words = b * BLOCK + np.arange(len(near))
                if turn:
                    fit = (words + turn) % 2 == 0
                    words, near = words[fit], near[fit]
                for start in range(0, len(words), 64):
                    some, own = words[start : start + 64], core.classes[words[start : start + 64]]
                    gain = gains(near[start : start + 64], own, pairs)
                    gain[:, 0] = gain[:, core.k] = -np.inf  # the end of a document and the words outside are no choice
                    best = gain.argmax(1)
                    better = np.flatnonzero(gain[np.arange(len(some)), best] > gain[np.arange(len(some)), own] + 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array(some[better].astype(np.int32)), pa.array(best[better].astype(np.int32))], names=["word", "class"])

    return run


def _occurrences(core: Core):
    """(chunk, docs, ids, words, counts) of chunks to a row for each of their words: the codes of a word outside the core are a
    byte for each neighbour in training text, the class before it, or 128 and the class after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                chunk, docs, ids, words, counts = (batch.column(c)[i] for c in range(5))
                place = np.append(core.places(words.values), len(core.words))
                kind, n = np.append(core.classes_of(place[:-1]), 0), len(place) - 1
                text = training(docs, ids, n)
                inner, cls = np.append(place[:-1] == len(core.words), False)[text], kind[text]
                second, first = np.flatnonzero(inner[1:]) + 1, np.flatnonzero(inner[:-1])
                word = np.concatenate([text[second], text[first]])
                codes = np.concatenate([cls[second - 1], 128 + cls[first + 1]]).astype(np.uint8)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n)[:n])]).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(codes[np.argsort(word, kind="stable")].tobytes())])
                columns = [words.values, pa.array(np.full(n, chunk.as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int32)), counts.values, packed]
                whole = pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OCCURRENCES.split(", ")])
                for start in range(0, n, 10_000):
                    yield whole.slice(start, 10_000)

    return run


def _settle(core: Core, pairs: np.ndarray):
    """Occurrences, sorted by word, to (chunk, place, c, class) of each; and, where chunk is -1, of each class (place) the count of its
    tokens and, as -2 - t in place of the class, of its words that occur once (t = 1), twice (t = 2), at all (t = 0)."""
    k1 = core.k + 1
    logs = np.log(pairs + 0.5)
    marginal = np.log(pairs.sum(1) + 0.5)[None, :], np.log(pairs.sum(0) + 0.5)[None, :]

    def inserted(near: np.ndarray) -> np.ndarray:
        """The class of each word outside the core by the classes before and after it."""
        before, after = near[:, :k1], near[:, 128 : 128 + k1]
        gain = before @ logs + after @ logs.T - after.sum(1, keepdims=True) * marginal[0] - before.sum(1, keepdims=True) * marginal[1]
        return gain[:, 1 : core.k].argmax(1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = np.zeros((4, core.k), np.int64)  # tokens, words, words seen once, words seen twice
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # chunks and places of the word that is not complete yet
        word, c, near = None, 0, np.zeros(256)

        def out(chunks: np.ndarray, places: np.ndarray, c: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(places), pa.array(c), pa.array(cls)], names=[x.split()[0] for x in _FOUND.split(", ")])

        def settled(words: pa.Array, c: np.ndarray, near: np.ndarray) -> np.ndarray:
            place = core.places(words)
            cls = np.where(place < len(core.words), np.append(core.classes, 0)[place], inserted(near)) if len(words) else np.zeros(0, np.int64)
            cls = np.where(c > 0, cls, 0)
            for row, fit in enumerate((c > 0, c > 0, c == 1, c == 2)):
                facts[row] += np.bincount(cls[fit], weights=c[fit] if row == 0 else None, minlength=core.k).astype(np.int64)
            return cls.astype(np.int32)

        for batch in batches:
            for start in range(0, len(batch), 4096):
                some = batch.slice(start, 4096)
                words, new = some.column(0), np.ones(len(some), bool)
                new[0] = words[0].as_py() != word
                new[1:] = np.asarray(pc.not_equal(words.slice(1), words.slice(0, len(some) - 1)))
                group = np.cumsum(new) - (1 if word is None else 0)  # without a word before, the first one is new
                heads = words.filter(pa.array(new))
                if word is not None:
                    heads = pa.concat_arrays([pa.array([word], pa.binary()), heads])
                counts = np.bincount(group, weights=some.column(3).to_numpy(), minlength=len(heads)).astype(np.int64)
                codes = some.column(4)
                data = np.frombuffer(codes.buffers()[2] or b"", np.uint8)
                stops = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
                data, sizes = data[stops[0] : stops[-1]], np.diff(stops)
                table = np.bincount(np.repeat(group, sizes) * 256 + data, minlength=256 * len(heads)).reshape(len(heads), 256).astype(float)
                if word is not None:
                    counts[0] += c
                    table[0] += near
                chunks, places = some.column(1).to_numpy(), some.column(2).to_numpy()
                done = settled(heads.slice(0, len(heads) - 1), counts[:-1], table[:-1])
                complete = group < len(heads) - 1
                if len(heads) > 1 and kept:
                    for a, b in kept:
                        yield out(a, b, np.full(len(a), counts[0]), np.full(len(a), done[0]))
                    kept = []
                if complete.any():
                    yield out(chunks[complete], places[complete], counts[group[complete]], done[group[complete]])
                kept.append((chunks[~complete], places[~complete]))
                word, c, near = heads[-1].as_py(), int(counts[-1]), table[-1]
        if word is not None:
            done = settled(pa.array([word], pa.binary()), np.array([c]), near[None])
            for a, b in kept:
                yield out(a, b, np.full(len(a), c), np.full(len(a), done[0]))
            kinds = np.arange(core.k, dtype=np.int32)
            for row, mark in enumerate((-1, -2, -3, -4)):
                yield out(np.full(core.k, -1), kinds, facts[row], np.full(core.k, mark, np.int32))

    return run


_READY = "docs binary, ids binary, c binary, class binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk, before the rows of its words in order, to the chunk with the count and the class of each of its words."""
    head, parts = None, []

    def ready() -> pa.RecordBatch:
        c, cls = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        columns = [*head.columns[1:3], pa.array([c.astype(np.int64).tobytes()], pa.binary()), pa.array([cls.astype(np.uint8).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _READY.split(", ")])

    for batch in batches:
        place = batch.column(3).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(place < 0).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if place[a] < 0:
                    if head is not None:
                        yield ready()
                    head, parts, a = batch.slice(a, 1), [], a + 1
                if a < b:
                    parts.append(tuple(batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (4, 5)))
    if head is not None:
        yield ready()


def _transitions(k: int):
    """(docs, ids, class) of chunks to (a, b, n): how often class b follows class a in training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                docs, ids, kinds = (batch.column(c)[i] for c in range(3))
                kind = np.append(np.frombuffer(kinds.as_buffer(), np.uint8), 0).astype(np.int64)
                cls = kind[training(docs, ids, len(kind) - 1)]
                total += np.bincount(cls[:-1] * k + cls[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    return run


@dataclass(frozen=True)
class Model:
    """Tokens and distinct tokens of the training text, log10 of the transitions (the last row after an unseen word), tokens of each
    class, log10 of an unseen word's probability after each class, the discount, and the count of the end."""

    tokens: int
    distinct: int
    transitions: np.ndarray
    totals: np.ndarray
    unseen: np.ndarray
    discount: float
    documents: int


def model_of(pairs: np.ndarray, words: np.ndarray, once: int, twice: int) -> Model:
    """The smoothed model from the counts of class pairs and the number of distinct words of each class (the end is one, of class 0)."""
    k, totals = len(pairs), pairs.sum(0)
    tokens, documents = int(totals.sum()), int(totals[0])
    if not tokens:
        return Model(0, 0, np.zeros((k + 1, k)), totals, np.zeros(k + 1), 0.0, 0)
    discount = min(max(once / (once + 2 * twice) if once + twice else 0.5, 0.1), 0.9)
    words = words + (np.arange(k) == 0)
    share = totals / tokens
    kinds = (pairs > 0).sum(1)
    rows = pairs.sum(1)
    seen = np.where((rows > 0)[:, None], (pairs + kinds[:, None] * share) / np.maximum(rows + kinds, 1)[:, None], share)
    seen = np.vstack([seen, share])
    spared = np.divide(discount * words, totals, out=np.zeros(k), where=totals > 0)
    with np.errstate(divide="ignore"):
        return Model(tokens, int(words.sum()), np.log10(seen), totals, np.log10(seen @ spared), discount, documents)


def _score(model: Model):
    """Ready chunks to a row for each document."""
    k = len(model.totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(divide="ignore"):
            class_log = np.log10(np.maximum(model.totals, 1))
        for batch in batches:
            for i in range(len(batch)):
                docs, ids, counts, kinds = (batch.column(c)[i] for c in range(4))
                doc_ids, stops, flags = unpacked(docs)
                c = np.append(np.frombuffer(counts.as_buffer(), np.int64), model.documents)
                kind = np.append(np.frombuffer(kinds.as_buffer(), np.uint8), 0).astype(np.int64)
                end = len(c) - 1
                base = np.log10((c + 1) / (model.tokens + model.distinct + 1))
                word = np.log10(np.maximum(c - model.discount, 0.1)) - class_log[kind]
                after = np.where(c > 0, kind, k)  # the row of transitions after each word
                after[end] = 0
                text = np.insert(np.frombuffer(ids.as_buffer(), np.int32).astype(np.int64), stops, end)
                stops = stops + np.arange(1, len(stops) + 1)
                starts = np.concatenate([[0], stops[:-1]])
                before = np.concatenate([[end], text[:-1]])  # every document begins after an end
                rows, seen = after[before], c[text] > 0
                if model.tokens:
                    score = np.where(seen, model.transitions[rows, kind[text]] + word[text], model.unseen[rows])
                else:
                    score = np.zeros(len(text))
                sums = [np.add.reduceat(x, starts) for x in (base[text], score, seen.astype(np.int64))]
                columns = [pa.array(doc_ids, mask=flags >= 2), pa.array(flags % 2 == 1), pa.array(stops - starts), pa.array(sums[2]), pa.array(np.full(len(stops), model.tokens)), pa.array(sums[0]), pa.array(sums[1])]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, k: int = 64, rounds: int = 4) -> DataFrame:
    """``SCORES`` of every document by a model of those that are not ``held_out``; ``k`` classes, the document's end among them."""
    if not 3 <= k <= 127:
        raise ValueError("there are 3 to 127 classes")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "class-lm")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of().alias("text"))
    chunks = scratch.keep(plain.mapInArrow(encode, _CHUNK), "chunks")
    counted = chunks.select("words", "counts").mapInArrow(candidates, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = most_frequent(scratch.keep(counted.filter("n > 0"), "candidates"))
    scratch.drop("candidates")
    classes = np.minimum(np.arange(1, len(top) + 1), k - 1)
    core, best = Core(tuple(top), classes, k), None
    tasks = max(4 * spark.sparkContext.defaultParallelism, 1)
    for turn in range(rounds + 1):
        counted = chunks.select("docs", "ids", "words").coalesce(tasks).mapInArrow(_core_counts(core), "block int, counts binary")
        summed = counted.repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(_block_sums, "block int, counts binary")
        summed = scratch.keep(summed, f"counts-{turn}")
        packed = summed.filter("block = -1").select("counts").collect()  # one row of (k + 1)^2 counts
        pairs = np.frombuffer(packed[0]["counts"], np.int64).reshape(k + 1, k + 1) if packed else np.zeros((k + 1, k + 1), np.int64)
        value = likelihood(pairs)
        if best is None or value > best[0]:
            best = value, core, pairs
        if turn < rounds and top:
            moves = summed.filter("block >= 0").mapInArrow(_exchange(core, pairs, turn), "word int, class int").collect()  # CORE rows at most
            classes = core.classes.copy()
            for r in moves:
                classes[r["word"]] = r["class"]
            core = Core(core.words, classes, k)
        scratch.drop(f"counts-{turn}")
        if not top:
            break
    _, core, pairs = best
    rows = chunks.select("chunk", "docs", "ids", "words", "counts").mapInArrow(_occurrences(core), _OCCURRENCES)
    settled = rows.repartition(partitions(spark), "word").sortWithinPartitions("word").mapInArrow(_settle(core, pairs), _FOUND)
    found = scratch.keep(settled, "words")
    facts = {(r["class"], r["place"]): int(r["c"]) for r in found.filter("chunk = -1").groupBy("class", "place").agg(F.sum("c").alias("c")).collect()}  # 4 k rows
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = chunks.select("chunk", "docs", "ids", F.lit(-1).alias("place"), none("long", "c"), none("int", "class"))
    own = found.filter("chunk >= 0").select("chunk", none("binary", "docs"), none("binary", "ids"), "place", "c", "class")
    met = heads.unionByName(own).repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "place")
    ready = scratch.keep(met.mapInArrow(_gather, _READY), "ready")
    scratch.drop("words", "chunks")
    total = np.zeros((k, k), np.int64)
    for r in ready.select("docs", "ids", "class").mapInArrow(_transitions(k), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # k^2 rows
        total[r["a"], r["b"]] = r["n"]
    words, once, twice = (np.array([facts.get((mark, c), 0) for c in range(k)]) for mark in (-2, -3, -4))
    model = model_of(total, words, int(once.sum()), int(twice.sum()))
    return ready.mapInArrow(_score(model), SCORES)
