"""Quality rules: exact base rules, and a hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Features of a text are its lower-cased words and pairs of neighbouring words, hashed to counters, plus the shape of each word (runs
of upper, lower, digit and mark characters) in the same counters, by which junk of unseen words is known. Counts over the trusted
documents and over all documents give two multinomials with additive smoothing; a text's score is the sum of log(target / raw)
over its features, divided by their number. The number of counters is a parameter, the same for tables of any size, so a text's
verdict does not hang on how many others there are but by their counts. Counts come from one pass over all documents, summed by a
shuffle; a number for each counter reaches the driver.

The threshold is given, or learnt from all labelled documents as the cut with the least weighted error, so single wrong labels hardly
move it. It is fixed before any document is judged, and every document is decided alone and always alike.

Null and empty texts have no words, score 0 and fail the base rules; rows that repeat are each scored; a null doc_id is carried
through and never trusted; an empty table gives an empty result. Columns besides doc_id and text are ignored. Without trusted
documents there is no ratio to judge by and without bad ones no cut: then ``Model.learnt`` is false and the base rules decide alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabary.llm import shingles
from syllabary.llm.common import Scratch, text_of, together

#: Counters of hashed features.
COUNTERS = 1 << 17
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SHAPES = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("9") if 48 <= c <= 57 else c if c <= 32 else ord("x") if c >= 128 else c for c in range(256)
)
_RUNS = re.compile(rb"([Aa9x!-/:-@\[-`{-~])\1+")


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket, and the threshold on the mean over a text's features; ``learnt``: whether the ratio judges at all."""

    ratios: np.ndarray
    threshold: float
    learnt: bool = True


#: A trusted document that is rejected weighs as much as so many bad ones that are kept.
REJECTION = 20


def _hashed(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the words, of the pairs that each begins, of the shapes, words of each text) of some texts, one after the other."""
    words, counts = shingles.word_hashes(texts)
    shapes, same = shingles.word_hashes([_RUNS.sub(rb"\1", x.translate(_SHAPES)) for x in texts], lower=False)
    assert np.array_equal(counts, same)
    one = np.uint64(1)
    # A word that follows itself is one feature, whatever the word.
    pairs = np.where(words[:-1] == words[1:], one, shingles.mixed(words[:-1] * np.uint64(3) + words[1:] + one)) if len(words) > 1 else words[:0]
    size = np.uint64(buckets // 4)
    return words % (size * np.uint64(2)), pairs % size + size * np.uint64(2), shapes % size + size * np.uint64(3), counts


def _features(texts: list[bytes], buckets: int) -> list[np.ndarray]:
    """Buckets of every feature of each text."""
    single, double, shape, counts = _hashed(texts, buckets)
    out, start = [], 0
    for n in counts.tolist():
        out.append(np.concatenate([single[start : start + n], double[start : max(start, start + n - 1)], shape[start : start + n]]).astype(np.int64))
        start += n
    return out


def _counted(texts: list[bytes], buckets: int) -> np.ndarray:
    """Occurrences of each bucket in some texts."""
    single, double, shape, counts = _hashed(texts, buckets)
    ends = np.cumsum(counts)
    inside = np.ones(len(double), bool)
    inside[ends[(ends > 0) & (ends <= len(double))] - 1] = False  # no pair across two texts
    return np.bincount(np.concatenate([single, double[inside], shape]).astype(np.int64), minlength=buckets)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = text.encode().split()  # exactly at the six characters between words
    n = len(words)
    repeated = 0
    if n > 8:
        keys = list(zip(*[words[i:] for i in range(8)], strict=False))
        if len(set(keys)) < len(keys):
            numbers: dict[tuple, int] = {}
            ids = np.fromiter((numbers.setdefault(k, len(numbers)) for k in keys), np.int64, len(keys))
            twice = np.bincount(ids)[ids] > 1
            marks = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + 8, -1)
            repeated = int((np.cumsum(marks[:-1]) > 0).sum())
    lines = [x for x in text.split("\n") if x.encode().split()]
    chars = len(b"".join(words).decode())
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def learn(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, smoothing: float = 0.5, buckets: int = COUNTERS) -> Model:
    """A model from all of ``docs`` (doc_id, text) and ``trusted`` (doc_id, trusted boolean).

    ``trusted`` marks the target's documents (true), and those known to be bad (false), of which only the threshold learns, where
    none is given. Each text of the target is scored for that without its own counts, as an unlabelled one would be.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    marks = trusted.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("trusted").cast("int")).alias("mark"))
    plain = docs.select("doc_id", text_of().alias("text"))
    # How many are labelled grows with the input, so they are never broadcast.
    known = scratch.keep(plain.hint("merge").join(marks, "doc_id").select("text", "mark"), "known")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in together(batch, 0):
                total += _counted([x.encode() for x in some.column(0).to_pylist()], buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    def counts(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        summed = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
        out[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
        return out

    raw, target = (counts(x) + smoothing for x in (plain.select("text"), known.filter("mark = 1").select("text")))
    ratios = _log_ratios(target, raw)
    if threshold is not None:
        return Model(ratios, threshold)
    scored = known.mapInArrow(_known_scores(target, raw), "score double, mark int")
    cut = cut_of(scratch.keep(scored.groupBy("score").agg(F.sum("mark").alias("good"), F.sum(1 - F.col("mark")).alias("bad")), "scores"))
    return Model(ratios, float("-inf"), learnt=False) if cut is None else Model(ratios, cut)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the least share of ``good`` under it, ``REJECTION`` times, and of ``bad`` from it on: in the middle between
    two scores; of several the lowest. The rule on arrays; ``cut_of`` has it for tables of any size."""
    scores = np.unique(np.concatenate([good, bad]))
    under = np.searchsorted(np.sort(good), scores) / len(good)
    above = 1 - np.searchsorted(np.sort(bad), scores) / len(bad)
    at = int((REJECTION * under + above).argmin())
    return float(scores[at] if at == 0 else (scores[at - 1] + scores[at]) / 2)


def cut_of(scores: DataFrame) -> float | None:
    """``best_cut`` of a table: a row a score, with how many ``good`` and ``bad`` have it. None without any good or any bad.

    Every row counts: ranges of scores are summed up each in its task, and then a row a range from the left.
    """
    scratch = Scratch(scores.sparkSession, "cut")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), np.zeros(2, np.int64)
        for batch in batches:
            own = np.stack([batch.column(k).to_numpy() for k in (1, 2)])
            upto = np.cumsum(own, axis=1) + before[:, None]
            below, before = upto - own, upto[:, -1] if len(batch) else before
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), part, np.int32)), batch.column(0), *map(pa.array, (*own, *below))], names=["part", "score", "good", "bad", "good_below", "bad_below"])

    # Written, since Spark draws ranges anew each time that a plan runs.
    ranged = scores.select("score", F.col("good").cast("long"), F.col("bad").cast("long")).repartitionByRange("score").sortWithinPartitions("score")
    summed = scratch.keep(ranged.mapInArrow(running, "part int, score double, good long, bad long, good_below long, bad_below long"), "ranges")
    parts = summed.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()  # a row a task
    all_good, all_bad = (sum(r[k] for r in parts) for k in ("good", "bad"))
    if not all_good or not all_bad:
        return None
    before, good, bad = [], 0, 0
    for r in parts:
        before.append((r["part"], good, bad))
        good, bad = good + r["good"], bad + r["bad"]
    bases = scores.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long")
    whole = lambda x: x.cast("decimal(38,0)")
    under, above = F.col("good_before") + F.col("good_below"), F.lit(all_bad) - F.col("bad_before") - F.col("bad_below")
    cost = whole(under) * F.lit(REJECTION * all_bad) + whole(above) * F.lit(all_good)  # shares over one denominator, so ties are ties
    least = summed.join(F.broadcast(bases), "part").agg(F.min(F.struct(cost.alias("cost"), F.col("score"))).alias("least")).first()["least"]["score"]
    last = summed.filter(F.col("score") < F.lit(least)).agg(F.max("score")).first()[0]
    return float(least if last is None else (last + least) / 2)


def _log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return np.clip(np.log(target / target.sum()) - np.log(raw / raw.sum()), -6, 6)


def _known_scores(target: np.ndarray, raw: np.ndarray):
    """Scores of labelled texts; a text of the target is scored without its own counts, as an unlabelled one would be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, shift = _log_ratios(target, raw), np.log(raw / raw.sum())

        def score(own: np.ndarray, mark: int) -> float:
            if not len(own):
                return 0.0
            if not mark:
                return float(plain[own].mean())
            at, n = np.unique(own, return_counts=True)
            left = np.log((target[at] - n) / (target.sum() - len(own))) - shift[at]
            return float((np.clip(left, -6, 6) * n).sum() / len(own))

        for batch in batches:
            for some in together(batch, 0):
                marks = some.column(1).to_pylist()
                scores = [score(x, m) for x, m in zip(_features([t.encode() for t in some.column(0).to_pylist()], len(raw)), marks, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(scores), some.column(1)], names=["score", "mark"])

    return run


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, model: Model, keys: list[str], min_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """``keys`` (columns of docs) with the columns of ``VERDICT``, which replace keys of the same names."""
    names = [x.split()[0] for x in VERDICT.split(", ")]
    keys = [k for k in keys if k not in names]
    # Under numbers, so that no name can clash; the text goes to the workers once, whether it is a key or not.
    inside = [F.col(f"`{k}`").alias(f"key_{i}") for i, k in enumerate(keys)] + ([] if "text" in keys else [F.col("text").alias("key_text")])
    plain = docs.select(*inside)
    at = keys.index("text") if "text" in keys else len(keys)
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema[: len(keys)]), VERDICT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in together(batch, at):
                texts = [x or "" for x in some.column(at).to_pylist()]
                base = np.array([base_counts(x) for x in texts], np.int64).reshape(-1, 5)
                scores = np.array([float(model.ratios[x].mean()) if len(x) else 0.0 for x in _features([t.encode() for t in texts], len(model.ratios))])
                failed = (base[:, 0] < min_words) | (100 * base[:, 4] > most_repeated * base[:, 0])
                columns = [*some.columns[: len(keys)], *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(scores), pa.array(~failed & (scores >= model.threshold))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"key_{i}" for i in range(len(keys))), *names])

    return plain.mapInArrow(run, ddl).select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], *names)
