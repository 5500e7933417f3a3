"""Toxicity scores from a lexicon trie intersected with Levenshtein automata, and context windows around the hits.

Learning (``learn``): over the labelled training rows, the document frequency of every word and word beginning in toxic and in
clean texts; those whose share of toxic documents is high even at the lower end of its interval join a short general list of
insults as terms, or, where many words share a beginning, as stems, weighed by their log odds. On a bounded sample of the training
rows, terms whose misspellings turn up in clean texts lose their edits, and a logistic model weighs the evidence; its prior
holds where that evidence is missing from the sample. All scores are shifted so that ``CUT`` parts the sample best.

Scoring: each distinct word runs once through the product of the trie and the Levenshtein automata of its terms, made
deterministic as states come up (``Matcher``): terms of five letters allow one edit, of nine two; stems match exactly. A hit is
weighed down by its edits, and is quoted, not abuse, where quotation marks stand around it within a window of words or a word of
reporting stands before it. Features are the abuse, the quoted hits, the densest window and the share of words.

Null and empty texts have no hits and get the score of such texts; repeated rows are each scored; labels of ids that have
several rows count for each; null labels teach nothing; without labels the prior decides; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabary.llm.common import Scratch, text_of, together

#: General insults every model knows.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "jerk", "dumb")
#: Words that report speech, and quotation marks.
REPORTS = frozenset("called calling said says wrote writes quote quoted quotes word words term terms insult insults meaning means".split())
QUOTES = frozenset("\"'“”„«»‘’")
WINDOW = 6
#: Bounds of what a model takes from the labelled rows: entries of its lexicon, rows of its logistic fit, labelled rows in all
#: (the first by a hash of their ids; the ids are broadcast).
MOST_TERMS, MOST_ROWS, MOST_LABELLED = 2000, 20_000, 50_000
#: The score from which a text is taken for toxic, and what a false alarm weighs against a miss.
CUT, ALARM = 0.7, 10
#: States of the automaton that a worker keeps before it begins anew.
MOST_STATES = 20_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¿¡"


@dataclass(frozen=True)
class Model:
    """Entries of the lexicon with their weights (0 to 1; stems end in ``*``), terms that allow no edits, and the weights of
    (bias, abuse, quoted, densest window, share)."""

    entries: tuple[tuple[str, float], ...]
    exact: frozenset[str]
    weights: tuple[float, ...]


def edits_allowed(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class Matcher:
    """The trie of a lexicon and its Levenshtein automata as one automaton, made deterministic on the way."""

    def __init__(self, model: Model):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, float, int] | None] = [None]  # (term, weight, edits allowed) of a node where a term ends
        self.below: list[int] = [-1]  # the most edits allowed by terms at or below a node
        self.stem_trie: dict = {}
        for entry, weight in model.entries:
            if entry.endswith("*"):
                node = self.stem_trie
                for c in entry[:-1]:
                    node = node.setdefault(c, {})
                node[""] = (weight, entry, 0)
                continue
            budget = 0 if entry in model.exact else edits_allowed(entry)
            at, path = 0, [0]
            for c in entry:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.below.append(-1)
                at = self.children[at][c]
                path.append(at)
            self.term[at] = (entry, weight, budget)
            for p in path:
                self.below[p] = max(self.below[p], budget)
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first."""
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[float, str, int] | None] = []
        self.begin = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With terms' letters left out, each at the cost of an edit; of each node only the cheapest."""
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits > self.below[node] or least.get(node, 9) <= edits:
                continue
            least[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.numbers:
            self.numbers[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            fit = [(t[1] * 0.8**e, t[0], e) for node, e in pairs if (t := self.term[node]) and e <= t[2]]
            self.ends.append(max(fit, default=None))
        return self.numbers[pairs]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            out.add((node, edits + 1))  # an extra letter in the word
            for letter, child in self.children[node].items():
                out.add((child, edits + (letter != c)))
        self.moves[state][c] = found = self._state(self._closed(out))
        return found

    def match(self, word: str) -> tuple[float, str, int] | None:
        """(weight, entry, edits) of the best entry, or None."""
        node = self.stem_trie
        for c in word:
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                return node[""]
        if len(self.sets) > MOST_STATES:
            self.clear()
        state, moves = self.begin, self.moves
        for c in word:
            state = moves[state].get(c) if c in moves[state] else self._step(state, c)
            if not self.sets[state]:
                return None
        return self.ends[state]


class _Hits(dict):
    """What a raw token matches, filled on demand and emptied when it grows large."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, token: str) -> tuple[float, str, int] | None:
        if len(self) > 400_000:
            self.clear()
        self[token] = found = self.matcher.match(token.strip(_EDGES))
        return found


def features(text: str, hits: _Hits) -> tuple[float, float, float, float]:
    """(abuse, quoted, densest window, share of words) of a whole text."""
    words = text.lower().split()
    at = [(i, e) for i, w in enumerate(words) if (e := hits[w])]
    if not at:
        return 0.0, 0.0, 0.0, 0.0
    abuse, quoted, places = 0.0, 0.0, []
    for i, e in at:
        weight = e[0]
        before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
        opened = any(w[0] in QUOTES for w in before) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
        if opened or any(w.strip(_EDGES) in REPORTS for w in words[max(0, i - 3) : i]):
            quoted += weight
        else:
            abuse += weight
            places.append((i, weight))
    low, total, most = 0, 0.0, 0.0
    for i, weight in places:
        total += weight
        while places[low][0] < i - 10 * WINDOW:
            total -= places[low][1]
            low += 1
        most = max(most, total)
    return math.log1p(abuse), math.log1p(quoted), math.log1p(most), abuse / len(words)


#: Prior means and precisions of the weights: a single hit that is not quoted makes a text toxic, quoted ones do not.
_PRIOR = np.array([-4.0, 6.0, 1.5, 2.0, 2.0])
_PRECISION = np.array([0.05, 0.2, 1.0, 0.2, 0.2])


def fit(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the logistic model at the mode of their posterior, by Newton steps."""
    x = np.column_stack([np.ones(len(rows)), rows.reshape(-1, 4)])
    w = _PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + _PRECISION * (w - _PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(_PRECISION), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def shift(logits: np.ndarray, labels: np.ndarray) -> float:
    """What is added to all logits so that a score of ``CUT`` parts the rows best: the fewest missed toxic ones, and ``ALARM`` times
    the share of clean ones that are taken for toxic; in the middle between two rows, of several the lowest."""
    toxic, clean = np.sort(logits[labels == 1]), np.sort(logits[labels == 0])
    if not len(toxic) or not len(clean):
        return 0.0
    at = np.unique(logits)
    loss = np.searchsorted(toxic, at) / len(toxic) + ALARM * (1 - np.searchsorted(clean, at) / len(clean))
    best = int(loss.argmin())
    return math.log(CUT / (1 - CUT)) - float(at[best] if best == 0 else (at[best - 1] + at[best]) / 2)


def choose_entries(forms: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weighed entries from (form, toxic, clean) document counts; forms that end in ``*`` are beginnings of words.

    A beginning is taken as long as four fifths of its documents have it; it is a stem where no single word makes up four fifths
    of them. The weight is the log of how much likelier the form is in toxic texts, over that of a certain one.
    """
    counts = {f: (t, c) for f, t, c in forms}
    beginnings = {f[:-1]: t for f, (t, _) in counts.items() if f.endswith("*")}
    words = {f: t for f, (t, _) in counts.items() if not f.endswith("*")}
    stems: list[str] = []
    for stem in sorted(beginnings, key=lambda s: (len(s), s)):
        if any(stem.startswith(s) for s in stems):
            continue
        while longer := [s for s in beginnings if len(s) == len(stem) + 1 and s.startswith(stem) and beginnings[s] >= 0.8 * beginnings[stem]]:
            stem = max(longer, key=lambda s: (beginnings[s], s))
        if stem not in stems and max((n for w, n in words.items() if w.startswith(stem)), default=0) < 0.8 * beginnings[stem]:
            stems.append(stem)
    kept = [w for w in words if not any(w.startswith(s) for s in stems)] + [s + "*" for s in stems]

    def weight(t: int, c: int) -> float:
        return min(1.0, max(0.0, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))) / 5)

    return {f: weight(*counts[f]) for f in kept}


_LETTERS = re.compile(r"[^\W\d_]+")


def _forms(text: str) -> set[str]:
    """Words of four letters and more, and beginnings of four to seven letters of longer ones."""
    words = {w for w in set(_LETTERS.findall(text.lower())) if 4 <= len(w) <= 30}
    return words | {w[:n] + "*" for w in words for n in range(4, min(8, len(w)))}


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())], names=["form", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(_forms(text))
            if len(toxic) + len(clean) > 400_000:
                yield flush()
    yield flush()


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the rows of ``labels`` (doc_id, toxic 0/1; training rows only) over ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    # The labels' bounded ids go to the texts, so no text is shuffled.
    known = scratch.keep(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marks), "doc_id").select("doc_id", "text", "label"), "known")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    forms = known.select("text", "label").mapInArrow(_count_forms, "form string, toxic long, clean long")
    forms = forms.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    forms = forms.filter(F.col("toxic") >= max(5, sizes.get(1, 0) / 100))
    n, z2 = F.col("toxic") + F.col("clean"), 4.0
    share = F.col("toxic") / n
    low = (share + z2 / (2 * n) - 2 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    best = forms.filter(low >= 0.4).orderBy(F.desc(low), F.desc("toxic"), "form").limit(MOST_TERMS)
    learnt = choose_entries([(r["form"], r["toxic"], r["clean"]) for r in best.collect()], sizes.get(1, 0), sizes.get(0, 0))
    entries = tuple(sorted({**dict.fromkeys(INSULTS, 0.9), **learnt}.items()))
    # The bound of the sample is found among hashes of ids; no text leaves its task.
    ranked = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(MOST_ROWS)
    last = ranked.agg(F.max("h")).first()[0]
    sample = scratch.keep(known.filter(F.xxhash64("doc_id") <= F.lit(last)).select("text", "label"), "sample")
    open_model = Model(entries, frozenset(), tuple(_PRIOR))
    misspelt = sample.filter("label = 0").mapInArrow(_misspelt(open_model), "term string").groupBy("term").agg(F.count("*").alias("n"))
    most = 0.0003 * sample.filter("label = 0").count()
    exact = frozenset(r["term"] for r in misspelt.filter(F.col("n") > most).collect())  # entries of the lexicon at most
    model = Model(entries, exact, tuple(_PRIOR))
    rows = sample.mapInArrow(_measure(model), "a double, b double, c double, d double, label int").collect()  # MOST_ROWS at most
    x = np.array([[r["a"], r["b"], r["c"], r["d"]] for r in rows], float).reshape(-1, 4)
    y = np.array([r["label"] for r in rows], float)
    weights = fit(x, y)
    weights[0] += shift(weights[0] + x @ weights[1:], y)
    return Model(entries, exact, tuple(weights))


def _misspelt(model: Model):
    """Terms that each text has with edits alone, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(Matcher(model))
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                found += {h[1] for h in map(hits.__getitem__, text.lower().split()) if h and h[2]}
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    return run


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(Matcher(model))
        for batch in batches:
            found = np.array([features(t, hits) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(4)), batch.column(1)], names=["a", "b", "c", "d", "label"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (doc_id, text)."""
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(Matcher(model))
        for batch in batches:
            for some in together(batch, 1):
                found = np.array([features(t, hits) for t in some.column(1).to_pylist()]).reshape(-1, 4)
                logits = np.clip(weights[0] + found @ weights[1:], -30, 30)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(1 / (1 + np.exp(-logits)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
