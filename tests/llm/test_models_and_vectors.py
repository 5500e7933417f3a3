"""Class-based language model, centroid clustering and whitening: against brute force and plain arithmetic."""

from __future__ import annotations

import hashlib
import math
import random
import types
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from syllabary.llm import centroids, class_lm, queries, whitening

FOLDER = "/root/testdata/sf0.001"


def pair_likelihood(text, classes):
    pairs = np.zeros((max(classes.values()) + 1,) * 2)
    for a, b in zip(text, text[1:], strict=False):
        pairs[classes[a], classes[b]] += 1
    return pairs, class_lm.likelihood(pairs)


def test_gains_are_differences_of_the_likelihood():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(9)]
    for _ in range(20):
        text = [rng.choice(words) for _ in range(60)]
        classes = {w: rng.randrange(4) for w in words}
        pairs, _ = pair_likelihood(text, classes)
        pairs = np.pad(pairs, (0, 4 - len(pairs)))
        word = rng.choice(text[1:-1])
        near = np.zeros((1, 2 * 4 + 1))
        for a, b in zip(text, text[1:], strict=False):
            near[0, classes[a]] += b == word
            near[0, 4 + classes[b]] += a == word
            near[0, 8] += a == b == word
        found = class_lm.gains(near, np.array([classes[word]]), pairs)[0]
        want = [pair_likelihood(text, {**classes, word: c})[1] for c in range(4)]
        assert found - found[classes[word]] == pytest.approx(np.array(want) - want[classes[word]])


def test_words_are_numbered_as_they_come():
    texts = [b"a  b\ta", b"", b"\n\x0b b c\xa0\xff ", b" ", b"d"]
    words, ids, ends = class_lm.numbered(texts)
    named = [words[i].as_py() for i in ids.tolist()]
    assert named == [w for t in texts for w in t.split()] and ends.tolist() == np.cumsum([len(t.split()) for t in texts]).tolist()
    assert class_lm.numbered([b""])[1].tolist() == []


def test_probabilities_after_every_class_sum_to_one():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 5, (6, 6)) * rng.integers(0, 2, (6, 6))
    pairs[0, 1] += 3
    pairs[2, 0] += 3
    counts = [[int(pairs[:, 0].sum())], *[np.bincount(rng.integers(0, 3, pairs[:, c].sum()), minlength=3)[:3].tolist() for c in range(1, 6)]]
    counts = [[n for n in own if n] for own in counts]
    every = [n for own in counts for n in own]
    model = class_lm.model_of(pairs, np.array([0, *map(len, counts[1:])]), every.count(1), every.count(2))
    for row in range(7):
        known = sum(10 ** model.transitions[row, c] * (n - model.discount) / model.totals[c] for c, own in enumerate(counts) for n in own)
        assert known + 10 ** model.unseen[row] == pytest.approx(1)
    assert model.distinct == len(every) and model.tokens == pairs.sum()


def test_chunks_do_not_show(monkeypatch):
    """The counts and classes of words, gathered from chunks of any size, are those of one chunk."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "held_out": [i % 7 == 0 for i in range(60)], "text": texts})
    monkeypatch.setattr(class_lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    core = class_lm.Core((b"a", b"bb", b"c"), np.array([1, 2, 3]), 4)
    seen = []
    for size in (1 << 30, 300, 1):
        monkeypatch.setattr(class_lm, "CHUNK", size)
        chunks = list(class_lm.encode(iter([docs.slice(0, 25), docs.slice(25)])))
        assert [unpacked for b in chunks for unpacked in class_lm.unpacked(b.column(1)[0])[0].tolist()] == list(range(60))
        counts = pa.Table.from_batches(class_lm._core_counts(core)(iter([b.select(["docs", "ids", "words"]) for b in chunks])))
        pairs = np.frombuffer(zlib.decompress(counts.column(1)[0].as_py()), np.int64).reshape(5, 5)
        rows = pa.Table.from_batches(class_lm._occurrences(core)(iter(chunks))).sort_by("word")
        found = pa.Table.from_batches(class_lm._settle(core, pairs)(iter(rows.to_batches(max_chunksize=7)))).to_pylist()
        place = {(r["chunk"], r["place"]): r["word"] for r in rows.to_pylist()}
        words = {place[r["chunk"], r["place"]]: (r["c"], r["class"]) for r in found if r["chunk"] >= 0}
        assert len(place) == sum(r["chunk"] >= 0 for r in found)
        seen.append((pairs.tolist(), words, sorted((r["class"], r["place"], r["c"]) for r in found if r["chunk"] < 0), counts.column(1)[1].as_py()))
    assert seen[0] == seen[1] == seen[2]
    learnt = [w for i, t in enumerate(texts) if i % 7 for w in t.encode().split()]
    assert {w: c for w, (c, _) in seen[0][1].items()} == {w: learnt.count(w) for w in {w for t in texts for w in t.encode().split()}}


def words_of(text):
    return (text or "").encode().translate(class_lm._LOWER).split()


def test_class_lm_query_counts_and_beats_single_words(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = {}
    for i, t in docs.items():
        for w in [*words_of(t), None] if not held[i] else []:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    found = {r["doc_id"]: r for r in queries.QUERIES["op11_class_lm"](spark, FOLDER).collect()}
    assert found.keys() == docs.keys()
    for i, r in found.items():
        own = [*words_of(docs[i]), None]
        base = sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(own), sum(w in c for w in own), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    unseen = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > 0.95 * sum(r["base_score"] for r in unseen)


def test_class_lm_edge_cases(spark):
    """Nulls, empty and repeated texts, a clashing column, no training documents, an empty table; counts by hand."""
    texts = ["a b a", "B c\n", None, "", "x a", "a " * 50 + "b", "x a"]
    df = spark.createDataFrame([(i if i != 2 else None, t, i == 4, "k") for i, t in enumerate(texts)], "doc_id long, text string, out boolean, score string")
    rows = class_lm.score(df, F.col("out"), k=3, rounds=1).collect()
    assert len(rows) == len(texts)
    learnt = [words_of(t) for i, t in enumerate(texts) if i != 4]
    c = {w: sum(own.count(w) for own in learnt) for w in {w for own in learnt for w in own}}
    n = sum(c.values()) + len(learnt)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["held_out"] and by_id[4]["n_tokens"] == 3 and by_id[4]["n_known"] == 3 and all(r["train_tokens"] == n for r in rows)
    assert by_id[None]["n_tokens"] == by_id[3]["n_tokens"] == 1 and by_id[None]["score"] == by_id[3]["score"] and not by_id[None]["held_out"]
    assert by_id[4]["score"] == by_id[6]["score"]
    assert by_id[0]["base_score"] == pytest.approx(sum(math.log10((x + 1) / (n + len(c) + 2)) for x in (c[b"a"], c[b"b"], c[b"a"], len(learnt))))
    nothing = class_lm.score(df, F.lit(True), k=3, rounds=1).collect()
    assert {(r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in nothing} == {(0.0, 0.0, 0, 0)}
    assert class_lm.score(df.limit(0), F.lit(False)).count() == 0


def test_class_lm_learns_order(spark):
    """Words of two kinds that alternate are much likelier in that order."""
    rng = random.Random(8)
    kind = [[f"{k}{i}" for i in range(30)] for k in "xy"]
    texts = [" ".join(rng.choice(kind[j % 2]) for j in range(40)) for _ in range(200)]
    wrong = [" ".join(rng.choice(kind[j // 20]) for j in range(40)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts + wrong)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in class_lm.score(df, F.col("doc_id") >= 195, k=4, rounds=4).collect()}
    good, bad = (sum(found[i]["score"] for i in x) for x in (range(195, 200), range(200, 205)))
    assert good > bad + 40 and good > sum(found[i]["base_score"] for i in range(195, 200)) + 40


def brute_clusters(rows, k, rounds, scale=64):
    x = [(i, [math.floor(scale * v) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        near = [min(range(len(centres)), key=lambda j, v=v: (away(v, centres[j]), j)) for _, v in x]
        if step < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), c in zip(x, near, strict=True) if c == j]
                if own:
                    centres[j] = [sum(p) // len(own) for p in zip(*own, strict=True)]
    distances = [away(v, centres[c]) for (_, v), c in zip(x, near, strict=True)]
    per = {j: sum(d for d, c in zip(distances, near, strict=True) if c == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, per[c], sum(distances), sha[c]) for (i, _), c, d in zip(x, near, distances, strict=True)), key=str)


def test_centroids_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.integers(-3, 4, (60, 64)) / 7.3).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[3]), (5, vectors[5]), (5, vectors[9]), (70, None), (71, vectors[0][:63]), (72, [float("nan"), *vectors[0][1:]]), (73, [None, *vectors[0][1:]]), (74, [float("inf"), *vectors[0][1:]])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    for k in (4, 100):
        found = sorted((tuple(r) for r in centroids.cluster(df, k=k).collect()), key=str)
        assert found == brute_clusters(rows, k, 3)
    assert centroids.cluster(df.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="or more"):
        centroids.cluster(far).collect()


def test_dots_change_by_changed_components_alone():
    rng = np.random.default_rng(2)
    x, old = rng.integers(-9, 9, (20, 8)), rng.integers(-9, 9, (3, 8))
    new = old.copy()
    new[1, [2, 5]] += 3
    assert (centroids.moved_dots(x, x @ old.T, new - old) == x @ new.T).all()


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 32, 1 << 58])
def test_square_sums_are_exact(most):
    rng = random.Random(most)
    x = [[rng.randint(-most, most) for _ in range(5)] for _ in range(40)]
    assert whitening.square_sums(np.array(x)) == [sum(r[j] ** 2 for r in x) for j in range(5)]
    assert whitening.square_sums(np.array(x, object)) == [sum(r[j] ** 2 for r in x) for j in range(5)]
    assert whitening.exact_sums(np.array(x)) == [sum(r[j] for r in x) for j in range(5)]


def check_whitening(rows, found):
    """Everything from plain fractions and a dense decomposition."""
    x = [(i, tuple(math.floor(256 * v) for v in e)) for i, e in rows]
    fit = sorted({v for _, v in x})
    n, width = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(width)]
    centred = [[n * v[d] - sums[d] for d in range(width)] for v in fit]
    cov = np.array([[float(Fraction(sum(z[a] * z[b] for z in centred), n**3)) for b in range(width)] for a in range(width)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == len(rows) * min(4, width)
    for r in found:
        own = [v for i, v in x if i == r["vec_id"]]
        away = [[n * v[d] - sums[d] for d in range(width)] for v in own]
        k = r["component"] - 1
        assert r["n"] == n and int(r["deviation_exact"]) in [sum(z * z for z in a) for a in away] and r["explained"] == pytest.approx(values[k] / cov.trace(), rel=1e-9)
        white = [sum(z * u for z, u in zip(a, vectors[:, k], strict=True)) / n / math.sqrt(values[k]) for a in away]
        assert any(abs(abs(r["whitened"]) - abs(w)) < 1e-6 for w in white)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and 0 <= found[0]["identity_error"] < 1e-9


def test_whitening_query_over_its_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = queries.QUERIES["op13_whitening"](spark, FOLDER).collect()
    check_whitening(rows, found)
    assert all(r["deviation"] == r["deviation_exact"] for r in found)
    white = np.array([r["whitened"] for r in sorted(found, key=lambda r: (r["vec_id"], r["component"]))]).reshape(-1, 4)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-9  # no vector of this table repeats


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(30, 3)) * [5, 2, 1]).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[2]), (3, vectors[3]), (3, vectors[8])]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("-inf"), 1.0, 2.0]), (94, [])]
    schema = "vec_id long, embedding array<double>, component string"
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], schema)
    check_whitening(rows, whitening.whiten(df).collect())
    # Lengths are fitted apart; one vector alone has no spread.
    both = whitening.whiten(df.unionByName(spark.createDataFrame([(200, [1.0, 2.0], "x"), (201, [1.0, 2.0], "x")], schema))).collect()
    assert {(r["vec_id"], r["component"]): (r["n"], r["deviation"], r["whitened"], r["explained"]) for r in both if r["vec_id"] in (200, 201)} == {(i, c): (1, 0, None, None) for i in (200, 201) for c in (1, 2)}
    assert len(both) == 3 * len(rows) + 4
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], "x") for i in range(5)], schema)).collect()
    assert all(r["whitened"] is None and r["explained"] == 0 for r in flat if r["component"] == 2) and flat[0]["identity_error"] < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(i, [float(1 << 36) * i, 1.0], "x") for i in range(3)], schema)).collect()
    assert {r["deviation"] for r in huge} == {0, (1 << 63) - 1} and {int(r["deviation_exact"]) for r in huge} == {0, (3 << 44) ** 2}
