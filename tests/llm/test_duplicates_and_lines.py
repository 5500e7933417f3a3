"""Near duplicates, components, line chunks and mixing against plain Python."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from syllabary.llm import graphs, line_chunks, mixing, near_dups, shingles
from syllabary.llm.common import Scratch, hot_keys, salted_join, together


def words_of(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def brute_sets(texts):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows, percent):
    sets, parent = brute_sets([r[1] for r in rows]), {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return {r[0]: root(r[0]) for r in rows}, {r[0]: len(s) for r, s in zip(rows, sets, strict=True)}


def test_near_duplicates_match_brute_force(spark):
    base, rng, rows = words_of(150, 1), random.Random(2), []
    for i in range(60):  # copies with up to ten edits: links, chains of links, and misses
        own = list(base)
        for _ in range(rng.randint(0, 10)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(9)}"
        rows.append((100 - i, " ".join(own)))
    rows += [(200 + i, " ".join(words_of(120, 50 + i))) for i in range(10)]
    rows += [(300, "UPPER one"), (301, "upper  one"), (302, ""), (303, None), (304, " \n"), (305, "x\u00a0y one"), (306, " ".join(base[:40]))]
    want, sizes = brute_components(rows, 80)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    found = {r["doc_id"]: r for r in near_dups.near_duplicates(df, percent=80).collect()}
    assert {k: r["component_id"] for k, r in found.items()} == want
    assert {k: r["n_shingles"] for k, r in found.items()} == sizes
    assert all(r["kept"] == (k == r["component_id"]) for k, r in found.items())
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "q r"), (1, "q r"), (2, "q r")], "doc_id long, text string")
    out = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dups.near_duplicates(odd).collect())
    assert out == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_estimate(spark):
    rng = np.random.default_rng(3)
    for n, overlap in ((60, 0.5), (900, 0.8), (5000, 0.9)):
        both = rng.integers(0, 2**64, n, np.uint64)
        extra = int(n * (1 - overlap) / overlap / 2)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, extra, np.uint64)])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got, error = shingles.estimate(shingles.sketch(a)[None], shingles.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(got[0] - true) < 5 * max(error[0], 0.02)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (100, 101), (5, 5)]
    rows = graphs.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert {r["node"]: r["root"] for r in rows} == {**{i: 0 for i in range(1, 41)}, 100: 99, 101: 99}


def test_repeated_chunks_go_but_for_the_first(spark):
    passage = "\n".join(" ".join(words_of(60, s)) for s in (7, 8))
    rows = [
        (2, f"own words two\nmore\n{passage}\nlast", "a", "z"),
        (1, f"first here\n{passage}", None, "z"),
        (3, f"{passage}\n{passage}", "a", "z"),
        (4, "short\nlines only", "a", "z"), (5, "short\nlines only", "a", "z"), (6, None, "a", "z"), (7, "", "a", "z"), (None, passage, "a", "z"),
        (8, f"{passage} but longer", "a", "z"), (8, f"{passage} but longer", "a", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start string").withColumn("n_chars", F.length("text").cast("long"))
    out = line_chunks.remove_repeats(df)
    assert out.columns == [*df.columns, "removed_lines"]
    found = {(r["doc_id"], r["text"]) for r in out.collect()}
    first, second = passage.split("\n")
    assert found == {(None, passage), (1, "first here"), (2, "own words two\nmore\nlast"), (3, ""), (4, "short\nlines only"), (5, ""), (6, None), (7, ""), (8, f"{second} but longer")}
    assert out.count() == len(rows) and all(r["n_chars"] == len(r["text"] or "") for r in out.filter("text is not null").collect())
    assert line_chunks.remove_repeats(df.limit(0)).count() == 0


def test_no_passage_is_lost_between_null_and_other_ids(spark):
    passage = "\n".join(" ".join(words_of(60, s)) for s in (7, 8))
    for ids in ((None, -1), (None, 0), (-1, 0)):
        for over in (None, 50):
            df = spark.createDataFrame([(i, passage) for i in ids], "doc_id long, text string")
            assert sorted(r["text"] for r in line_chunks.remove_repeats(df, runs_over=over).collect()) == ["", passage]


def test_equal_rows_cost_what_they_are(spark):
    passage = "\n".join(" ".join(words_of(60, s)) for s in (7, 8))
    equal = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(passage).alias("text"))
    other = spark.createDataFrame([(9, passage), (10, "own")], "doc_id long, text string")
    begun = time.perf_counter()
    rows = {(r["doc_id"], r["text"]): r["n"] for r in line_chunks.remove_repeats(equal.union(other)).groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert rows == {(7, passage): 100_000, (9, ""): 1, (10, "own"): 1} and time.perf_counter() - begun < 90


def test_hot_keys_are_salted(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 4000, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = many.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(one, "k", 5000)
    joined = salted_join(many, one, ["k"], "k", hot, ["v"])
    assert joined.columns == ["k", "v", "n"] and joined.count() == 5000 and joined.filter("k = -1 and n = 4000").count() == 4000
    assert [r["hot_key"] for r in hot.collect()] == [-1]


def test_rows_of_one_id_link_their_classes(spark):
    a, b = " ".join(words_of(30, 1)), " ".join(words_of(30, 2))
    df = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (6, " ".join(words_of(30, 3)))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dups.near_duplicates(df).collect()} == {(1, 1), (2, 1), (5, 1), (6, 6)}


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = [" ".join(words_of(400, 3)).encode(), b"x" * 5000 + b" y", b"", b" \n", " ".join(words_of(30, 4)).encode()]
    whole = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "PIECE", 64)
    monkeypatch.setattr(shingles, "SPARE", 16)
    monkeypatch.setattr(shingles, "_powers", [])
    pieces = shingles.word_hashes(texts)
    assert np.array_equal(whole[0], pieces[0]) and whole[1].tolist() == pieces[1].tolist() == [400, 2, 0, 0, 30]
    assert len(shingles._powers[0][0]) == 80


def test_slices_are_bounded_in_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n is not None else None for n in (3, 0, None, 50, 4, 4, 4)])], names=["t"])
    assert [len(x) for x in together(batch, 0, most=8)] == [3, 1, 2, 1] and [len(x) for x in together(batch, 0, rows=2)] == [2, 2, 2, 1]
    assert list(together(batch.slice(0, 0), 0)) == []


def test_a_long_text_takes_bounded_memory(spark):
    """20 MB of one text, through sets, scores and counts."""
    from syllabary.llm import quality

    text = " ".join(words_of(500, 11)) + " "
    df = spark.createDataFrame([(1, text * 6000), (2, text * 6000 + "end"), (3, "short one")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dups.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    model = quality.Model(np.zeros(1 << 15), 0.0)
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(df, model, ["doc_id"]).collect()} == {1: 3_000_000, 2: 3_000_001, 3: 2}


def test_repeated_runs_of_short_lines_go_whole(spark):
    rng, rows, filler = random.Random(5), [], iter(range(10**6))
    passages = [[" ".join(words_of(rng.randint(52 // n, 49), 100 * n + k)) for k in range(n)] for n in (2, 3, 4, 5, 6)]
    passages = [p for p in passages if sum(len(x.split()) for x in p) > 50]
    for i in range(40):
        lines = [f"own {next(filler)}" for _ in range(rng.randint(0, 5))]
        for p in rng.sample(passages, 2):
            lines += p + [rng.choice(["", f"own {next(filler)}"]) for _ in range(rng.randint(0, 3))]
        rows.append((i, "\n".join(lines)))
    rows += [(90, "\n".join(["ten words " * 5] * 20)), (91, "")]
    spans, gone = {}, {r[0]: set() for r in rows}
    for doc, text in rows:  # every run of more than 50 words, by its bytes
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) > 50:
                    spans.setdefault("\n".join(lines[a : b + 1]), []).append((doc, a, b))
    for places in spans.values():
        first = min(places)
        for doc, a, b in places:
            if doc != first[0] or a > first[2]:
                gone[doc] |= set(range(a, b + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = {r["doc_id"]: set(r["removed_lines"]) for r in line_chunks.remove_repeats(df).collect()}
    found = {r["doc_id"]: r for r in line_chunks.remove_repeats(df, runs_over=50).collect()}
    assert {k: set(r["removed_lines"]) for k, r in found.items()} == {k: v | chunks[k] for k, v in gone.items()}
    assert any(v - chunks[k] for k, v in gone.items()) and len(passages) == 5 and gone[90] == set(range(6, 20))
    assert all(found[d]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in found[d]["removed_lines"]) for d, t in rows)


def test_mix_keeps_to_its_targets(spark):
    rows = [(i, " ".join(words_of(40 + i % 90, i)), f"s{i % 4}" if i % 4 else None) for i in range(300)] + [(900, None, "s1"), (901, " \n", "s2"), (None, "a b c", "s1"), (5, "same x", "s3"), (5, "same x", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    mix = mixing.Mix(df, block_words=16, shard_slots=200)
    found = mixing.accounts(mix).collect()
    assert len(found) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in found)
    total = sum(r["size"] for r in found)
    targets = {r["source_size"]: r["target"] for r in found}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets.items())
    for size, target in targets.items():
        assert abs(sum(r["taken"] for r in found if r["source_size"] == size) - target) <= 0.03 * target + 48
    assert sorted(map(str, mixing.accounts(mixing.Mix(df, block_words=16, shard_slots=200)).collect())) == sorted(map(str, found))
    texts = mixing.taken_texts(df, mix)
    assert texts.columns == df.columns
    assert texts.select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] == sum(r["taken"] for r in found)
    assert mixing.accounts(mixing.Mix(df.limit(0))).count() == 0


def test_block_permutations_are_permutations(spark):
    sources = spark.createDataFrame([(0, 7, 14.0), (1, 130, 200.5)], "place long, blocks long, slots double")
    rows = mixing.draws(sources, shard_slots=50, repeats=2, seed=3).collect()
    for place, blocks, slots in ((0, 7, 14.0), (1, 130, 200.5)):
        first = [r["block"] for r in rows if r["place"] == place and r["round"] == 0]
        assert sorted(first) == list(range(blocks)) and abs(sum(r["place"] == place for r in rows) - slots) <= 6


def test_long_documents_are_cut_in_linear_time(spark):
    """128,000 lines: half of them stand in another document as well, and go from the later one, but lines that are a chunk alone."""
    text = "\n".join(f"line {i * 7919 % 1_000_003} of words" for i in range(128_000))
    df = spark.createDataFrame([(1, text[: len(text) // 2]), (2, text)], "doc_id long, text string")
    begun = time.perf_counter()
    found = {r["doc_id"]: (len(r["removed_lines"]), len(r["text"])) for r in line_chunks.remove_repeats(df).collect()}
    assert found[1] == (0, len(text) // 2) and 55_000 < found[2][0] <= 64_001 and time.perf_counter() - begun < 60
