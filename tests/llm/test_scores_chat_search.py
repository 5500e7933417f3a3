"""Quality, toxicity, licenses, chat, top-k, and the pipeline, on small tables."""

from __future__ import annotations

import hashlib
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syllabary.llm import chat, licenses, quality, top_k, toxicity


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", max_size=11))
def test_automaton_matches_edit_distance(word):
    terms = ("abcda", "abcab", "dcba", "abcdabcdab")
    model = toxicity.Model(tuple((t, 1.0) for t in terms) + (("ddd*", 0.5),), frozenset({"abcab"}), ())
    found = toxicity.Matcher(model).match(word)
    if word.startswith("ddd"):
        assert found == (0.5, "ddd*", 0)
        return
    fit = [levenshtein(word, t) for t in terms if levenshtein(word, t) <= (0 if t == "abcab" else toxicity.edits_allowed(t))]
    assert (found[2] if found else None) == (min(fit) if fit else None)


def test_toxicity_learns_words_and_leaves_quotes(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(240):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(7)) for _ in range(30)]
        if i % 4 == 0:
            words[5], words[9] = "zorbix" + rng.choice(["a", "en", "os", "ul"]), "kwizzle"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "you utter idiott and lozer, scum"), (903, 'he wrote "idiot" and said the word scum'), (904, "plain words here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    model = toxicity.learn(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    names = {e for e, _ in model.entries}
    assert "kwizzle" in names and "zorbix*" in names
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((found[i] >= 0.7) == bool(t) for i, t in labels)
    assert found[902] >= 0.7 and max(found[900], found[901], found[903], found[904]) < 0.7
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_base_counts_match_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.choice(["a", "b#", "c$c", "é|"]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))
        assert quality.base_counts(text) == want


def test_quality_keeps_good_texts(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows = [(i, good() if i % 5 else " ".join(w + "%%%" for w in good().split())) for i in range(200)] + [(500, None), (501, "")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    trusted = spark.createDataFrame([(i, bool(i % 5)) for i in range(0, 200, 2)] + [(None, True)], "doc_id long, trusted boolean")
    model = quality.learn(docs, trusted)
    found = {r["doc_id"]: r for r in quality.judge(docs, model, ["doc_id", "kept"]).collect()}
    assert all(found[i]["kept"] == bool(i % 5) for i in range(200)) and found[500]["base_failed"] and found[501]["score"] == 0
    assert quality.judge(docs.limit(0), model, ["doc_id"]).count() == 0
    # The score is the mean log ratio of the counted features.
    features = quality._features([rows[1][1].encode()], len(model.ratios))[0]
    assert found[1]["score"] == pytest.approx(float(model.ratios[features].mean()))


def test_licenses(spark):
    mit = licenses.known_texts()[0][1]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence")), (2, mit + " more"), (3, "text\nreleased under the M.I.T. licence"),
        (4, "text\n# Released under the MIT Licence!\nLicensed under CC BY-NC 4.0."), (5, None), (6, "..."), (7, "(c) 2020 x"), (None, "SPDX-License-Identifier: MIT"), (4, "text\n# Released under the MIT Licence!\nLicensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    found = sorted((str(r["doc_id"]), r["license"], r["n_notices"], r["notices"]) for r in licenses.scan(df).collect())
    assert found == [("1", "MIT", 0, ""), ("2", None, 0, ""), ("3", None, 0, ""), ("4", None, 2, "CC-BY-NC-4.0,MIT"), ("4", None, 2, "CC-BY-NC-4.0,MIT"), ("5", None, 0, ""), ("6", None, 0, ""), ("7", None, 0, ""), ("None", "MIT", 1, "MIT")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_published_texts_are_known_entire(spark):
    rows = list(enumerate(licenses.full_texts()))
    assert len({key for key, _ in licenses.full_texts()}) == 10
    changed = lambda t: re.sub(r"\bLicense\b", "Licence", t).replace("\n", "\r\n  ").upper() + "\n\nCopyright 2021 Somebody Else\n"
    df = spark.createDataFrame([(i, f(t)) for i, (_, t) in rows for f in (str, changed)] + [(99, rows[0][1][1] + " and one clause more")], "doc_id long, text string")
    found = licenses.scan(df).collect()
    assert all(r["license"] == rows[r["doc_id"]][1][0] for r in found if r["doc_id"] != 99) and [r["license"] for r in found if r["doc_id"] == 99] == [None]


def test_short_texts_and_wrapped_notices(spark):
    bsd = licenses._bsd(3, "")[0]
    head = ' * Copyright 2020 A\n *\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n * more\n'
    rows = [(1, "BSD 3-Clause License\n\nCopyright (c) 2020, A\n" + bsd), (2, licenses._ZLIB), (3, licenses._BSL), (4, head), (5, "own\n\nReleased under\nthe MIT\nLicense.\n\nown"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()} == {1: "BSD-3-Clause", 2: "Zlib", 3: "BSL-1.0", 4: None, 5: None, 6: None}
    found = {r["doc_id"]: (r["n_blocks"], r["licenses"]) for r in licenses.scan_blocks(df).collect()}
    assert {k: found[k] for k in (4, 5, 6)} == {4: (1, "Apache-2.0"), 5: (1, "MIT"), 6: (0, "")}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("\\<>|[]/INSTim_startend\ns"), max_size=40), st.text(st.sampled_from("user\n\\<s>\""), max_size=8))
def test_chat_round_trip(text, role):
    formatted, begin, learnt = chat.format_turn(role, text)
    assert chat.parse_turn(formatted) == (role, text)
    assert formatted.count(chat.START) == 1 and not any(c in chat.escape(text) for c in chat.CONTROLS)
    assistant, begin, learnt = chat.format_turn("assistant", text)
    assert chat.unescape(assistant[begin : begin + learnt]) == text


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, "user", "n"), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "assistant", "</s>[INST] ok")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.turn_rows(df))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found[1]["turns_sha256"] == sha("user\n\nassistant\nb\n") and found[1]["loss_sha256"] == sha("b") and found[1]["loss_chars"] == 1
    assert found[2]["n_turns"] == 2 and found[None]["n_turns"] == 1 and found[3]["loss_sha256"] == sha("</s>[INST] ok")
    assert chat.read_back(chat.format_conversations(chat.turn_rows(df.limit(0)))).count() == 0


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "{broken"), (10, None)], "conv_id long, record string")
    turns = {}
    for r in chat.canonical_turns(df).orderBy("turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert all(turns[i] == [("user", "q"), ("assistant", "a")] for i in range(4)) and all(turns[i] == [(None, None)] for i in (4, 9, 10))


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "LEAF", 8)
    rng = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(400)]
    vectors += [(i, vectors[0][1]) for i in range(400, 520)] + [(600, None), (601, [1.0, None] + [0.0] * 4), (602, [float("nan")] * 6), (603, [1.0] * 3), (None, [1.0] * 6), (7, vectors[9][1])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, score int").repartition(3)
    found = {}
    for r in top_k.top_k(df, F.col("vec_id") % 50 == 0, k=5).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    fit = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for i, q in fit:
        if i % 50 == 0:
            want = sorted(((-int(q @ v), j) for j, v in fit if j != i and len(v) == len(q)))[:5]
            assert found.get(i, []) == [(j, -s) for s, j in want]
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    vectors = [(0, [1e300, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [float(1 << 30), 1.0]), (3, [float(1 << 30), 1.5]), (4, [-float(1 << 30), 1.0]), (5, [1e300, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(2)
    whole, found = {i: top_k.integers(v) for i, v in vectors}, {}
    for r in top_k.top_k(df, F.col("vec_id") % 50 == 0, k=5).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (0, 50):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert found[q] == [(i, max(min(-s, (1 << 63) - 1), -(1 << 63))) for s, i in want]
    numbers = [-(10**40), -256, -9, 0, 7, 10, 255, 10**30]
    assert sorted(numbers, key=top_k.sortable) == numbers


def test_layouts_with_other_fields_and_odd_records(spark):
    records = [
        json.dumps({"id": 1, "source": {"x": 2}, "messages": [{"role": "user", "content": "q", "weight": 0}, {"role": "assistant", "content": "a"}]}),
        json.dumps({"system": "s", "instruction": "q", "input": None, "output": "a", "id": 3}),
        '{"prompt": "\\ud800 q", "response": "\\ud83d\\ude00"}', "[" * 100_000, '{"a":' * 3000 + "1" + "}" * 3000, '{"messages": []}', "[]", "", '{"messages": ["x"]}',
        '{"messages[].role": 1, "messages[].content": 2}', '{"conv_id": 5, "turn": 4, "role": "human", "text": "t", "more": 1}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    found = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    unknown = [(None, None)]
    assert found == {
        0: [("user", "q"), ("assistant", "a")], 1: [("system", "s"), ("user", "q"), ("assistant", "a")], 2: [("user", "\ufffd q"), ("assistant", "\U0001f600")],
        3: unknown, 4: unknown, 6: unknown, 7: unknown, 8: unknown, 9: unknown, 10: [("human", "t")],
    }
    nested = spark.createDataFrame([(7, [("human", "q", 1), ("gpt", None, 2)], "x"), (8, [], "x"), (9, None, "x")], "conv_id long, conversations array<struct<from:string,value:string,n:int>>, id string")
    assert sorted(map(tuple, chat.turn_rows(nested).collect())) == [(7, 0, "user", "q"), (7, 1, "assistant", "")]
    flat = spark.createDataFrame([(1, "q", "", "a", 9)], "conv_id long, instruction string, input string, output string, n int")
    assert sorted(map(tuple, chat.turn_rows(flat).collect())) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turn_rows(spark.createDataFrame([(1,)], "a int"))


def test_quality_cut_bears_wrong_labels():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 0.2, 3000), rng.normal(-2, 0.3, 800)
    cut = quality.best_cut(good, bad)
    assert bad.max() < cut < good.min()
    noisy = quality.best_cut(np.append(good, [-3.0, -2.0]), np.append(bad, [1.1, 0.9]))
    assert bad.max() <= noisy <= good.min()
    assert quality.best_cut(np.array([1.0]), np.array([0.0])) == 0.5


def test_quality_cut_of_a_table(spark):
    schema, r = "score double, good long, bad long", np.random.default_rng(5)
    for few in (False, True):
        good, bad = r.normal(1, 1, 700), r.normal(0, 1, 500)
        good, bad = (np.round(x, 1) if few else x for x in (good, bad))
        rows = [(float(x), int((good == x).sum()), int((bad == x).sum())) for x in np.unique(np.concatenate([good, bad]))]
        assert quality.cut_of(spark.createDataFrame(rows, schema).repartition(7)) == quality.best_cut(good, bad)
    assert quality.cut_of(spark.createDataFrame([(1.0, 1, 0), (0.0, 0, 1)], schema)) == 0.5
    assert quality.cut_of(spark.createDataFrame([(1.0, 3, 2)], schema)) == 1.0
    for none in ([], [(1.0, 1, 0)], [(1.0, 0, 1)]):
        assert quality.cut_of(spark.createDataFrame(none, schema)) is None


def test_quality_learns_from_every_label(spark):
    """More labelled documents than were once looked at: each one's word is in the target."""
    n = 50_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("good").alias("text"))
    model = quality.learn(docs.unionByName(docs.limit(1).select((F.col("doc_id") + n).alias("doc_id"), F.lit("bad").alias("text"))), docs.select("doc_id", F.lit(True).alias("trusted")), threshold=0.0, buckets=1 << 8)
    good, bad = (quality._features([x], 1 << 8)[0][0] for x in (b"good", b"bad"))
    target, raw = np.full(1 << 8, 0.5), np.full(1 << 8, 0.5)
    for counts, texts in ((target, {b"good": n}), (raw, {b"good": n, b"bad": 1})):
        for text, times in texts.items():
            np.add.at(counts, quality._features([text], 1 << 8)[0], times)
    assert good != bad and np.array_equal(model.ratios, quality._log_ratios(target, raw))


def test_quality_against_plain_counts(spark):
    """Learning and verdict against a dictionary of features, with no array operations."""
    from syllabary.llm import shingles

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("Lorem ipsum dolor 12% sit amet sit sit".split()) for _ in range(rng.randint(20, 60)))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice("x$$ 99 %%a".split()) for _ in range(30))) for i in range(20)] + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i, i < 60) for i in (*range(0, 60, 2), *range(100, 120, 2))], "doc_id long, trusted boolean")
    size = quality.COUNTERS // 4

    def features(text):
        import re

        words, one = (text or "").split(), lambda w, low=True: int(shingles.word_hashes([w.encode()], low)[0][0])
        shapes = [re.sub(r"([Aa9x!-/:-@\[-`{-~])\1+", r"\1", "".join("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c for c in w)) for w in words]
        pair = lambda a, b: 1 if a == b else int(shingles.mixed(np.array([(one(a) * 3 + one(b) + 1) % 2**64], np.uint64))[0])
        return [one(w) % (2 * size) for w in words] + [2 * size + pair(a.lower(), b.lower()) % size for a, b in zip(words, words[1:], strict=False)] + [3 * size + one(s, False) % size for s in shapes]

    every = {i: features(t) for i, t in rows}
    raw, target = np.full(4 * size, 0.5), np.full(4 * size, 0.5)
    for i, own in every.items():
        for f in own:
            raw[f] += 1
            target[f] += i < 60 and i % 2 == 0
    model = quality.learn(docs, trusted)
    ratios = np.clip(np.log(target / target.sum() * raw.sum() / raw), -6, 6)
    assert np.allclose(model.ratios, ratios)
    found = {r["doc_id"]: r for r in quality.judge(docs, model, ["doc_id"]).collect()}
    for i, own in every.items():
        want = np.mean([ratios[f] for f in own]) if own else 0.0
        assert found[i]["score"] == pytest.approx(want)
        assert found[i]["kept"] == (not found[i]["base_failed"] and want >= model.threshold)


def test_pipeline_stages_return_documents(spark):
    import corpus_pipeline

    folder, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, size = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        assert docs.count() <= size
        size = docs.count()
    assert docs.select("doc_id").distinct().count() == size > 100
