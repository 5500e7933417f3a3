"""Registered queries over whole small tables: against their SQL, or against plain Python where SQL can't express them."""

from __future__ import annotations

import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from syllabary.llm import chat, queries, quality, toxicity
from syllabary.llm.common import Scratch
from tests.llm.test_duplicates_and_lines import brute_components, words_of
from tests.llm.test_scores_chat_search import levenshtein
from tests.llm.test_token_file_and_packing import direct

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, want = queries.QUERIES[name](spark, FOLDER), duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in found.collect()) == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())


def test_near_duplicates_query(spark, documents):
    want, sizes = brute_components(documents, 85)
    found = queries.QUERIES["op3_near_duplicates"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in found} == {i: (want[i], sizes[i], want[i] == i) for i, _ in documents}


def test_token_file_query(spark, documents):
    start, want = 0, {}
    for i, text in documents:
        ids = direct("byte_bpe_50k.json", text, 0)
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op1_token_file"](spark, FOLDER).collect()} == want


def test_packing_query(spark, documents):
    used, covered, texts = {}, {}, dict(documents)
    for r in queries.QUERIES["op7_pack_sequences"](spark, FOLDER).collect():
        ids = direct("word_bpe_49k.json", texts[r["doc_id"]], 2)
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {i: len(direct("word_bpe_49k.json", t, 2)) for i, t in documents}
    for spans in used.values():
        assert [a for a, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1].tolist()] and sum(n for _, n in spans) <= 4096
    assert sum(covered.values()) >= 0.95 * 4096 * (len(used) - 1)


def test_toxicity_scores_against_plain_matching(spark):
    """Every word against every term by edit distance, and the logistic sum by hand."""
    entries = (("idiot", 0.9), ("worthless", 0.8), ("bad*", 0.5), ("moron", 1.0), ("dumb", 0.7))
    model = toxicity.Model(entries, frozenset(["moron"]), (-2.0, 3.0, -1.0, 0.5, 4.0))
    texts = ["you idoit and idiiot", "he said idiot once", '"what an idiot you are" he wrote', "wrthles wurthles badly moron moroon dum dumb", "", None, "fine words only", "IDIOT! " * 30 + "x " * 100]

    def best(word):
        word = word.strip(toxicity._EDGES)
        for stem, weight in entries:
            if stem.endswith("*") and word.startswith(stem[:-1]):
                return weight
        found = [w * 0.8**d for t, w in entries if not t.endswith("*") and (d := levenshtein(t, word)) <= (0 if t in model.exact else toxicity.edits_allowed(t))]
        return max(found, default=0.0)

    def score(text):
        words = (text or "").lower().split()
        weights = [best(w) for w in words]
        quotes, quoted, abuse = set(toxicity.QUOTES), 0.0, [0.0] * len(words)
        for i, w in enumerate(weights):
            before, after = words[max(0, i - 6) : i + 1], words[i : i + 7]
            said = any(x.strip(toxicity._EDGES) in toxicity.REPORTS for x in words[max(0, i - 3) : i])
            if w and (said or (any(x[0] in quotes for x in before) and any(x.rstrip(".,;:!?")[-1:] in quotes for x in after))):
                quoted += w
            else:
                abuse[i] = w
        dense = max((sum(abuse[max(0, i - 60) : i + 1]) for i in range(len(words)) if abuse[i]), default=0.0)
        x = (1, math.log1p(sum(abuse)), math.log1p(quoted), math.log1p(dense), sum(abuse) / max(len(words), 1))
        return 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(model.weights, x, strict=True))))))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert found == {i: pytest.approx(score(t)) for i, t in enumerate(texts)}
    x = np.array([-3.0, -3.0, -1.0, 0.5, 2.0])
    assert toxicity.shift(x, np.array([0, 1, 0, 1, 1])) == pytest.approx(math.log(7 / 3) + 0.25) and toxicity.shift(x, np.ones(5)) == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    """Each stage on what its predecessor kept: who stays, which lines and copies go, what is mixed, and what ids are packed."""
    passage = "\n".join(" ".join(words_of(40, s)) for s in (901, 902))
    near = words_of(120, 77)
    texts = {i: " ".join(words_of(60 + i, i)) for i in range(60)}
    texts |= {60: f"{texts[60 % 7]}\nown start here\n{passage}", 61: f"{passage}\n" + " ".join(words_of(80, 61)), 62: " ".join(near), 63: " ".join([*near[:-1], "other"]), 64: " ".join(near), 65: "short", 66: "", 67: "%%% 9 " * 40}
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in texts.items()] + [(68, None, "en", None, None), (None, " ".join(words_of(70, 500)), None, "a", 1), (5, texts[5], "xx", "c", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(67, 0, 1), (65, 0, 0), (None, 1, None), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    folder, scratch = f"file://{tmp_path}", Scratch(spark, "test")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, folder), name.replace(" ", "-"))
        assert docs.columns == columns or name == "packing"
        kept[name] = [r.asDict() for r in docs.collect()]
    ids = lambda name: sorted((r["doc_id"] for r in kept[name]), key=str)
    trusted = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("trusted")).filter("trusted is not null")
    model = quality.learn(spark.read.parquet(f"{folder}/documents.parquet"), trusted)
    want = []
    for i, t, *_ in rows:
        n, _, _, _, repeated = quality.base_counts(t or "")
        features = quality._features([(t or "").encode()], len(model.ratios))[0]
        if n >= 20 and 100 * repeated <= 30 * n and float(model.ratios[features].mean()) >= model.threshold:
            want.append(i)
    assert ids("quality rules") == sorted(want, key=str) and {*range(60)} <= set(want) and 67 not in want
    lines = {r["doc_id"]: r["text"] for r in kept["line dedup"]}
    assert lines[60].endswith(passage) and lines[61] == texts[61].split("\n")[2] and texts[60 % 7] not in lines[60] and 64 not in lines
    assert all(lines[i] == texts[i] for i in range(60) if i in lines)
    left = [(r["doc_id"], r["text"]) for r in kept["line dedup"] if r["doc_id"] is not None]
    roots, _ = brute_components(sorted(set(left)), 80)
    assert ids("near-dedup") == sorted([*{i for i in roots if roots[i] == i}, None], key=str) and 63 not in ids("near-dedup")
    sizes, taken = {}, {}
    whole = {r["doc_id"]: (r["source"], r["text"].split()) for r in kept["near-dedup"]}
    for i, (source, words) in whole.items():
        sizes[source] = sizes.get(source, 0) + len(words)
    for r in kept["mixing"]:
        source, words = whole[r["doc_id"]]
        own = r["text"].split()
        assert own and r["source"] == source and set(own) <= set(words) and r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(own)
    assert all(n <= 2 * len(whole[i][1]) for i, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 0.1 * sum(sizes.values())
    want_ids = sorted(direct("word_bpe_49k.json", r["text"], 2).tobytes() for r in kept["mixing"])
    pieces = {}
    for r in kept["packing"]:
        pieces.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(bytes(r["ids"]))
    assert sorted(x for (_, n, start), found in pieces.items() for x in found) == want_ids and all(start == 0 for _, _, start in pieces)
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()))) == sorted(str(r["doc_id"]) for r in kept["packing"])


def test_chat_query_over_its_table(spark):
    """Every conversation's digests, and those of the one made of control strings, from plain Python."""
    turns = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: r for r in queries.QUERIES["op4_chat_format"](spark, FOLDER).collect()}
    assert found.keys() == turns.keys()
    for i, own in turns.items():
        own = sorted(own)
        said, learnt = "".join(f"{role}\n{text}\n" for _, role, text in own), "".join(text for _, role, text in own if role == "assistant")
        r = found[i]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r["formatted_chars"] >= len(said)


def test_a_fingerprint_selects_the_mapping(spark):
    rows = [(1, '{"messages": [{"role": "user", "content": "a"}], "n": 1}'), (2, '{"n": 2, "messages": [{"content": "b", "role": "gpt"}]}'), (3, '{"prompt": "p", "response": "r"}'), (4, '{"zzz": 1}'), (5, "[1]"), (6, None)]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    layouts = {r["fingerprint"]: r["mapping"] for r in chat.known_layouts(df).collect()}
    names = {k: None if m is None else chat.MAPPINGS[m].name for k, m in layouts.items()}
    assert names == {chat.fingerprint(["messages[].role", "messages[].content", "n"]): "messages", chat.registry(chat.MAPPINGS)[chat.fingerprint(["prompt", "response"])].fingerprint: "prompt and response", chat.fingerprint(["zzz"]): None}
    found = sorted((r["conv_id"], r["turn"] if r["turn"] is not None else -1, r["role"], r["text"]) for r in chat.canonical_turns(df).collect())
    assert found == [(1, 0, "user", "a"), (2, 0, "assistant", "b"), (3, 0, "user", "p"), (3, 1, "assistant", "r"), (4, -1, None, None), (5, -1, None, None), (6, -1, None, None)]


def test_toxicity_query_learns_apart_from_the_held_out_third(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_toxicity"](spark, FOLDER).collect()}
    docs = [r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    assert sorted(found) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in found.items())
    held = [(labels[i], r["predicted"]) for i, r in found.items() if r["held_out"] and labels.get(i) is not None]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)


def test_quality_query_against_its_functions(spark, documents):
    model = queries.quality_model(spark, FOLDER)
    assert len(model.ratios) == quality.COUNTERS
    found = {r["doc_id"]: r for r in queries.QUERIES["op10_quality_rules"](spark, FOLDER).collect()}
    assert sorted(found) == [i for i, _ in documents]
    for i, text in documents:
        n, chars, symbols, lines, repeated = quality.base_counts(text or "")
        r, failed = found[i], n < 20 or 100 * repeated > 30 * n
        features = quality._features([(text or "").encode()], len(model.ratios))[0]
        score = float(model.ratios[features].mean()) if len(features) else 0.0
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, repeated, failed)
        assert r["kept"] == (not failed and score >= model.threshold)
