"""Token files and packing against the tokenizer itself, and the coder and the solver on their own."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syllabary.llm import packing, token_file, tokens

ROWS = [
    (3, "It's  a test.\n\n  Ünïcode ~ marks ~~ and 123 numbers!", "x"),
    (1, "", "x"), (2, None, "x"), (None, "no id", "x"), (5, "same", "x"), (5, "same", "x"), (4, "word " * 9000, "x"), (9, "<|endoftext|> plain", "x"),
    (10, "hello <|endoftext|> there<|startoftext|><|ENDOFTEXT|> <|endoftext|", "x"),
]
SCHEMA = "doc_id long, text string, ids string"


@functools.cache
def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def direct(name: str, text: str | None, end: int) -> np.ndarray:
    return np.array([*library(name).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\tab~'1é.,İ<|-A", "<|endoftext|>", "<|startoftext|>"]), max_size=40).map("".join), max_size=6))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(name, texts):
    encoder = tokens.load(public_tokenizers.path(name))
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == direct(name, text, 0)[:-1].tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_are_looked_up_once(name):
    """However many marks follow them, and in capitals or not where the tokenizer takes both alike."""
    encoder = tokens.ChunkTokenizer(public_tokenizers.path(name))
    texts = [f"x {w}{m} {w}. a" for w in ("éclatant", "Éclatant") for m in (*".,;:!?|*$%&#", "!!!", "***", ".'s", "'s", "1", "~")]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == direct(name, text, 0)[:-1].tolist()
    assert sum("clatant" in w and not w.endswith(("'s", "1", "~")) for w in encoder.new) == (2 if name.startswith("byte") else 1)


def test_ends_and_beginnings_of_lines_are_looked_up_apart():
    encoder = tokens.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ends, begins = ["fin", "été.", "über!!", "x1", "don't", "a~"], ["Bon", "Élan", "ÿ", "2nd", "(so)", "ªº", "мир", "İ", "\u2003a", "'s", "- b"]
    breaks = ["\n", "\n\n", "\n\n\n", " \n", "  \n", "\n ", "\n  \n", "\r\n", "\n\t", "\u00a0\n", "\n\u00a0", "\x00\n"]
    texts = [f"{first}x {a}{mid}{b} y{last}" for a in ends for b in begins for mid in breaks for first, last in (("", ""), ("\n", "\n"), (" \n", " \n"), ("\n\n", "\n\n"))]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == direct("byte_bpe_50k.json", text, 0)[:-1].tolist()
    encoder = tokens.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    words = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    encoder.encode([f"x {a}.\n{b} y" for a in words for b in words])
    assert len(encoder.new) == 2 * len(words) + 1  # not one for each two of them


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_lookup_keeps_its_bound(name):
    encoder = tokens.ChunkTokenizer(public_tokenizers.path(name), kept=1000)
    for i in range(12):
        texts = [" ".join(f"w{(i * 400 + k) % 3600}x" for k in range(400)), f"  w{i}  x\n y", ""]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == direct(name, text, 0)[:-1].tolist()
        assert len(encoder.new) <= 1000 and len(encoder.old) <= 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=3000), st.integers(9, 18))
def test_codes_round_trip(ids, longest):
    ids = np.array(ids, np.int64)
    lengths = token_file.code_lengths(np.bincount(ids, minlength=1), longest)
    assert lengths.max(initial=0) <= longest and sum(0.5 ** float(n) for n in lengths[lengths > 0]) <= 1
    book = token_file.Codebook(lengths)
    checkpoints, payload = book.encode(ids)
    assert book.decode(checkpoints, payload, len(ids)).tolist() == ids.tolist()


def test_code_lengths_are_optimal_within_the_limit():
    assert token_file.code_lengths(np.array([1, 1, 2, 4, 8])).tolist() == [4, 4, 3, 2, 1]
    assert token_file.code_lengths(np.array([1, 1, 2, 4, 8]), 3).tolist() == [3, 3, 3, 3, 1]
    assert token_file.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_token_file(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = f"file://{tmp_path}/f"
    token_file.write(df, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    found = token_file.load(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 4, 5, 5, 9, 10]
    texts, start = {r[0]: r[1] for r in ROWS}, 0
    for r in found:
        ids = direct("byte_bpe_50k.json", texts[r["doc_id"]], 0)
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), ids.tobytes())
        start += len(ids)


def test_token_file_of_nothing(spark, tmp_path):
    token_file.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/f", public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    assert token_file.load(spark, f"file://{tmp_path}/f").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=16, max_size=16))
def test_patterns_hold_every_piece(demand):
    demand = np.array(demand)
    patterns = packing.plan(demand, 16)
    held = sum((p * n for p, n in patterns), np.zeros(16, np.int64))
    assert (held >= demand).all() and all((p * np.arange(1, 17)).sum() <= 16 and n > 0 for p, n in patterns)
    least = int((demand * np.arange(1, 17)).sum())
    assert sum(n for _, n in patterns) <= 1.3 * least / 16 + 12 + demand[8:].sum()


def test_every_added_token_is_one_id(spark, tmp_path):
    """As the library gives them, through the registered queries too."""
    from syllabary.llm import queries

    texts = {i: f"a{x}b {x} c" for i, x in enumerate(["<|endoftext|>", "<|startoftext|>", "</w>", "Ġ"])}
    for name, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 2)):
        encoder = tokens.load(public_tokenizers.path(name))
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(list(texts.values()))] == [direct(name, t, end)[:-1].tolist() for t in texts.values()]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    for name, end, query in (("byte_bpe_50k.json", 0, "op1_token_file"), ("word_bpe_49k.json", 2, "op7_pack_sequences")):
        rows = queries.QUERIES[query](spark, f"file://{tmp_path}").collect()
        assert {r["doc_id"]: r["ids_crc32"] for r in rows} == {i: zlib.crc32(direct(name, t, end).tobytes()) for i, t in texts.items()}


@pytest.mark.parametrize("length", [1, 6, 17, 41, 201, 511])
def test_little_padding_at_any_length(length):
    n = 400 * 4096 // length
    found = packing.Seats({length: n}, 4096).find(length, np.arange(n))
    assert np.bincount(found).max() * length <= 4096 and n * length >= 0.98 * 4096 * len(np.unique(found))


def test_seats_hold_what_they_say():
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.random.default_rng(3).integers(1, 4097, 3000), return_counts=True), strict=True)}
    seats, used = packing.Seats(counts, 4096), np.zeros(6000, np.int64)
    for length, n in counts.items():
        np.add.at(used, seats.find(length, np.arange(n)), length)
    assert used.max() <= 4096 and sum(k * n for k, n in counts.items()) >= 0.97 * 4096 * np.count_nonzero(used)


def test_packing(spark):
    rows = packing.pack(spark.createDataFrame(ROWS, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), end_id=2, sequence=256).collect()
    assert packing.pack(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json"), end_id=2).count() == 0
    texts, by_doc = {r[0]: r[1] for r in ROWS}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len(by_doc[5]) == 2 and set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids = direct("word_bpe_49k.json", texts[key], 2).tobytes()
        for r in pieces:
            assert bytes(r["ids"]) == ids[4 * r["start"] : 4 * (r["start"] + r["length"])] and r["doc_tokens"] == len(ids) // 4
    for number in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == number), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert zlib.crc32(bytes(rows[0]["ids"])) == spark.createDataFrame([rows[0]]).select(F.crc32("ids")).first()[0]
