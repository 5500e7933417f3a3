"""Every registered catalogue query against its SQL, on a small table set."""

from __future__ import annotations

import importlib
import sys

import duckdb
import pytest

from syllabary.jobs import catalogue, intake, teaching  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    return str(value)[:10] if hasattr(value, "year") else float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    rows = sorted(str([plain(r[c]) for c in sorted(names)]) for r in found.collect())
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert rows == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())


def test_entry_copes_without_corpus_parts(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLES)
    assert not any(m.startswith("syllabary.llm") for m in vars(catalogue)) and "syllabary.jobs.catalogue" in sys.modules
