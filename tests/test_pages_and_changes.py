"""Discovery, the page table and change sets, against plain Python on small tables."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from syllabary.functions import site
from syllabary.operators import changes, discovery
from syllabary.sources import page_table


def test_discovery_follows_every_link_once(spark):
    rng = random.Random(6)
    named = {i: [rng.randrange(90) for _ in range(rng.randrange(4))] for i in range(60)}
    named[0] = [1, 2, 3]
    html = [(f"https://x.invalid/{i}", "".join(f"<a href='{j}'>x</a>" for j in own) + "<a href='#top'>t</a><a>none</a>") for i, own in named.items()]
    facts = site.read_pages(spark.createDataFrame(html, "url string, html string")).cache()
    found = discovery.discover(spark.createDataFrame([("https://x.invalid/0",), (None,), ("",)], "url string"), lambda rows: discovery.linked(rows, facts))
    want, frontier, number = {"https://x.invalid/0": 0}, [0], 0
    while frontier:
        number += 1
        new = {f"https://x.invalid/{j}": j for i in frontier for j in named.get(i, [])} | {f"https://x.invalid/{i}#top": None for i in frontier if 0 <= i < 60}
        new = {u: j for u, j in new.items() if u not in want}
        want |= dict.fromkeys(new, number)
        frontier = [-1 if j is None else j for j in new.values()]
    got = {r["url"]: r["round"] for r in found.collect()}
    assert got == want and len(got) > 20
    assert discovery.discover(spark.createDataFrame([], "url string"), lambda rows: rows).count() == 0


def test_pagers_lead_to_all_pages(spark):
    pages = [("https://x.invalid/l?page=1", "<p id='pages_before'><i class='totalPageNumber'>page 1 of 3</i></p>"), ("https://x.invalid/m", "<p id='pages_before'><i class='totalPageNumber'>all</i></p>"), ("https://x.invalid/n", "none")]
    facts = site.read_pages(spark.createDataFrame(pages, "url string, html string"))
    found = discovery.paged(spark.createDataFrame([(u,) for u, _ in pages], "url string"), facts)
    assert sorted(r["url"] for r in found.collect()) == ["https://x.invalid/l?page=1", "https://x.invalid/l?page=2", "https://x.invalid/l?page=3", "https://x.invalid/m?page=1"]


def test_page_table_keeps_the_newest(spark, tmp_path):
    rng, path, known = random.Random(7), str(tmp_path / "table"), {}
    day = lambda n: datetime.datetime(2025, 1, 1) + datetime.timedelta(days=n)
    assert page_table.read(spark, path).count() == 0
    schema = "url string, code int, html string, fetched_at timestamp"
    batches = []
    for number in range(4):
        rows = [(f"u{rng.randrange(30)}", rng.choice([200, 200, 404, 500]), f"h{number}-{i}", day(rng.randrange(6))) for i in range(25)] + [(None, 200, "x", day(1)), ("u1", 200, "x", None), ("u2", None, "x", day(9)), (f"n{number}", 200, None, day(1))]
        batches.append(rows)
    for number, rows in enumerate(batches):
        for _ in range(2 if number == 2 else 1):  # a batch that is given again changes nothing
            page_table.upsert(spark.createDataFrame(rows, schema), number, path, slots=4)
        for url, code, html, at in rows:
            if url and at and code in (200, 404):
                one = (at, "ok" if code == 200 else "skip", (html or "") if code == 200 else "")
                known[url] = max(known.get(url, one), one)
        found = {r["url"]: (r["fetched_at"], r["status"], r["html"] or "") for r in page_table.read(spark, path).collect()}
        assert found == known
    page_table.upsert(spark.createDataFrame([], schema), 9, path, slots=4)
    held = page_table.read(spark, path)
    assert held.count() == len(known)
    asked = spark.createDataFrame([("u1",), ("n0",), ("zzz",), (None,)], "at string")
    states = {r["at"]: r["page_state"] for r in page_table.look_up(asked, "at", held, F.lit("2025-01-03").cast("timestamp")).collect()}
    assert states["zzz"] == states[None] == "unknown" and states["n0"] == "stale"


def test_change_sets(spark):
    there = spark.createDataFrame([("a", "link", "1"), ("b", "link", "old"), ("c", "file", None), ("d", "folder", None), ("e", "link", "5"), ("f", "folder", None), ("g", "file", None), ("i", "link", None)], "path string, kind string, target string")
    wanted = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("h", "8"), ("t", "1"), ("t", "2"), (None, "x"), ("i", "9")], "path string, target string")
    found = changes.change_set(there, wanted)
    want = {"a": "keep", "b": "replace", "c": "replace", "d": "conflict", "e": "delete", "g": "delete", "h": "create", "t": "conflict", "i": "replace"}
    assert {r["path"]: r["action"] for r in found.collect()} == want and set(want.values()) == set(changes.ACTIONS)
    after = changes.applied(there, found)
    assert {(r["path"], r["kind"], r["target"]) for r in after.collect()} == {("a", "link", "1"), ("b", "link", "2"), ("c", "link", "3"), ("d", "folder", None), ("f", "folder", None), ("h", "link", "8"), ("i", "link", "9")}
    assert {r["path"]: r["action"] for r in changes.change_set(after, wanted).collect()} == {p: "conflict" if p in "dt" else "keep" for p in "abcdhti"}
    assert changes.change_set(there.limit(0), wanted.limit(0)).count() == 0
