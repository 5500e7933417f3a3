"""Global places, line numbers over several splits, and links resolved in the JVM."""

from __future__ import annotations

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from syllabary.functions import text
from syllabary.operators import ranks
from syllabary.sources import files


def test_global_rank_equals_sorting(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 7]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int, place string").repartition(5)
    ranked = ranks.global_rank(df, [("v", True), ("i", False)], ranges=6)
    found = {r["i"]: r["place"] for r in ranked.collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert found == {r[0]: n for n, r in enumerate(order, 1)}
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranks.global_rank(df.limit(0), [("i", False)]).count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rng = random.Random(6)
    want = {}
    for name in "ab":
        lines = ["x,y"] + [f"{i},{rng.choice(['', '  ', 'v' * rng.randint(1, 40)])}" for i in range(900)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        want |= {(name, n): line.split(",")[1].strip() for n, line in enumerate(lines[1:], 2)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = spark.read.csv(str(tmp_path), header=True)
        assert read.rdd.getNumPartitions() > 8
        numbered = ranks.numbered_lines(read.select("*", F.regexp_extract("_metadata.file_path", "([ab]).csv", 1).alias("f"), "_metadata"), first=2)
        assert {(r["f"], r["line"]): (r["y"] or "").strip() for r in numbered.select("f", "line", "y").collect()} == want
        filled = [(n, v) for (f, n), v in sorted(want.items()) if f == "a" and v]
        for limit in (None, 0, 3):
            found = files.read_column(spark, str(tmp_path / "a.csv"), "y", limit)
            assert sorted((r["line"], r["value"]) for r in found.collect()) == filled[: len(filled) if limit is None else limit]
        assert {r["n"]: r["x"] for r in files.read_csv(spark, str(tmp_path / "b.csv"), ("x",), line="n").collect()} == {n: str(n - 2) for n in range(2, 902)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="missing column: z"):
        files.read_column(spark, str(tmp_path / "a.csv"), "z")


BASES = ["http://a/b/c/d;p?q", "http://a", "https://x.invalid/a/b/", "http://a/b/c/../d?x=/y#z", "HTTP://User@Host:80//e//f?", "file:///etc/x", ""]
LINKS = [
    "", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g",
    "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/../x", "mailto:a@b", "javascript:void(0)", "https://other/x y/../z", "//h?q", "//h/a/../b", "a//b", "//[::1]/x", "http://[bad/", "http://a]/", "é/ü?ß", " g ", "g\th",
    "http:", "http:g", "tel:+1", "1a:b", "a:b/c", "?", "#", "/", "//", "g?a=1&b=//x",
]


def test_links_resolve_as_the_library_does(spark):
    def want(base, href):
        try:
            return urljoin(base, href) if href else ""
        except ValueError:
            return None

    pairs = [(b, h) for b in BASES for h in LINKS]
    df = spark.createDataFrame([(*p, want(*p)) for p in pairs] + [(None, "g", "g"), ("http://a/b", None, "")], "base string, href string, want string")
    found = df.select("*", text.resolved(F.col("base"), F.col("href")).alias("got")).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert [tuple(r) for r in found] == []
    assert "Python" not in df.select(text.resolved(F.col("base"), F.col("href")))._jdf.queryExecution().executedPlan().toString()
