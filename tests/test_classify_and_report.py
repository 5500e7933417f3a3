"""Classification, keyword gates, exclusion and totals."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from syllabary.functions import classify, text
from syllabary.operators import report

ROLES = {"full": ("full professor",), "other full": ("full professor elsewhere",), "rector": ("rector",), "x": ()}


def test_longest_alias_decides(spark):
    df = spark.createDataFrame([("A FULL Professor elsewhere",), ("full professor",), ("English director",), ("cook",), ("",), (None,)], "x string")
    out = classify.classify_distinct(df, "x", ROLES, "y")
    assert dict((r["x"], r["y"]) for r in out.collect()) == {"A FULL Professor elsewhere": "other full", "full professor": "full", "English director": "rector", "cook": None, "": None, None: None}
    raw = df.select("x", classify.or_raw(F.col("x"), ROLES).alias("r")).filter("x = 'cook' or x is null").orderBy("x")
    assert [tuple(r["r"]) for r in raw.collect()] == [("", False), ("cook", False)]


def test_one_alias_for_two_keys_is_an_error(spark):
    with pytest.raises(ValueError, match="stands for both"):
        classify.checklist({"a": ("z",), "b": ("z",)})
    assert classify.duplicate_aliases(classify.aliases_of(spark, {"a": ("z", "y"), "b": ("z",)})).collect()[0]["alias"] == "z"


def test_keywords(spark):
    df = spark.createDataFrame([("Deep LEARNING course",), ("cooking",), (None,)], "x string")
    found = [r[0] for r in df.select(text.keywords_found(F.col("x"), ("Learning", "deep", " "))).collect()]
    assert found[:2] == [["learning", "deep"], []]


def test_exclusion_keeps_people_and_nulls(spark):
    offered = spark.createDataFrame([("ann", "01", "x", None), ("ann", "02", "y", 6), ("bob", "01", "x", None)], "person string, id string, name string, credits int")
    known = spark.createDataFrame([("01", "x", None)], "id string, name string, credits int")
    left = report.without_known(offered, known, ["id", "name", "credits"])
    people = report.nested_by_person(offered, left, ["person"], ["id", "name", "credits"])
    assert {r["person"]: [tuple(c) for c in r["courses"]] for r in people.collect()} == {"ann": [("02", "y", 6)], "bob": []}
    grouped = report.department_courses(people.withColumn("department", F.lit(" d ")))
    assert [(r["department"], len(r["courses"])) for r in grouped.collect()] == [("d", 1)]
    totals = report.credit_totals(people.withColumn("department", F.lit("")), keep=("person",))
    assert {r["person"]: (r["department"], r["credits"]) for r in totals.collect()} == {"ann": ("(no department)", 6), "bob": ("(no department)", 0)}


def test_light_course_defaults(spark):
    df = spark.createDataFrame([("1", None, None), ("2", "n", [3, 4])], "id string, name string, credits array<int>")
    assert [tuple(r) for r in report.light_course(df).orderBy("id").collect()] == [("1", "Unknown", 0), ("2", "n", 3)]


def test_limit_counts_ok_rows(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "i int, ok boolean")
    for limit, last in ((0, []), (2, [0, 1, 2]), (99, list(range(10)))):
        assert sorted(r["i"] for r in report.first_ok(df, F.col("ok"), ["i"], limit).collect()) == last


def brute_class(value, aliases):
    fit = [(len(a), -i, k) for a, k, i in aliases if value is not None and a in value.strip().lower()]
    return max(fit)[2] if fit else None


def test_alias_tables_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randint(low, high)))
    aliases = [(a, f"k{i % 5}", i) for i, a in enumerate(sorted({word(1, 9) for _ in range(300)}, key=hash))]
    values = [word(0, 14) for _ in range(200)] + ["", None, " AbC ", "zz", "zz"]
    df = spark.createDataFrame([(v, i, "x") for i, v in enumerate(values)], "value string, place int, class string")
    told = spark.createDataFrame(aliases + [(None, "k", 999)], "alias string, key string, place long")
    found = classify.classify_by_table(df, "value", told, "class").collect()
    assert {r["place"]: r["class"] for r in found} == {i: brute_class(v, aliases) for i, v in enumerate(values)} and len(found) == len(values)
    with_default = classify.classify_by_table(df, "value", told.unionByName(spark.createDataFrame([("", "none", 5)], told.schema)), "class")
    assert {r["place"]: r["class"] for r in with_default.collect()} == {i: brute_class(v, [*aliases, ("", "none", 5)]) for i, v in enumerate(values)}
    assert classify.classify_by_table(df, "value", told.limit(0), "class").filter("class is not null").count() == 0
    assert classify.classify_by_table(df.limit(0), "value", told, "class").count() == 0
    with pytest.raises(ValueError, match="several keys"):
        classify.classify_by_table(df, "value", told.unionByName(told.limit(1).withColumn("key", F.lit("other"))), "class")


def test_a_dictionary_of_a_hundred_thousand_aliases(spark):
    aliases = {f"dept {i}": (f"department {i:06d}", f"d{i}x") for i in range(50_000)}
    assert sum(map(len, aliases.values())) == 100_000
    values = [f"The Department {i:06d} of d{i + 1}x" for i in range(0, 50_000, 97)] + ["department", "d49999", None]
    df = spark.createDataFrame([(v,) for v in values], "said string")
    found = classify.classify_distinct(df, "said", aliases, "class").collect()
    flat = {a: k for k, own in aliases.items() for a in own}
    want = {v: flat.get(v.lower()[4:21]) if v else None for v in values}
    assert {r["said"]: r["class"] for r in found} == want
    assert sum(c is not None for c in want.values()) == len(values) - 3


def test_keyword_tables_equal_brute_force(spark):
    texts = ["Deep LEARNING course, " * 400, "cooking", "", None, "ab", "cooking"]
    words = ["Learning", " deep", "b", "", None, "zebra", "course, deep"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = classify.keywords_by_table(df, "text", spark.createDataFrame([(w,) for w in words], "keyword string"), "found").collect()
    plain = sorted({w.strip().lower() for w in words if w and w.strip()})
    assert {r["i"]: r["found"] for r in found} == {i: [w for w in plain if w in (t or "").lower()] for i, t in enumerate(texts)}


def numbered(spark, aliases, values):
    """Numbers as aliases, and values that hold many of them, as ``c1_classify_by_table`` has."""
    told = spark.range(aliases).select(F.col("id").cast("string").alias("alias"), F.concat(F.lit("k"), F.col("id") % 97).alias("key"), F.col("id").alias("place"))
    return told, spark.range(values).select("id", F.concat(F.col("id") * 7919 % 1_000_003, F.lit("/"), F.col("id") * 104_729 % 100_003).alias("said"))


def brute_number(said, aliases):
    fit = {said[i:j] for i in range(len(said)) for j in range(i + 1, len(said) + 1)}
    fit = [x for x in fit if x.isdecimal() and str(int(x)) == x and int(x) < aliases]
    return f"k{int(min(fit, key=lambda x: (-len(x), int(x)))) % 97}" if fit else None


def test_values_stay_where_they_lie(spark):
    """Nothing of them is written or shuffled, however many aliases they hold."""
    from pathlib import Path

    from syllabary.sources.shared import shared_folder

    told, rows = numbered(spark, 3000, 5000)
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.rglob("*.parquet"))
    found = classify.classify_by_table(rows, "said", told, "class")
    assert {r["said"]: r["class"] for r in found.collect()} == {r["said"]: brute_number(r["said"], 3000) for r in rows.collect()}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - before) < 100_000


def test_aliases_of_several_blocks(spark, monkeypatch):
    from syllabary.functions import matching

    monkeypatch.setattr(matching, "MOST", 100)
    told, rows = numbered(spark, 1000, 300)
    table = told.unionByName(spark.createDataFrame([("", "none", None), ("à l'été 😀", "é", 5), ("7/", "k", 7), ("/7", "l", 6)], "alias string, key string, place long"))
    more = rows.unionByName(spark.createDataFrame([(-1, "À L'ÉTÉ 😀 1234567"), (-2, ""), (-3, None), (-4, " x7/7x ")], "id long, said string"))
    found = {r["id"]: r["class"] for r in classify.classify_by_table(more, "said", table, "class").collect()}
    flat = [(r["alias"], r["key"], r["place"]) for r in table.collect()]

    def best(said):
        return min((-len(a), 10**9 if p is None else p, k) for a, k, p in flat if a in said.strip().lower())[2] if said is not None else None

    assert found == {r["id"]: best(r["said"]) for r in more.collect()} and found[-1] == "é" and found[-2] == "none" and found[-4] == "l"
    lists = classify.keywords_by_table(more, "said", told.select(F.col("alias").alias("keyword")), "found")
    assert {r["id"]: r["found"] for r in lists.collect()} == {r["id"]: sorted(str(a) for a in range(1000) if str(a) in (r["said"] or "")) for r in more.collect()}


def test_texts_meet_keywords_where_they_lie(spark):
    """Texts are neither cut into rows nor shuffled, whatever their length; long ones equal brute force."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words + ["zz", "ZE"]) for _ in range(n)).title() for n in (0, 1, 40, 40_000, 3)] + [None, "é" * 200_000 + words[7]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = classify.keywords_by_table(df, "text", spark.createDataFrame([(w,) for w in words], "keyword string"), "found")
    assert {r["i"]: r["found"] for r in found.collect()} == {i: sorted({w for w in words if w in (t or "").lower()}) for i, t in enumerate(texts)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
