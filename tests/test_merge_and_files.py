"""YAML records to merged courses, sections of pages, and the streaming intake."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.functions import markup, pages
from syllabary.operators.merge import letters, links_of, merge_courses
from syllabary.sources import files
from syllabary.sources.schemas import CONTACT
from syllabary.streaming import ingest


def teaching(teacher: str, number: str, **changes) -> dict:
    pages = {v: {"url": f"https://x.invalid/{v}/{number}", "title": "T", "contents": {"Aims": "a", "Texts": "b"}} for v in ("it", "en")}
    return {
        "year": 2025, "url": f"https://x.invalid/{number}", "credits": 6, "ssd": "A/01", "language": "English", "teaching_mode": "In person",
        "teacher": {"id": teacher, "name": teacher.title(), "email": f"{teacher}@x.invalid", "website": "", "role": "full", "affiliation": "d"},
        "course_title": {"id": "00077", "name": "LOGIC", "details": [number]}, "integrated_course": "", "campus": "North", "programme": "P", "syllabus": pages,
    } | changes


@pytest.fixture
def folder(tmp_path):
    import yaml

    other = {"it": {"url": "", "title": "T", "contents": {"Aims": "different"}}}
    rows = {
        "zoe/2025/teaching-1.yml": teaching("zoe", "1", schedule={"from": "2025-02-01", "to": "2025-03-01"}),
        "adam/2025/teaching-2.yml": teaching("adam", "2", credits=None, course_title={"id": "00077", "name": "Logic", "details": []}),
        "adam/2025/teaching-3.yml": teaching("adam", "3", syllabus=other),
        "adam/2025/teaching-4.yml": teaching("adam", "4", course_title={"id": "", "name": "NO ID", "details": []}),
        "too/deep/2025/teaching-5.yml": teaching("adam", "5"),
    }
    for name, row in rows.items():
        path = tmp_path / "courses" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(yaml.safe_dump({k: v for k, v in row.items() if v is not None}, allow_unicode=True))
    return str(tmp_path / "courses")


def test_merge_from_yaml(spark, folder):
    records = files.read_records(spark, folder)
    assert records.filter("error is null").count() == 4
    assert records.filter("file = 'teaching-1.yml'").first()["course_title"]["id"] == "00077"  # no octal number
    merged = {r["suffix"]: r for r in merge_courses(records).collect()}
    assert set(merged) == {"-A", "-B"}
    both = next(r for r in merged.values() if len(r["teachers"]) == 2)
    assert (both["course_id"], both["name"], both["credits"], both["ssds"], both["campi"]) == ("00077", "Logic", [6], ["A/01"], ["North"])
    assert [t["teacher"]["name"] for t in both["teachers"]] == ["Adam", "Zoe"]
    assert both["conflicts"] == ["course_title.name"] and len(both["schedules"]) == 1
    assert set(both["teachers"][0]["module"]["syllabus_urls"]) == {"it", "en"}
    assert links_of(merge_courses(records)).count() == 3


def test_stream_merges_touched_courses(spark, folder, tmp_path):
    rows = [r.asDict(True) | {"year": 2025} for r in files.read_records(spark, folder).drop("error", "year_dir").collect()]
    table = str(tmp_path / "table")
    for i, part in enumerate((rows[:2], rows[2:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r, default=str) for r in part))
        ingest.merge_stream(ingest.record_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "check")).awaitTermination()
    whole = merge_courses(files.read_records(spark, folder))
    assert sorted(map(tuple, ingest.latest(spark, table).select("suffix", "name", F.size("teachers")).collect())) == sorted(map(tuple, whole.select("suffix", "name", F.size("teachers")).collect()))


def record(teacher: str, file: str, course: str, **changes) -> dict:
    made = teaching(teacher, file, course_title={"id": course, "name": "N", "details": []})
    return {"teacher_dir": teacher, "file": file, **made, **changes}


def test_stream_takes_the_latest_version_and_moves_records(spark, tmp_path):
    table = str(tmp_path / "table")
    batches = [
        [record("zoe", "1", "C1"), record("adam", "2", "C1", credits=9), record("eve", "3", "C9")],
        [record("zoe", "1", "C2", credits=3)],
        [record("adam", "2", "C1", credits=12), record("adam", "2", "C1", credits=12)],
        [record("eve", "3", "C2")],
    ]
    for i, part in enumerate(batches):
        batch = spark.read.schema(ingest.RECORD).json(spark.sparkContext.parallelize([json.dumps(r, default=str) for r in part], 1))
        ingest.fold(batch, i, table)
        if i == 1:
            ingest.fold(batch, i, table)  # a repeated batch changes nothing
    found = {r["course_id"]: (r["credits"], [t["teacher"]["name"] for t in r["teachers"]]) for r in ingest.latest(spark, table).collect()}
    assert found == {"C1": ([12], ["Adam"]), "C2": ([6, 3], ["Eve", "Zoe"])}


def test_letters_of_any_length(spark):
    numbers = [0, 25, 26, 701, 702, 703, 18277, 18278]
    df = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", letters(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == dict(zip(numbers, ["A", "Z", "AA", "ZZ", "AAA", "AAB", "ZZZ", "AAAA"], strict=True))


def test_lists_dictionaries_and_merged_files(spark, tmp_path, folder):
    (tmp_path / "list.yml").write_text("- {id: 07276, name: A, credits: 6}\n- {id: B1, name: null, credits: x}\n")
    (tmp_path / "map.yml").write_text("a: [One, ' two ']\nb: []\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("credits", T.IntegerType())])
    assert [tuple(r) for r in files.read_list(spark, str(tmp_path / "list.yml"), schema).collect()] == [("07276", "A", 6, None), ("B1", None, None, None)]
    assert [tuple(r) for r in files.read_list(spark, str(tmp_path / "map.yml"), schema).collect()] == [(None, None, None, "not a list")]
    assert files.read_dictionary(spark, str(tmp_path / "map.yml")) == {"a": ("one", "two"), "b": ()}
    with pytest.raises(ValueError, match="not a dictionary"):
        files.read_dictionary(spark, str(tmp_path / "list.yml"))
    files.write_merged(merge_courses(files.read_records(spark, folder)), str(tmp_path / "merged"))
    assert sorted(r["file"] for r in spark.read.json(str(tmp_path / "merged")).filter("year = 2025").collect()) == ["course-00077-A.yml", "course-00077-B.yml"]


def test_markdown_keeps_words_apart(spark):
    cases = {
        "<p>Hello <b>big</b> world, see <a href='/x'>this</a> page.</p>": "Hello big world, see [this](/x) page.",
        "<table><tr><th>a</th><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>": "| a | 1 |\n\n| b | 2 |",
        "<pre>one\n  two</pre><p>a <code>x &lt; y</code></p>": "```\none\ntwo\n```\n\na `x < y`",
        "<head><title>t<body><p>all of it": "all of it", "<script>if (a < b) {}</script><style>p{}</style>x": "x", "<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>": "1. a\n\n- b\n\n2. c",
        "<title>x</title>": "", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r["h"]: r["m"] for r in df.select("h", markup.to_markdown(F.col("h")).alias("m")).collect()} == cases
    odd = spark.createDataFrame([("<!-- <a href='/no'>--><h1>A &amp; <i>B</i>&nbsp;</h1><a data-href='/no' href='p?x=1&amp;y=2'>l</a><a href='http://[bad/y'>m</a>",)], "h string")
    row = odd.select(markup.first_element(F.col("h"), "h1").alias("t"), markup.links(F.col("h")).alias("l")).first()
    assert row["t"] == "A & B" and row["l"] == ["p?x=1&y=2", "http://[bad/y"]
    links = odd.select(F.explode(markup.links(F.col("h"))).alias("l")).select(markup.absolute(F.lit("https://x.invalid/a/b"), F.col("l")).alias("l"))
    assert [r["l"] for r in links.collect()] == ["https://x.invalid/a/p?x=1&y=2", None]


def test_odd_pages_have_no_cards_and_no_person(spark):
    df = spark.createDataFrame([("",), (None,), ("</div><table class='contact vcard'><td class='fn name'>A<td>B",), ("x",)], "h string")
    rows = df.select(pages.contact_cards(F.col("h"), F.lit(None).cast("string")).alias("c"), pages.person_fields(F.col("h"), F.lit("")).alias("p"), pages.course_blocks(F.col("h"), F.lit("")).alias("b")).collect()
    assert [[c["name"] for c in r["c"] or []] for r in rows] == [[], [], ["A B"], []] and all(r["p"]["role"] == "" and not r["b"] for r in rows)


def test_csv_header_is_checked(spark, tmp_path):
    path = str(tmp_path / "contacts")
    files.write_csv(spark.createDataFrame([tuple("abcdefgh")], CONTACT), path)
    assert files.read_csv(spark, path, tuple(CONTACT.names)).count() == 1
    with pytest.raises(ValueError, match="missing columns: nope"):
        files.read_csv(spark, path, ("uid", "nope"))


def test_sections_and_details(spark):
    page = "# Title\n\nlost\n## Aims\n\none\n\n\n\ntwo\n# Other\nstill aims\n### Texts\n\n## Empty\n\n## Aims\nmore\n## Academic Year 2025/2026\n- Credits: 9\n"
    df = spark.createDataFrame([(1, page), (2, "no heading"), (3, None)], "page int, markdown string")
    parts = markup.sections(df, ["page"], "markdown")
    rest, details = markup.details_of(parts, ["page"])
    assert [(r["title"], r["body"]) for r in rest.orderBy("position").collect()] == [("Aims", "one\n\ntwo\nstill aims\n\nmore")]
    assert details.first()["details"]["credits"] == 9


def test_page_to_text(spark):
    html = "<html><head><title>x</title></head><body><p>nav</p><h1>A &amp; B</h1><ul><li>one</li><li><a href='/u'>two</a></li></ul><p>Follow us on:</p><p>tail</p></body></html>"
    df = spark.createDataFrame([(html,), ("",), (None,)], "h string").withColumn("m", markup.to_markdown(F.col("h")))
    assert [r["t"] for r in df.select(markup.syllabus_text(F.col("m")).alias("t")).collect()] == ["# A & B\n\n- one\n- [two](/u)", None, None]
    front = spark.createDataFrame([("---\ncanonical: https://x.invalid/c\ntitle: 'T'\n---\n\nbody",), ("none",)], "m string")
    found = [r["f"] for r in front.select(markup.front_matter(F.col("m")).alias("f")).collect()]
    assert found[0].asDict() == {"base": "", "canonical": "https://x.invalid/c", "title": "T", "body": "body"} and found[1] is None
