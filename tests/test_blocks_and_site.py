"""Blocks of Markdown, full Markdown of pages, and pages read once."""

from __future__ import annotations

from pyspark.sql import functions as F

from syllabary.functions import blocks, markup, site
from syllabary.operators import stages

PAGE = """# Course
lost
## Aims *and* `more *x*`
Some **bold** words, [a link](/u) and ![pic](/p.png "t").
Next\\
line __init__ snake_case_word \\*kept\\*
- one
  - two _nested_
    goes on
- four

3) a
9) b

> quoted
> more
lazy
***
~~~ py extra
# not a heading
```
## nor this
~~~
<div>
## markup
</div>

    # code

Two lines
of a title
---
<http://a.b> [](/only) [text]()
# One more
after
## Aims and `more *x*`
again
## Empty
####### seven
"""


def test_sections_as_text():
    found = dict(blocks.sections(PAGE))
    assert list(found) == ["Aims and more *x*", "Two lines\nof a title", "Empty"]
    assert found["Aims and more *x*"].split("\n\n") == [
        "Some bold words, a link (/u) and pic.\nNext\nline init snake_case_word *kept*", "- one\n  \n  - two nested\n    goes on\n- four", "1. a\n2. b", "> quoted\n> more\n> lazy",
        "```py\n# not a heading\n```\n## nor this\n```", "<div>\n## markup\n</div>", "```\n# code\n```", "again",
    ]
    assert found["Two lines\nof a title"] == "http://a.b /only text\n\nafter" and found["Empty"] == "####### seven"
    assert blocks.sections("") == blocks.sections("# only\ntext") == blocks.sections("```\n## open fence\n") == []


def test_sections_as_written():
    found = dict(blocks.sections("## A\n  b   *c*\n\n\n\n[d](/e)\n# gone\n- f\n\n```\n# g\n```\n", as_written=True))
    assert found == {"A": "b *c*\n\n[d](/e)\n- f\n\n```\n# g\n```"}


def test_long_pages_take_linear_time():
    many = "## T\n" + "".join(f"- item {i}\n  - inner *{i}*\n" for i in range(20_000))
    assert len(blocks.sections(many)[0][1].splitlines()) == 60_000


def test_full_markdown_is_read_back(spark):
    html = "<h1>C</h1><h2>A</h2><ul><li>a<ol><li>b<ul><li>c</li></ul></li><li>d</li></ol></li><li>e <img src='/i.png' alt='f  g'></li></ul><pre>if x:\n    # y\n</pre><p><em>h</em> <b>i</b></p>"
    row = spark.createDataFrame([(html,)], "h string").select(markup.to_markdown(F.col("h"), full=True, emphasis=True).alias("m"), markup.to_markdown(F.col("h")).alias("p")).first()
    assert row["m"] == "# C\n\n## A\n\n- a\n\n  1. b\n\n     - c\n\n  2. d\n\n- e ![f g](/i.png)\n\n```\nif x:\n    # y\n\n```\n\n*h* **i**" and "![" not in row["p"]
    found = blocks.sections(row["m"])
    assert found == [("A", "- a\n  \n  1. b\n    \n    - c\n  2. d\n- e f g\n\n```\nif x:\n# y\n```\n\nh i")]


def test_pages_are_read_once(spark):
    card = "<table class='contact vcard'><tr><th class='uid'>U</th></tr></table>"
    block = "<div class='linked-data-list'><h4><a href='/c'>C</a></h4></div>"
    rows = [("https://x.invalid/a/", card + block + "<p class='qualifica'>R</p><a href='b'>b</a><a href=' '>no</a><a href='http://[bad/'>bad</a>"), ("https://x.invalid/a/", card), ("https://x.invalid/n", None), (None, card), ("https://x.invalid/e", "")]
    table = spark.createDataFrame(rows[:1] + rows[2:], "url string, html string")
    facts = site.read_pages(table)
    found = {(r["url"][18:], r["kind"], r["place"]): r for r in facts.collect()}
    assert set(found) == {("a/", "card", 0), ("a/", "block", 0), ("a/", "person", 0), ("a/", "link", 0), ("a/", "link", 1), ("a/", "link", 2), ("a/", "markdown", 0), ("e", "person", 0), ("e", "markdown", 0)}
    assert found["a/", "card", 0]["card"]["uid"] == "U" and found["a/", "block", 0]["block"]["course_url"] == "https://x.invalid/c" and found["a/", "person", 0]["person"]["role"] == "R"
    assert [found["a/", "link", i]["said"] for i in range(3)] == ["https://x.invalid/c", "https://x.invalid/a/b", ""]
    assert site.read_pages(spark.createDataFrame(rows[:2], "url string, html string")).filter("kind = 'card'").count() == 1  # any one of two
    plan = site.read_pages(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPythonUDTF") == 1 and plan.count("Exchange hash") == 1
    wanted = spark.createDataFrame([(1, "https://x.invalid/a/"), (2, "https://x.invalid/none"), (3, None), (4, "https://x.invalid/a/")], "i int, at string")
    met = stages.on_page(wanted, "at", facts, "person", "person")
    assert {r["i"]: r["person"]["role"] if r["person"] else None for r in met.collect()} == {1: "R", 2: None, 3: None, 4: "R"}
