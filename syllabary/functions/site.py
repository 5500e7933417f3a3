"""A page read once: a table function that gives everything the stages want of it as tagged rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.functions import markup, pages
from syllabary.functions.text import url_key
from syllabary.sources.schemas import CONTACT, COURSE_BLOCK, PERSON

#: kind: card, block, person, link, pager or markdown; place: its number on the page; the column of its kind, or said.
FACT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("card", CONTACT), T.StructField("block", COURSE_BLOCK),
    T.StructField("person", PERSON), T.StructField("said", T.StringType()),
])


class ReadPage:
    """(html, url) to rows of ``FACT``: one for each contact card, course block and link, one for the fields of a person, one for the
    label of a pager if there is one, one for the Markdown with what the head says. A null page has none."""

    def eval(self, html: str | None, url: str | None) -> Iterator[tuple]:
        if html is None:
            return
        page, base = pages.tree(html), url or ""
        for i, card in enumerate(pages._cards(page, base)):
            yield "card", i, tuple(card[c] for c in CONTACT.names), None, None, None
        for i, block in enumerate(pages._blocks(page, base)):
            yield "block", i, None, tuple(block[c] for c in COURSE_BLOCK.names), None, None
        person = pages._person(page, base)
        yield "person", 0, None, None, tuple(person[c] for c in PERSON.names), None
        for i, anchor in enumerate(x for x in page.below() if x.tag == "a" and x.attributes.get("href", "").strip()):
            yield "link", i, None, None, None, pages.resolved(base, anchor.attributes["href"])
        for pager in (x for x in page.below() if x.attributes.get("id") == pages.PAGER[0]):
            if said := next(pager.find(pages.PAGER[1]), None):
                yield "pager", 0, None, None, None, said.text()
                break
        yield "markdown", 0, None, None, None, markup.raw_markdown(html, front=True, full=True)


def read_pages(page_table: DataFrame, unique: bool = False) -> DataFrame:
    """``page_key, url`` and the columns of ``FACT`` of every page of a table (``url, html``; a page an address if ``unique``, else of
    several any one counts). Each page is parsed once, whatever is asked of it later; its markup goes no further."""
    held = page_table.select("url", "html").filter("url is not null and html is not null").withColumn("page_key", url_key(F.col("url")))
    if not unique:
        held = held.dropDuplicates(["page_key"])
    elif held.rdd.getNumPartitions() < (tasks := held.sparkSession.sparkContext.defaultParallelism):
        held = held.repartition(tasks, "page_key")  # few files: parsing is dearer than moving them
    read = F.udtf(ReadPage, returnType=FACT, useArrow=True)
    facts = held.lateralJoin(read(F.col("html").outer(), F.col("url").outer()))
    said = F.when(F.col("kind") == "markdown", markup.tidied(F.col("said"))).otherwise(F.col("said"))
    return facts.select("page_key", "url", "kind", "place", "card", "block", "person", said.alias("said"))
