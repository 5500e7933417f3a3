"""Discovery of pages: from some addresses on, what their pages name, what those name, until nothing new is found.

Semi-naive: a round looks at the pages of the last round's new addresses alone, and what they name meets all addresses found so far
in an anti-join. Each round's new addresses are written in a folder of their own, so rounds are not computed again and a lost
executor costs its tasks; only whether there are any reaches the driver. Addresses that a third of all pages name are combined
before they are shuffled. Empty addresses are none; an address without a page is found and leads nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabary.functions import text
from syllabary.operators.merge import has_value
from syllabary.operators.stages import on_page
from syllabary.sources.shared import Tables


def linked(frontier: DataFrame, facts: DataFrame) -> DataFrame:
    """The addresses that the links of the pages of ``frontier`` (``url``) have."""
    return on_page(frontier, "url", facts, "link", "said", "inner").select(F.col("said").alias("url"))


def paged(frontier: DataFrame, facts: DataFrame, parameter: str = "page") -> DataFrame:
    """All pages of the lists that pages of ``frontier`` begin: as many as their pagers say."""
    rows = on_page(frontier, "url", facts, "pager", "said", "inner")
    numbered = rows.select("url", F.explode(F.sequence(F.lit(1), F.greatest(text.page_count(F.col("said")), F.lit(1)))).alias("number"))
    return numbered.select(text.with_parameter(F.col("url"), parameter, F.col("number")).alias("url"))


def discover(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``url, round``: every address that ``step`` leads to from ``start`` (``url``), with the round that finds it first (start: 0).

    ``step`` takes rows of ``url`` and gives rows of ``url``, repeats and known ones included.
    """
    spark, tables, number = start.sparkSession, Tables(start.sparkSession, "discovery"), 0
    clean = lambda rows: rows.select("url").filter(has_value(F.col("url"))).distinct()
    known = lambda: spark.read.schema("url string, round int").parquet(f"{tables.path}/found")
    frontier = tables.keep(clean(start), "found/round=0")
    while not frontier.isEmpty():
        number += 1
        new = clean(step(frontier)).join(known().select("url"), "url", "left_anti")
        frontier = tables.keep(new, f"found/round={number}")
    return known()
