"""From pages to teaching records: contacts, course headers, people's pages, syllabus pages, and the record that joins them.

Pages come from a page table (``url, html``, a row for each address), so nothing is fetched. ``site_facts`` reads each of them once
and writes what is on it, in a folder for each kind, by the address's key; the steps join what they want of it, and no markup is
shuffled or parsed again. Rows that a step can't use are kept out by guards that give a reason.

Null and empty fields are missing; a page that the table lacks has no rows and no fields; rows that repeat are each processed; of
several pages of one address any one counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.functions import classify, markup, site, text, titles
from syllabary.operators.merge import has_value
from syllabary.sources.schemas import CONTACT, COURSE_BLOCK, COURSE_HEADER, TEACHING
from syllabary.sources.shared import Tables

Dictionary = Mapping[str, tuple[str, ...] | list[str]]


def site_facts(page_table: DataFrame, unique: bool = False) -> DataFrame:
    """What stands on every page (``site.read_pages``), written in the shared folder by kind; stages read the kinds they need."""
    return Tables(page_table.sparkSession, "site").keep(site.read_pages(page_table, unique), "facts", by=("kind",))


def contact_rows(facts: DataFrame, roles: Dictionary, departments: Dictionary) -> DataFrame:
    """``schemas.CONTACT`` rows of the pages that have contact cards; roles and departments by class, or as written."""
    rows = facts.filter("kind = 'card'").select("card.*")
    known = {"role": roles, "department": departments}
    return rows.select(*[classify.or_raw(F.col(c), known[c])["value"].alias(c) if c in known else F.col(c) for c in CONTACT.names])


def with_reason(rows: DataFrame, needed: Mapping[str, str]) -> DataFrame:
    """``rows`` with ``reason``: which of the ``needed`` columns is empty, in its words, the first that is; null where none is."""
    return rows.withColumn("reason", F.coalesce(*[F.when(~has_value(F.trim(c)) | F.col(c).isNull(), F.lit(said)) for c, said in needed.items()]))


def on_page(wanted: DataFrame, url: str, facts: DataFrame, kind: str, what: str, how: str = "left") -> DataFrame:
    """``wanted`` with ``what``: the facts of a kind on the page at its ``url``, a row for each; ``how`` a page without them is met."""
    own = facts.filter(F.col("kind") == kind).select(F.col("page_key").alias("fact_key"), what)
    asked = wanted.withColumn("asked_key", F.when(has_value(F.col(url)), text.url_key(F.col(url))))
    return asked.join(own, F.col("asked_key") == F.col("fact_key"), how).drop("asked_key", "fact_key")


def header_rows(contacts: DataFrame, facts: DataFrame) -> DataFrame:
    """``schemas.COURSE_HEADER`` rows: every course block of each contact's teaching page, with the contact's columns."""
    fit = with_reason(contacts, {"website": "empty website"}).filter("reason is null").drop("reason")
    fit = fit.withColumn("didattica_url", text.child_url(F.col("website"), "didattica"))
    rows = on_page(fit, "didattica_url", facts, "block", "block", "inner")
    carried = [F.col("uid").alias("contact_uid"), F.col("name").alias("contact_name"), F.col("email").alias("contact_email"), F.col("website").alias("sito_web"), "didattica_url"]
    rows = rows.select(*carried, "block")
    return rows.select(*[F.col(f"block.{c}").alias(c) if c in COURSE_BLOCK.names else F.col(c) for c in COURSE_HEADER.names])


def with_person(headers: DataFrame, facts: DataFrame, roles: Dictionary, departments: Dictionary) -> DataFrame:
    """``headers`` with ``person``: struct(role, affiliation, ssd struct) of the page at ``sito_web``, empty fields without one."""
    rows = on_page(headers, "sito_web", facts, "person", "person").withColumnRenamed("person", "page")
    known = lambda c, d: F.coalesce(classify.or_raw(F.col(f"page.{c}"), d)["value"], F.lit(""))
    person = F.struct(known("role", roles).alias("role"), known("affiliation", departments).alias("affiliation"), text.code_and_description(F.col("page.ssd")).alias("ssd"))
    return rows.withColumn("person", person).drop("page")


def language_urls(found: DataFrame, facts: DataFrame, pattern: str, languages: tuple[str, ...] = ("it", "en")) -> DataFrame:
    """``found`` (with ``course_url``) with ``urls``: struct of the first address of each language on the course's page, or null."""
    rows = on_page(found, "course_url", facts, "markdown", "said")
    links = text.urls(F.coalesce(markup.front_matter(F.col("said"))["body"], F.col("said")))
    return rows.withColumn("urls", text.first_by_language(links, pattern, languages)).drop("said")


def syllabus_pages(wanted: DataFrame, key: list[str], facts: DataFrame, plain: bool = True) -> DataFrame:
    """``key, syllabus_page, details`` of the pages at ``page_url`` (one for each key): struct(url, title, contents) and the course's details.

    The page's own address is its canonical one, or its base, or the one asked for. Pages without sections are left out. Texts are
    without marks if ``plain``, else as they are written.
    """
    rows = on_page(wanted, "page_url", facts, "markdown", "said", "inner").withColumnRenamed("said", "markdown")
    front = markup.front_matter(F.col("markdown"))
    rows = rows.withColumn("front", front).withColumn("body", markup.syllabus_text(F.coalesce("front.body", "markdown")))
    parts, details = markup.details_of(markup.sections(rows.filter("body is not null"), key, "body", plain), key)
    entries = F.array_sort(F.collect_list(F.struct("position", "title", "body")))
    contents = parts.groupBy(*key).agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["title"], e["body"]))).alias("contents"))
    first = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])
    heads = rows.select(*key, first(F.col("front.canonical"), F.col("front.base"), F.col("page_url")).alias("url"), F.coalesce("front.title", F.lit("")).alias("title"))
    out = heads.join(contents, key).join(details, key, "left")
    return out.select(*key, F.struct("url", "title", "contents").alias("syllabus_page"), "details")


def teaching_records(headers: DataFrame, syllabi: DataFrame) -> DataFrame:
    """``schemas.TEACHING`` records of ``headers`` (with ``person``) and ``syllabi`` (course_url, language, syllabus_page, details).

    Year and id come from the end of the course's address; rows without them, or without a syllabus, are left out. Of the details
    of several languages the English ones count where they have a value.
    """
    pick = lambda c: F.coalesce(*[F.max(F.when(F.col("language") == v, F.nullif(F.col(f"details.{c}"), F.lit("")) if c not in ("credits", "schedule") else F.col(f"details.{c}"))) for v in ("en", "it")])
    by_language = lambda a, b: F.when(a["language"] < b["language"], -1).when(a["language"] > b["language"], 1).otherwise(0)
    texts = ("ssd", "language", "teaching_mode")
    merged = syllabi.groupBy(F.col("course_url").alias("syllabus_of")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "syllabus_page")), by_language)).alias("syllabus"),
        pick("credits").alias("credits"), pick("schedule").alias("schedule"), *[F.coalesce(pick(c), F.lit("")).alias(c) for c in texts],
    )
    rows = headers.withColumn("named", text.year_and_id(F.trim("course_url"))).filter("named is not null").join(merged, F.col("course_url") == F.col("syllabus_of"))
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    teacher = F.struct(
        said("contact_uid").alias("id"), said("contact_name").alias("name"), said("contact_email").alias("email"), said("sito_web").alias("website"),
        F.col("person.role").alias("role"), F.col("person.affiliation").alias("affiliation"), F.col("person.ssd").alias("ssd"),
    )
    fields: dict[str, Column] = {
        "year": F.col("named.year"), "url": F.trim("course_url"), "teacher": teacher, "course_title": titles.split_title(said("course_title")),
        "integrated_course": said("integrated_course"), "campus": said("campus"), "programme": said("degree_course"),
    }
    return rows.select(*[fields.get(f.name, F.col(f.name)).alias(f.name) for f in TEACHING])
