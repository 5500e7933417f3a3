"""Registered queries of files: what is written from the tables and read again, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.functions import classify, markup
from syllabary.jobs.catalogue import _decoded, query
from syllabary.jobs.teaching import _html
from syllabary.operators import merge, report
from syllabary.sources import documents, files
from syllabary.sources.schemas import CONTACT, TEACHING
from syllabary.sources.shared import Tables
from syllabary.sources.tables import table

_COURSE = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("credits", T.IntegerType())])


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``schemas.CONTACT`` rows of the customers, with quotes, commas, line ends and empty fields."""
    k, own = F.col("c_custkey"), {"uid": F.lpad(F.col("c_custkey").cast("string"), 9, "0"), "name": _html(F.col("c_name"), ', "the ', F.col("c_mktsegment"), '"'), "address": _html("Street\n", F.col("c_nationkey"))}
    own["email"] = F.when(k % 7 > 0, F.concat(F.lower("c_name"), F.lit("@x.invalid")))
    return table(spark, sf_dir, "customer").select(*[own.get(c, F.lit("")).cast("string").alias(c) for c in CONTACT.names])


_PEOPLE_SQL = """
    SELECT lpad(c_custkey::VARCHAR, 9, '0') AS uid, c_name || ', "the ' || c_mktsegment || '"' AS name, 'Street' || chr(10) || c_nationkey AS address, CASE WHEN c_custkey % 7 > 0 THEN lower(c_name) || '@x.invalid' ELSE '' END AS email FROM customer
"""


@query("k1_csv_contacts", f"SELECT *, '' AS role FROM ({_PEOPLE_SQL})")
def k1_csv_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts written as CSV and read back with checked headers; empty fields are empty texts."""
    folder = Tables(spark, "contacts").path
    files.write_csv(_people(spark, sf_dir), folder)
    back = files.read_csv(spark, folder, tuple(CONTACT.names))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("uid", "name", "address", "email", "role")])


@query("k2_csv_append", f"SELECT uid, count(*) AS n FROM (SELECT uid FROM ({_PEOPLE_SQL}) UNION ALL SELECT uid FROM ({_PEOPLE_SQL}) WHERE email = '') GROUP BY uid")
def k2_csv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV begun anew, whatever was there, and then added to."""
    folder, rows = Tables(spark, "headers").path, _people(spark, sf_dir)
    files.write_csv(rows.limit(3), folder)
    files.write_csv(rows, folder)
    files.write_csv(rows.filter("email is null"), folder, append=True)
    return files.read_csv(spark, folder, ("uid",)).groupBy("uid").agg(F.count("*").alias("n"))


@query("s2_contact_rows", f"SELECT uid, name, uid IN (SELECT uid FROM ({_PEOPLE_SQL}) ORDER BY uid LIMIT 25) AS among_first FROM ({_PEOPLE_SQL})")
def s2_contact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a CSV (a limit of 0), and which of them a limit of 25 takes."""
    folder = Tables(spark, "contacts").path
    files.write_csv(_people(spark, sf_dir), folder)
    rows = files.read_csv(spark, folder, ("uid", "name"))
    first = files.head(rows, ["uid"], 25).select(F.col("uid").alias("first_uid"))
    return files.head(rows, ["uid"], 0).join(first, F.col("uid") == F.col("first_uid"), "left").select("uid", "name", F.col("first_uid").isNotNull().alias("among_first"))


@query("s4_yaml_records", """
    SELECT 't' || c_nationkey AS teacher_dir, 2020 + c_custkey % 4 AS year_dir, 'teaching-' || c_custkey || '.yml' AS file, CASE WHEN c_custkey % 10 NOT IN (3, 4) THEN '0' || c_custkey % 100 END AS course_id,
    CASE WHEN c_custkey % 10 NOT IN (3, 4) THEN 2020 + c_custkey % 4 END AS year, CASE WHEN c_custkey % 10 NOT IN (3, 4, 5) THEN c_custkey % 13 END::INTEGER AS credits, CASE WHEN c_custkey % 10 NOT IN (3, 4) THEN c_mktsegment || ': a' || chr(10) || 'b' END AS aims, c_custkey % 10 = 4 AS broken
    FROM customer WHERE c_custkey % 10 NOT IN (1, 2)
""")
def s4_yaml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teaching records in YAML, a file each: those at other depths or with other names are passed over, empty ones have no fields,
    broken ones an error; ids stay texts and what is no number is null."""
    k = F.col("c_custkey")
    year, kind = k % 4 + 2020, k % 10
    text = _html("year: ", year, "\ncredits: ", F.when(kind == 5, "six").otherwise((k % 13).cast("string")), "\ncourse_title: {id: 0", k % 100, ", name: ~}\nsyllabus:\n  it:\n    contents:\n      Aims: |-\n        ", F.col("c_mktsegment"), ": a\n        b\n")
    said = F.when(kind == 3, "\n").when(kind == 4, "year: [2025\n: x").otherwise(text)
    folder = F.when(kind == 1, _html("deep/t", F.col("c_nationkey"))).otherwise(_html("t", F.col("c_nationkey")))
    path = _html(folder, "/", year, F.when(kind == 2, "/course-").otherwise("/teaching-"), k, ".yml")
    at = f"{Tables(spark, 'records').path}/courses"
    documents.write_documents(table(spark, sf_dir, "customer").select(path.alias(documents.PATH), said.alias(documents.TEXT)), at)
    rows = files.read_records(spark, at)
    aims = F.col("syllabus")["it"]["contents"]["Aims"].alias("aims")
    return rows.select("teacher_dir", F.col("year_dir").cast("long").alias("year_dir"), "file", F.col("course_title.id").alias("course_id"), F.col("year").cast("long").alias("year"), "credits", aims, F.col("error").isNotNull().alias("broken"))


@query("s8_known_courses", """
    WITH known AS (SELECT '0' || p_partkey % 700 AS id, p_brand AS name, CASE WHEN p_size % 4 > 0 THEN p_size END AS credits FROM part WHERE p_size < 30),
    offers AS (SELECT DISTINCT '0' || p_partkey % 700 AS id, p_brand AS name, CASE WHEN p_size % 4 > 0 THEN p_size END AS credits FROM part)
    SELECT * FROM offers o WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = o.id AND k.name = o.name AND k.credits IS NOT DISTINCT FROM o.credits)
""")
def s8_known_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers that are not in the lists of an earlier report, which are YAML files of a brand each; ids are texts there too."""
    part = table(spark, sf_dir, "part").select(_html("0", F.col("p_partkey") % 700).alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("credits"), "p_size")
    entry = _html("- {id: ", F.col("id"), ", name: '", F.col("name"), "', credits: ", F.coalesce(F.col("credits").cast("string"), F.lit("~")), "}\n")
    lists = part.filter("p_size < 30").select("name", entry.alias("entry")).distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("entry")), "").alias(documents.TEXT))
    at = Tables(spark, "lists").path
    documents.write_documents(lists.select(F.concat(F.replace("name", F.lit("#"), F.lit("-")), F.lit(".yml")).alias(documents.PATH), documents.TEXT), at)
    known = files.read_list(spark, at, _COURSE).filter("error is null")
    return report.without_known(part.select("id", "name", "credits").distinct(), known, ["id", "name", "credits"])


@query("s10_dictionary", """
    SELECT s_suppkey, coalesce((SELECT n_name FROM nation WHERE contains('of ' || s_nationkey || '. nation', 'of ' || n_nationkey || '.')), '(other)') AS class FROM supplier
""")
def s10_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of aliases read from its YAML file, and values classified by it."""
    entry = _html("'", F.col("n_name"), "':\n- ' OF ", F.col("n_nationkey"), ".'\n- ~", F.col("n_nationkey"), "~\n")
    whole = table(spark, sf_dir, "nation").groupBy().agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias(documents.TEXT))
    at = Tables(spark, "dictionary").path
    documents.write_documents(whole.select(F.lit("nations.yml").alias(documents.PATH), documents.TEXT), at)
    known = files.read_dictionary(spark, f"{at}/nations.yml")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _html("of ", F.col("s_nationkey"), ". Nation").alias("said"))
    return classify.classify_distinct(rows, "said", known, "class").select("s_suppkey", F.coalesce("class", F.lit("(other)")).alias("class"))


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of ``schemas.TEACHING`` for each customer: nation and year are the course, the segment its syllabus."""
    k = F.col("c_custkey")
    page = F.struct(F.lit("u").alias("url"), F.lit("T").alias("title"), F.create_map(F.lit("Aims"), "c_mktsegment").alias("contents"))
    title = F.struct(_html("0", F.col("c_nationkey")).alias("id"), F.lit("LOGIC").alias("name"), F.array().cast("array<string>").alias("details"))
    own = {"year": (k % 5 + 2020).cast("int"), "credits": F.when(k % 3 > 0, (k % 3 * 3).cast("int")), "course_title": title, "syllabus": F.create_map(F.lit("it"), page)}
    fields = [own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TEACHING]
    return table(spark, sf_dir, "customer").select(_html("t", k % 9).alias("teacher_dir"), _html("teaching-", k, ".yml").alias("file"), *fields)


@query("k4_merged_documents", """
    SELECT 2020 + c_custkey % 5 AS year, '0' || c_nationkey AS course_id, c_mktsegment AS aims, count(*) AS n_teachers, coalesce(string_agg(DISTINCT CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 * 3 END::VARCHAR, ',' ORDER BY CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 * 3 END::VARCHAR), '') AS credits,
    count(DISTINCT c_custkey % 9) AS n_folders FROM customer GROUP BY ALL
""")
def k4_merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged courses written as a document each under year, id and letter, and read back; unset fields are not there."""
    folder, merged = Tables(spark, "merged").path, merge.merge_courses(_offered(spark, sf_dir))
    documents.write_documents(files.merged_documents(merged), folder)
    kind = T.StructType([f for f in merged.schema if f.name in ("year", "course_id", "credits", "teachers", "syllabus")])
    read = spark.read.schema(T.StructType([*kind, T.StructField("_corrupt_record", T.StringType())])).json(f"{folder}/.files/*", multiLine=True)
    texts = F.array_sort(F.transform("credits", lambda c: c.cast("string")))
    folders = F.size(F.array_distinct(F.transform("teachers", lambda t: F.regexp_extract(t["module"]["file"], "([0-9]+)", 1).cast("int") % 9)))
    return read.filter("_corrupt_record is null").select(F.col("year").cast("long").alias("year"), "course_id", F.col("syllabus")["it"]["contents"]["Aims"].alias("aims"), F.size("teachers").cast("long").alias("n_teachers"), F.array_join(texts, ",").alias("credits"), folders.cast("long").alias("n_folders"))


@query("k6_department_lists", """
    SELECT p_brand AS department, count(DISTINCT (p_partkey % 40, p_size % 6)) AS n_courses, sum(DISTINCT p_partkey % 40 * 10 + p_size % 6)::BIGINT AS total FROM part GROUP BY p_brand
""")
def k6_department_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The courses of each department written as a document a department and read back."""
    course = F.struct((F.col("p_partkey") % 40).cast("string").alias("id"), F.lit("n").alias("name"), (F.col("p_size") % 6).alias("credits"))
    lists = report.department_courses(table(spark, sf_dir, "part").select(F.col("p_brand").alias("department"), F.array(course).alias("courses")))
    folder = Tables(spark, "departments").path
    documents.write_documents(lists.withColumn(documents.PATH, F.concat(F.replace("department", F.lit("#"), F.lit("-")), F.lit(".yml"))), folder)
    back = spark.read.schema(lists.schema).json(folder, multiLine=True)
    total = F.aggregate("courses", F.lit(0).cast("long"), lambda a, c: a + c["id"].cast("long") * 10 + c["credits"])
    return back.select("department", F.size("courses").cast("long").alias("n_courses"), total.alias("total"))


@query("k7_chart_rows", """
    WITH t AS (SELECT p_brand AS department, sum(p_size)::BIGINT AS credits FROM part GROUP BY 1)
    SELECT row_number() OVER (ORDER BY credits, department) AS place, department AS label, credits, sum(credits) OVER ()::BIGINT AS all_credits, count(*) OVER () AS n_departments FROM t
""")
def k7_chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of a chart, the smallest first, with their labels, and the figures of its caption."""
    totals = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("department")).agg(F.sum("p_size").cast("long").alias("credits"))
    rows, caption = report.chart(totals)
    said = caption.first()  # one row
    return rows.select("*", *[F.lit(said[c]).cast("long").alias(c) for c in ("all_credits", "n_departments")])


_TITLE = _decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@query("h6_page_front", rf"SELECT page_id, trim(regexp_replace(trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')), '^[''\"]|[''\"]$', '', 'g')) AS title FROM pages")
def h6_page_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles that the heads of the given pages have, by way of the front matter of their Markdown."""
    front = markup.front_matter(markup.to_markdown(F.col("html"), front=True))
    return table(spark, sf_dir, "pages").select("page_id", front["title"].alias("title"))


@query("h10_page_details", "SELECT page_id, (page_id % 12 + 1)::INTEGER AS credits, 'S/' || page_id % 5 || '; T' AS ssd FROM pages")
def h10_page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details that stand after the markup of each given page, whatever its own sections are."""
    n = F.col("page_id")
    html = _html(F.coalesce("html", F.lit("")), "<h2>Academic Year 2025/2026</h2><ul><li>Credits: ", n % 12 + 1, "</li><li>SSD: S/", n % 5, " (Module 1);</li><li>SSD: T</li></ul><h2>End</h2>")
    pages = table(spark, sf_dir, "pages").select("page_id", markup.to_markdown(html, full=True).alias("markdown"))
    _, details = markup.details_of(markup.sections(pages, ["page_id"], "markdown", plain=True), ["page_id"])
    return details.select("page_id", "details.credits", "details.ssd")
