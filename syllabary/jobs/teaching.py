"""Registered queries of the stages from pages to merged teaching records, and the SQL they are held against.

The site that they read is built from the rows of ``pages``: each row's own markup, odd as it is, is part of the directory page and
of the course page made from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.functions import markup
from syllabary.jobs.catalogue import _decoded, query
from syllabary.operators import changes, discovery, merge, stages
from syllabary.sources import documents, files, page_table
from syllabary.sources.shared import Tables
from syllabary.sources.tables import table

ROLES = {"full professor": ("ordinario", "full professor"), "fellow": ("assegnista",)}
DEPARTMENTS = {"physics": ("fisica", "physics"), "arts": ("arti",)}
_AT = "https://x.invalid"
_LANGUAGES = rf"{_AT}/(it|en)/2025/[0-9]+"


def _html(*parts: str | Column) -> Column:
    """Markup with the row's columns between its pieces."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, kind, url, html`` of a small site for each row of ``pages``."""
    n, own = F.col("page_id"), F.coalesce("html", F.lit(""))
    role = F.when(n % 3 == 0, "Professore Ordinario").when(n % 3 == 1, "Assegnista di ricerca").otherwise("Guest &lt;b&gt;")
    card = _html(
        own, '<table class="contact vcard big"><tr><th class="uid">U', n, '</th><td class="fn name">Name  &amp; <b>', n, "</b></td></tr>"
        '<tr class="role"><th>Role</th><td>', role, '</td></tr><tr class="org"><th>Org</th><td>Dipartimento di <i>Fisica</i></td></tr>'
        '<tr class="adr"><td>Street ', n, " [ Vai alla mappa ]</td></tr>", '<tr><td><a class="email" href="mailto:x">p', n, "@x.invalid</a></td></tr>",
        F.when(n % 5 == 0, "").otherwise(_html('<tr><td><a class="url" href="/people/', n, '">web</a></td></tr>')),
        '<tr><td><a title="Save Vcard" href="vc/', n, '.vcf">card</a><!-- <a class="url" href="/no">no</a> --></td></tr></table>',
        '<table class="contact vcard"><tr><th class="uid">second</th></tr></table>',
    )
    person = _html("<html><body><p class='x qualifica'>", role, "</p><p class='sede'>Sede <em>arti</em></p><p class='ssd'>SSD: ABC/0", n % 7, "  Logic\n and  more</p></body></html>")
    courses = _html(
        "<div class='linked-data-list'><h4><a href='", _AT, "/courses/2025/", n, "'>B", n, " - LOGIC (x) - 6 cfu</a></h4><p>Componente del corso integrato: I", n, "</p><div><p>Periodo delle lezioni: P</p><p>no</p></div>"
        "<table><tr><th>Campus:</th><td>North  Hill</td></tr><tr><th>Corso</th><td>Programme ", n % 4, "</td></tr><tr><th>Corso</th><td>second</td></tr></table>"
        "<div class='link-wrapper'><a href='../t?a=1&amp;b=", n, "'>L'ORARIO DELLE LEZIONI</a><a href='http://[bad/'>Orario delle lezioni</a><a href='v'>Risorse didattiche su Virtuale</a></div></div>"
        "<div class='linked-data-list empty'><h4>no link</h4></div>",
    )
    course = _html(own, "<p>see <a href='", _AT, "/it/2025/", n, "'>it</a>, <a href='", _AT, "/en/2025/", n, "'>en</a> or <a href='", _AT, "/en/2025/0'>other</a></p>")

    def syllabus(language: str) -> Column:
        year, credits = ("Anno Accademico", "Crediti formativi") if language == "it" else ("Academic Year", "Credits")
        own_credits = F.when((n % 2 == 0) | F.lit(language == "it"), _html("<li>", credits, ": ", n % 12 + 1, "</li>")).otherwise("")
        return _html(
            "<html><head><title>T ", n, f"</title><link rel='canonical' href='{_AT}/canonical/{language}/", n, "'></head><body><nav><a href='/'>home</a></nav><h1>Course ", n,
            "</h1><h2>Aims</h2><p>Some <b>bold</b> words<br>and <a href='/u'>a link</a>.</p><h2>Texts</h2><ul><li>one</li><li>two ", n, f"</li></ul><h2>{year} 2025/2026</h2><ul>", own_credits,
            f"<li>SSD: S/{language}</li></ul><p>Follow us on:</p><h2>tail</h2><p>x</p></body></html>",
        )

    made = (
        ("directory", "/dir/", card), ("person", "/people/", person), ("courses", "/people/", courses), ("course", "/courses/2025/", course),
        ("it", "/it/2025/", syllabus("it")), ("en", "/en/2025/", syllabus("en")),
    )
    each = [F.struct(F.lit(kind).alias("kind"), _html(_AT + path, n, "/didattica" if kind == "courses" else "").alias("url"), html.alias("html")) for kind, path, html in made]
    return table(spark, sf_dir, "pages").select("page_id", F.inline(F.array(*each)))


def _facts(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """What stands on the site's pages, all of them or some kinds; each page is read once a query."""
    pages = _site(spark, sf_dir)
    return stages.site_facts(pages.filter(F.col("kind").isin(*kinds)) if kinds else pages, unique=True)  # a page for each address


def _contacts(facts: DataFrame) -> DataFrame:
    return stages.contact_rows(facts, ROLES, DEPARTMENTS)


def _headers(facts: DataFrame) -> DataFrame:
    return stages.header_rows(_contacts(facts), facts)


_ROLE_SQL = "CASE page_id % 3 WHEN 0 THEN 'full professor' WHEN 1 THEN 'fellow' ELSE 'Guest <b>' END"
_CONTACT_SQL = f"""
    SELECT 'U' || page_id AS uid, 'Name & ' || page_id AS name, {_ROLE_SQL} AS role, 'physics' AS department, 'Street ' || page_id AS address, 'p' || page_id || '@x.invalid' AS email,
    CASE WHEN page_id % 5 = 0 THEN '' ELSE '{_AT}/people/' || page_id END AS website, '{_AT}/dir/vc/' || page_id || '.vcf' AS vcard FROM pages
    UNION ALL SELECT 'second', '', '', '', '', '', '', '' FROM pages
"""


@query("h1_contact_cards", _CONTACT_SQL)
def h1_contact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contact card of the directory's pages, roles and departments classified or as written."""
    return _contacts(_facts(spark, sf_dir, "directory"))


@query("f3_guards", f"SELECT uid, CASE WHEN email = '' THEN 'empty e-mail' WHEN website = '' THEN 'empty website' END AS reason FROM ({_CONTACT_SQL})")
def f3_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which contacts the next stage passes over, and why."""
    return stages.with_reason(_contacts(_facts(spark, sf_dir, "directory")), {"email": "empty e-mail", "website": "empty website"}).select("uid", "reason")


_HEADER_SQL = f"""
    SELECT 'U' || page_id AS contact_uid, 'Name & ' || page_id AS contact_name, 'p' || page_id || '@x.invalid' AS contact_email, '{_AT}/people/' || page_id AS sito_web, '{_AT}/people/' || page_id || '/didattica' AS didattica_url,
    'B' || page_id || ' - LOGIC (x) - 6 cfu' AS course_title, '{_AT}/courses/2025/' || page_id AS course_url, 'Componente del corso integrato: I' || page_id AS integrated_course, 'North Hill' AS campus, 'Programme ' || page_id % 4 AS degree_course,
    'Periodo delle lezioni: P' AS lesson_period, '{_AT}/people/t?a=1&b=' || page_id AS schedule_url, '{_AT}/people/' || page_id || '/v' AS virtuale_url FROM pages WHERE page_id % 5 <> 0
"""


@query("h2_course_blocks", f"""
    {_HEADER_SQL} UNION ALL SELECT contact_uid, contact_name, contact_email, sito_web, didattica_url, '', '', '', '', '', '', '', '' FROM ({_HEADER_SQL})
""")
def h2_course_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every course block of each contact's teaching page, with the contact's columns; cells beside headers and links by label."""
    return _headers(_facts(spark, sf_dir, "directory", "courses"))


@query("h4_person_pages", f"""
    SELECT contact_uid, course_url, CASE page_id % 3 WHEN 0 THEN 'full professor' WHEN 1 THEN 'fellow' ELSE 'Guest <b>' END AS role, 'arts' AS affiliation, 'ABC/0' || page_id % 7 AS ssd, 'Logic and more' AS description
    FROM (SELECT *, substr(contact_uid, 2)::BIGINT AS page_id FROM (SELECT contact_uid, course_url FROM ({_HEADER_SQL}) UNION ALL SELECT contact_uid, '' FROM ({_HEADER_SQL})))
""")
def h4_person_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of people's pages, each read once and joined to every course of the person."""
    facts = _facts(spark, sf_dir, "directory", "courses", "person")
    rows = stages.with_person(_headers(facts), facts, ROLES, DEPARTMENTS)
    return rows.select("contact_uid", "course_url", "person.role", "person.affiliation", F.col("person.ssd.name").alias("ssd"), F.col("person.ssd.description").alias("description"))


def _languages(facts: DataFrame) -> DataFrame:
    courses = facts.filter("kind = 'markdown'").select(F.col("url").alias("course_url")).filter(F.startswith("course_url", F.lit(f"{_AT}/courses/")))
    return stages.language_urls(courses, facts, _LANGUAGES)


@query("h12_language_urls", f"SELECT page_id, '{_AT}/it/2025/' || page_id AS it, '{_AT}/en/2025/' || page_id AS en FROM pages")
def h12_language_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of a course's pages in both languages, found on its page."""
    found = _languages(_facts(spark, sf_dir, "course"))
    return found.select(F.substring_index("course_url", "/", -1).cast("long").alias("page_id"), "urls.it", "urls.en")


def _syllabi(facts: DataFrame, plain: bool = True) -> DataFrame:
    found = _languages(facts).filter("urls is not null")
    each = F.array(*[F.struct(F.lit(v).alias("language"), F.col(f"urls.{v}").alias("page_url")) for v in ("it", "en")])
    return stages.syllabus_pages(found.select("course_url", F.inline(each)), ["course_url", "language"], facts, plain)


_SYLLABUS_SQL = f"""
    SELECT '{_AT}/courses/2025/' || page_id AS course_url, language, '{_AT}/canonical/' || language || '/' || page_id AS url, 'T ' || page_id AS title,
    'Aims: Some bold words' || chr(10) || 'and [a link](/u).|Texts: - one' || chr(10) || '- two ' || page_id AS contents,
    CASE WHEN language = 'it' OR page_id % 2 = 0 THEN (page_id % 12 + 1)::INTEGER END AS credits, 'S/' || language AS ssd FROM pages, (VALUES ('it'), ('en')) AS t(language)
"""


@query("h11_syllabus_pages", _SYLLABUS_SQL)
def h11_syllabus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllabus pages from markup to address, title, sections as they are written, and details."""
    rows = _syllabi(_facts(spark, sf_dir, "course", "it", "en"), plain=False)
    said = F.array_join(F.transform(F.map_entries("syllabus_page.contents"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "|")
    return rows.select("course_url", "language", "syllabus_page.url", "syllabus_page.title", said.alias("contents"), "details.credits", "details.ssd")


@query("p21_teaching_records", f"""
    SELECT 2025 AS year, course_url AS url, (substr(contact_uid, 2)::BIGINT % 12 + 1)::INTEGER AS credits, 'S/en' AS ssd, contact_uid AS teacher_id, contact_email AS email, sito_web AS website, {_ROLE_SQL.replace('page_id', 'substr(contact_uid, 2)::BIGINT')} AS role,
    'ABC/0' || substr(contact_uid, 2)::BIGINT % 7 AS teacher_ssd, 'B' || substr(contact_uid, 2) AS course_id, 'LOGIC' AS name, 'x|6 cfu' AS details, integrated_course, campus, degree_course AS programme, 'en,it' AS languages FROM ({_HEADER_SQL})
""")
def p21_teaching_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: contacts, course headers, people, language pages, syllabi, and the teaching records composed of them."""
    facts = _facts(spark, sf_dir)
    headers = stages.with_person(_headers(facts), facts, ROLES, DEPARTMENTS)
    rows = stages.teaching_records(headers, _syllabi(facts))
    return rows.select(
        "year", "url", "credits", "ssd", F.col("teacher.id").alias("teacher_id"), "teacher.email", "teacher.website", "teacher.role", F.col("teacher.ssd.name").alias("teacher_ssd"),
        F.col("course_title.id").alias("course_id"), "course_title.name", F.array_join("course_title.details", "|").alias("details"), "integrated_course", "campus", "programme", F.array_join(F.array_sort(F.map_keys("syllabus")), ",").alias("languages"),
    )


@query("u3_union_rows", f"SELECT uid, count(*) AS n FROM (SELECT uid FROM ({_CONTACT_SQL}) UNION ALL SELECT uid FROM ({_CONTACT_SQL}) WHERE website <> '') GROUP BY uid")
def u3_union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several pages one after the other, repeats kept."""
    rows = _contacts(_facts(spark, sf_dir, "directory")).select("uid", "website")
    return rows.unionByName(rows.filter("website <> ''")).groupBy("uid").agg(F.count("*").alias("n"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of ``schemas.TEACHING`` for each order: its customer and year are the course, its status the syllabus."""
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    page = lambda v: F.struct(F.concat(F.lit(f"u{v}"), s(k)).alias("url"), F.lit("T").alias("title"), F.create_map(F.lit("Aims"), F.col("o_orderstatus"), F.lit("Texts"), F.lit("t")).alias("contents"))
    teacher = F.struct(s(k % 9).alias("id"), F.concat(F.lit("N"), s(k % 9)).alias("name"), F.concat(s(k), F.lit("@x")).alias("email"), F.lit("").alias("website"), F.lit("r").alias("role"), F.lit("").alias("affiliation"), F.lit(None).cast("struct<name:string,description:string>").alias("ssd"))
    name = F.when(k % 4 == 0, "").when(k % 4 == 1, "LOGIC").otherwise("Logic")
    title = F.struct(s(F.col("o_custkey")).alias("id"), name.alias("name"), F.array(s(k)).alias("details"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), s(k % 9)).alias("teacher_dir"), F.concat(F.lit("teaching-"), F.lpad(s(k), 12, "0"), F.lit(".yml")).alias("file"), F.year("o_orderdate").alias("year"), F.lit("u").alias("url"),
        F.when(k % 3 != 0, (k % 3 * 3).cast("int")).alias("credits"), F.concat(F.lit("S"), s(k % 2)).alias("ssd"), F.lit("English").alias("language"), F.lit("").alias("teaching_mode"),
        F.lit(None).cast("struct<from:date,to:date>").alias("schedule"), teacher.alias("teacher"), title.alias("course_title"), F.lit("").alias("integrated_course"), F.lit("c").alias("campus"), F.lit("p").alias("programme"),
        F.create_map(F.lit("it"), page("i"), F.lit("en"), page("e")).alias("syllabus"),
    )


_RECORDS_SQL = """
    r AS (SELECT o_orderkey AS k, o_custkey, year(o_orderdate)::INTEGER AS year, o_orderstatus, 't' || o_orderkey % 9 AS dir, lpad(o_orderkey::VARCHAR, 12, '0') AS nr, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 * 3 END AS credits,
          CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'LOGIC' ELSE 'Logic' END AS name FROM orders)
"""


@query("a2_merged_courses", f"""
    WITH {_RECORDS_SQL}, c AS (SELECT year, o_custkey, o_orderstatus, credits, min((dir, nr)) AS first FROM r WHERE credits IS NOT NULL GROUP BY ALL),
    l AS (SELECT year, o_custkey, o_orderstatus, string_agg(credits::VARCHAR, ',' ORDER BY first) AS credits FROM c GROUP BY ALL),
    g AS (SELECT year, o_custkey, o_orderstatus, arg_min(name, (dir, nr)) FILTER (WHERE name IS NOT NULL) AS name, count(DISTINCT name) > 1 AS conflicting, count(*) AS n FROM r GROUP BY ALL)
    SELECT g.year, o_custkey::VARCHAR AS course_id, o_orderstatus AS aims, g.name, coalesce(l.credits, '') AS credits, conflicting, n::INTEGER AS n_teachers, count(*) OVER (PARTITION BY g.year, o_custkey) > 1 AS lettered
    FROM g LEFT JOIN l USING (year, o_custkey, o_orderstatus)
""")
def a2_merged_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one year, course and syllabus merged; other syllabi of a course are other rows, told apart by letters."""
    merged = merge.merge_courses(_records(spark, sf_dir))
    aims, credits = F.col("syllabus")["en"]["contents"]["Aims"], F.array_join(F.col("credits").cast("array<string>"), ",")
    return merged.select("year", "course_id", aims.alias("aims"), "name", credits.alias("credits"), F.array_contains("conflicts", "course_title.name").alias("conflicting"), F.size("teachers").alias("n_teachers"), (F.col("suffix") != "").alias("lettered"))


@query("a6_teacher_entries", f"""
    WITH {_RECORDS_SQL} SELECT year, o_custkey::VARCHAR AS course_id, o_orderstatus AS aims, string_agg('N' || k % 9 || '/' || k || '@x/' || nr || '/ue' || k, ';' ORDER BY 'N' || k % 9, k || '@x', nr) AS entries FROM r GROUP BY ALL
""")
def a6_teacher_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teachers of each merged course with their modules, by name, e-mail and file."""
    merged = merge.merge_courses(_records(spark, sf_dir))
    one = lambda t: F.concat_ws("/", t["teacher"]["name"], t["teacher"]["email"], F.regexp_extract(t["module"]["file"], "([0-9]+)", 1), t["module"]["syllabus_urls"]["en"])
    return merged.select("year", "course_id", F.col("syllabus")["en"]["contents"]["Aims"].alias("aims"), F.array_join(F.transform("teachers", one), ";").alias("entries"))


@query("k5_links", f"""
    WITH {_RECORDS_SQL}, g AS (SELECT DISTINCT year, o_custkey, o_orderstatus FROM r), v AS (SELECT year, o_custkey, count(*) AS variants FROM g GROUP BY ALL),
    l AS (SELECT DISTINCT dir, year, o_custkey, o_orderstatus FROM r)
    SELECT dir || '/' || year AS folder, o_custkey::VARCHAR AS course_id, count(*) AS n_links, bool_and(variants = 1) AS plain FROM l JOIN v USING (year, o_custkey) GROUP BY ALL
""")
def k5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from each teacher's folder to the files of the merged courses that hold their records."""
    links = merge.links_of(merge.merge_courses(_records(spark, sf_dir)))
    name = F.regexp_extract("link", "/course-([0-9]+)(-[A-Z]+)?[.]yml$", 1)
    plain = F.regexp_extract("target", "^[.]{2}/[.]{2}/[.]files/[0-9]{4}/course-[0-9]+(-[A-Z]+)?[.]yml$", 1) == ""
    return links.groupBy(F.regexp_extract("link", "^(.*)/[^/]*$", 1).alias("folder"), name.alias("course_id")).agg(F.count("*").alias("n_links"), F.every(plain).alias("plain"))


@query("j8_members", f"""
    WITH {_RECORDS_SQL} SELECT year, o_custkey::VARCHAR AS course_id, o_orderstatus AS aims, string_agg(dir || '/' || year || '/teaching-' || nr || '.yml', ' ' ORDER BY dir, nr) AS members FROM r GROUP BY ALL
""")
def j8_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the records that each merged course was made of, in the order of teacher, year and file."""
    merged = merge.merge_courses(_records(spark, sf_dir))
    return merged.select("year", "course_id", F.col("syllabus")["en"]["contents"]["Aims"].alias("aims"), F.array_join("files", " ").alias("members"))


@query("h9_plain_sections", f"""
    SELECT '{_AT}/courses/2025/' || page_id AS course_url, language, 'Aims: Some bold words' || chr(10) || 'and a link (/u).|Texts: - one' || chr(10) || '- two ' || page_id AS contents FROM pages, (VALUES ('it'), ('en')) AS t(language)
""")
def h9_plain_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of syllabus pages as plain text: links as label and target."""
    rows = _syllabi(_facts(spark, sf_dir, "course", "it", "en"))
    said = F.array_join(F.transform(F.map_entries("syllabus_page.contents"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "|")
    return rows.select("course_url", "language", said.alias("contents"))


@query("h8_fenced_sections", r"""
    WITH p AS (SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(html, '<[^>]*>|[^a-zA-Z<> ]', ' ', 'g'), ' +', ' ', 'g')), ''), 'none') AS said FROM pages)
    SELECT page_id, 'Aims ' || page_id AS title, said || chr(10) || chr(10) || '```sh' || chr(10) || '# not a heading' || chr(10) || '## nor ' || page_id || chr(10) || '```' || chr(10) || chr(10) || 'after the fence' AS body, 0 AS position FROM p
    UNION ALL SELECT page_id, 'Texts', '- outer' || chr(10) || '  ' || chr(10) || '  1. inner ' || page_id || chr(10) || '  2. ' || CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END || chr(10) || '- last' || chr(10) || chr(10) || '> quoted' || chr(10) || '> lines', 1 FROM p WHERE page_id % 3 > 0
""")
def h8_fenced_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose headings are told from lines in fences, by underlines too; nested lists, images, emphasis and quotes as text."""
    n = F.col("page_id")
    words = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>|[^a-zA-Z<> ]", " "), " +", " "))
    page = _html(
        "# Course\nlost\n\n## *Aims* ", n, " ##\n", F.coalesce(F.nullif(words, F.lit("")), F.lit("none")), "\n\n~~~~ sh\n# not a heading\n## nor ", n, "\n~~~~\n\n![after](/a.png) **the** `fence`\n\n",
        F.when(n % 3 > 0, _html("Texts\n-----\n* outer\n\n  1) inner ", n, "\n  7) ", F.when(n % 2 == 0, "even").otherwise("odd"), "\n* last\n\n> quoted\n> _lines_\n")).otherwise(""),
    )
    return markup.sections(table(spark, sf_dir, "pages").select("page_id", page.alias("markdown")), ["page_id"], "markdown", plain=True)


@query("h6_front_matter", "SELECT page_id, 'b' || page_id AS base, CASE WHEN page_id % 2 = 0 THEN '' ELSE url END AS canonical, 'T: ' || page_id AS title, 'body' AS body FROM pages WHERE page_id % 3 > 0")
def h6_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address, title and body of pages with a block of front matter; pages without one are left out."""
    n = F.col("page_id")
    page = _html("---\nbase: b", n, "\n", F.when(n % 2 == 0, "").otherwise(_html("canonical: ", F.col("url"), "\n")), "title: 'T: ", n, "'\n---\n\nbody")
    rows = table(spark, sf_dir, "pages").select("page_id", markup.front_matter(F.when(n % 3 > 0, page).otherwise("body --- only")).alias("f"))
    return rows.filter("f is not null").select("page_id", "f.base", "f.canonical", "f.title", "f.body")


@query("h10_year_section", "SELECT page_id, CASE WHEN page_id % 4 > 0 THEN (page_id % 12 + 1)::INTEGER END AS credits, CASE WHEN page_id % 4 = 0 THEN 'Aims' ELSE 'Aims,Texts' END AS titles FROM pages")
def h10_year_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section headed by an academic year is taken out of the sections and read as details."""
    n = F.col("page_id")
    dated = _html("## Academic Year 2025/2026\n- Credits: ", n % 12 + 1, "\n\n## Texts\ny\n")
    rows = table(spark, sf_dir, "pages").select("page_id", _html("# Course\n## Aims\nx\n\n", F.when(n % 4 > 0, dated).otherwise("")).alias("markdown"))
    parts, details = markup.details_of(markup.sections(rows, ["page_id"], "markdown"), ["page_id"])
    named = parts.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("title")), ",").alias("titles"))
    return named.join(details, "page_id", "left").select("page_id", "details.credits", "titles")


@query("s13_discovery", rf"""
    WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
    r(k, d) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT 2 * k + t, d + 1 FROM r, n, (VALUES (1), (2)) AS v(t) WHERE k % 7 <> 3 AND 2 * k + t < n),
    named AS (SELECT '{_AT}/list/' || k || '?page=1' AS url, 2 * d AS round, true AS held FROM r
      UNION ALL SELECT '{_AT}/list/' || k || '?page=' || p, 2 * d + 1, true FROM r, unnest(range(2, k % 3 + 2)) AS t(p)
      UNION ALL SELECT '{_AT}/people/' || k, 2 * d + 1, k % 7 <> 3 FROM r
      UNION ALL SELECT '{_AT}/list/' || (2 * k + t) || '?page=1', 2 * d + 2, 2 * k + t < n FROM r, n, (VALUES (1), (2)) AS v(t) WHERE k % 7 <> 3
      UNION ALL SELECT '{_AT}' || {_decoded("h")}, 2 * d + 2, false FROM (SELECT d, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS h FROM r JOIN pages ON page_id = k WHERE k % 7 <> 3))
    SELECT url, min(round)::INTEGER AS round, bool_or(held) AS held FROM named GROUP BY url
""")
def s13_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address that can be reached from the first list: lists of several pages by their pagers, people by the lists' cards, and
    what people's pages (the given markup among it) link to, back as well; with the round that finds it and whether it has a page."""
    n = F.col("page_id")
    card = _html('<table class="contact vcard"><tr><th class="uid">U</th></tr><tr><td><a class="url" href="/people/', n, '">web</a></td></tr></table>')
    pager = _html("<div id='pages_before'><b class='totalPageNumber'>page 1 of ", n % 3 + 1, "</b></div>")
    person = _html(F.coalesce("html", F.lit("")), "<a href='/list/", 2 * n + 1, "?page=1'>a</a><a href='../list/", 2 * n + 2, "?page=1'>b</a><a href='/list/", F.greatest(F.floor((n - 1) / 2), F.lit(0)), "?page=1'>up</a>")
    lists = F.transform(F.sequence(F.lit(1).cast("long"), n % 3 + 1), lambda p: F.struct(_html(f"{_AT}/list/", n, "?page=", p).alias("url"), F.when(p == 1, F.concat(pager, card)).otherwise("more").alias("html")))
    own = F.filter(F.array(F.struct(_html(f"{_AT}/people/", n).alias("url"), person.alias("html"))), lambda _: n % 7 != 3)
    facts = stages.site_facts(table(spark, sf_dir, "pages").select(F.inline(F.concat(lists, own))), unique=True)
    start = spark.createDataFrame([(f"{_AT}/list/0?page=1",)], "url string")
    found = discovery.discover(start, lambda frontier: discovery.linked(frontier, facts).unionByName(discovery.paged(frontier, facts)))
    held = facts.filter("kind = 'markdown'").select(F.col("url").alias("held_url"))
    return found.join(held, F.col("url") == F.col("held_url"), "left").select("url", "round", F.col("held_url").isNotNull().alias("held"))


@query("s11_page_table", """
    WITH f AS (SELECT url || '#' || page_id AS url, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS code, html, 0 AS moment FROM pages
      UNION ALL SELECT url || '#' || page_id, 200, 'v1' || html, CASE WHEN page_id % 10 = 0 THEN -1 ELSE 1 END FROM pages WHERE page_id % 2 = 0
      UNION ALL SELECT url || '#' || page_id, CASE WHEN page_id % 5 = 0 THEN 500 WHEN page_id % 5 = 1 THEN 404 ELSE 200 END, 'v2' || html, 2 FROM pages WHERE page_id % 3 = 0
      UNION ALL SELECT url || '#new' || page_id, 200, html, 2 FROM pages WHERE page_id % 3 = 0)
    SELECT url, CASE WHEN max(moment) < 1 THEN 'stale' WHEN arg_max(code, moment) = 404 THEN 'missing' ELSE 'held' END AS state, max(moment)::INTEGER AS moment, CASE WHEN arg_max(code, moment) = 404 THEN NULL ELSE sha256(arg_max(html, moment)) END AS content FROM f WHERE code <> 500 GROUP BY url
    UNION ALL SELECT 'never asked', 'unknown', NULL, NULL
""")
def s11_page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table after three batches of fetches, one of them given twice: newest fetches win, missing pages are remembered,
    failures leave what is known; and what a look-up says of each address."""
    path, pages = Tables(spark, "pages").path, table(spark, sf_dir, "pages")
    n, at = F.col("page_id"), lambda day: F.timestamp_add("DAY", day, F.lit("2025-01-10").cast("timestamp"))
    fetch = lambda url, code, html, day: F.struct(url.alias("url"), code.cast("int").alias("code"), html.alias("html"), at(day).alias("fetched_at"))
    url, html = F.concat("url", F.lit("#"), n.cast("string")), F.col("html")
    first = pages.select(F.inline(F.array(fetch(url, F.when(n % 11 == 0, 404).otherwise(200), html, F.lit(0)))))
    # Older than what is there for some, and each address twice.
    newer = fetch(url, F.lit(200), F.concat(F.lit("v1"), html), F.when(n % 10 == 0, -1).otherwise(1))
    second = pages.filter(n % 2 == 0).select(F.inline(F.array(newer, newer, fetch(url, F.lit(503), F.lit(""), F.lit(3)))))
    last = fetch(url, F.when(n % 5 == 0, 500).when(n % 5 == 1, 404).otherwise(200), F.concat(F.lit("v2"), html), F.lit(2))
    third = pages.filter(n % 3 == 0).select(F.inline(F.array(last, fetch(F.concat("url", F.lit("#new"), n.cast("string")), F.lit(200), html, F.lit(2)))))
    for number, batch in enumerate((first, second, third)):
        page_table.upsert(batch, number, path, slots=16)
    page_table.upsert(second, 1, path, slots=16)
    held = page_table.read(spark, path)
    asked = held.select("url", F.date_diff("fetched_at", F.lit("2025-01-10")).alias("moment")).unionByName(spark.createDataFrame([("never asked", None)], "url string, moment int"))
    states = page_table.look_up(asked, "url", held, fresh_since=F.lit("2025-01-11").cast("timestamp"))
    return states.select("url", F.col("page_state").alias("state"), "moment", F.sha2("page_html", 256).alias("content"))


@query("k5_change_set", """
    WITH w AS (SELECT 'y' || year(o_orderdate) || '/course-' || o_orderkey AS path, 'f' || o_custkey AS target, o_orderkey AS k FROM orders WHERE o_orderkey % 9 > 0),
    t AS (SELECT 'y' || year(o_orderdate) || '/course-' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'folder' WHEN o_orderkey % 5 = 0 THEN 'file' ELSE 'link' END AS kind,
          CASE WHEN o_orderkey % 35 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'f' || o_custkey END AS was, o_orderkey AS j FROM orders WHERE o_orderkey % 4 > 0),
    d AS (SELECT coalesce(w.path, t.path) AS path, target, was, CASE WHEN k IS NULL AND kind = 'folder' THEN NULL WHEN k IS NULL THEN 'delete' WHEN kind = 'folder' THEN 'conflict' WHEN j IS NULL THEN 'create'
          WHEN kind = 'link' AND was = target THEN 'keep' ELSE 'replace' END AS action FROM w FULL OUTER JOIN t ON w.path = t.path)
    SELECT path, action, target, was, CASE action WHEN 'conflict' THEN 'conflict' WHEN 'delete' THEN NULL ELSE 'keep' END AS again FROM d WHERE action IS NOT NULL
""")
def k5_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the links and files that are there when links are wanted, folders in the way told; and the same asked again
    after the changes are done."""
    k, customer = F.col("o_orderkey"), F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _html("y", F.year("o_orderdate"), "/course-", k).alias("path"), customer.alias("target"))
    kind = F.when(k % 7 == 0, "folder").when(k % 5 == 0, "file").otherwise("link")
    there = rows.filter(k % 4 > 0).select("path", kind.alias("kind"), F.when(kind == "link", F.when(k % 3 == 0, "old").otherwise(F.col("target"))).alias("target"))
    wanted = rows.filter(k % 9 > 0).select("path", "target")
    found = changes.change_set(there, wanted)
    again = changes.change_set(changes.applied(there, found), wanted).select(F.col("path").alias("again_path"), F.col("action").alias("again"))
    return found.join(again, F.col("path") == F.col("again_path"), "left").select("path", "action", "target", "was", "again")


@query("k3_documents", """
    SELECT 'p' || page_id % 5 AS teacher_dir, 2020 + page_id % 3 AS year_dir, 'teaching-' || page_id || '.yml' AS file, CASE WHEN page_id % 4 > 0 THEN (page_id % 13)::INTEGER END AS credits, url,
    sha256(html) AS content, CASE WHEN page_id % 3 = 0 THEN NULL ELSE DATE '2025-02-01' + (page_id % 28)::INTEGER END AS begins, '0' || page_id AS course_id FROM pages
""")
def k3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as one document each, their null fields left out, and read back from the folders of teacher and year."""
    n = F.col("page_id")
    begins = F.date_add(F.lit("2025-02-01").cast("date"), (n % 28).cast("int"))
    page = F.struct(F.col("url"), F.lit("T").alias("title"), F.create_map(F.lit("Aims"), "html").alias("contents"))
    title = F.struct(F.concat(F.lit("0"), n.cast("string")).alias("id"), F.lit("LOGIC").alias("name"), F.array().cast("array<string>").alias("details"))
    made = table(spark, sf_dir, "pages").select(
        _html("p", n % 5, "/", n % 3 + 2020, "/teaching-", n, ".yml").alias(documents.PATH), (n % 3 + 2020).cast("int").alias("year"), "url", F.when(n % 4 > 0, (n % 13).cast("int")).alias("credits"),
        F.when(n % 3 > 0, F.struct(begins.alias("from"), begins.alias("to"))).alias("schedule"), title.alias("course_title"), F.create_map(F.lit("it"), page).alias("syllabus"),
    )
    folder = f"{Tables(spark, 'documents').path}/courses"
    documents.write_documents(made, folder)
    back = files.read_records(spark, folder)
    return back.select("teacher_dir", F.col("year_dir").cast("long").alias("year_dir"), "file", "credits", "url", F.sha2(F.col("syllabus")["it"]["contents"]["Aims"], 256).alias("content"), F.col("schedule.from").alias("begins"), F.col("course_title.id").alias("course_id"))
