"""Registered catalogue queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllabary.functions import classify, markup, text, titles
from syllabary.operators import merge, ranks, report
from syllabary.sources import files
from syllabary.sources.shared import Tables
from syllabary.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


@query(
    "entry_credits_by_nation",
    """
    WITH known AS (SELECT DISTINCT n_name, p_partkey, p_name, p_size FROM lineitem
                   JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
                   JOIN nation ON n_nationkey = s_nationkey),
    totals AS (SELECT n_name AS department, CAST(sum(coalesce(p_size, 0)) AS BIGINT) AS credits, CAST(count(*) AS BIGINT) AS courses
               FROM known GROUP BY n_name)
    SELECT department, credits, courses, CAST(row_number() OVER (ORDER BY credits DESC, department) AS INTEGER) AS place FROM totals
    """,
)
def entry_credits_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (id, name, credits) offers of each department, their credits summed, largest first."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    offers = (
        sold.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .select("n_name", "p_partkey", "p_name", "p_size")
        .distinct()
    )
    totals = offers.groupBy(F.col("n_name").alias("department")).agg(
        F.sum(F.coalesce("p_size", F.lit(0))).cast("long").alias("credits"), F.count("*").alias("courses")
    )
    # One row a department: the ranking window holds the dictionary of departments, not the data.
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("credits"), "department")).cast("int"))


def _value(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


@query("p1_clean_text", r"""
    SELECT doc_id, trim(regexp_replace(replace(replace(text, ' ', chr(160) || '  ' || chr(9)), chr(160), ' '), '[ \t\n\r\f\v]+', ' ', 'g')) AS cleaned FROM documents
""")
def p1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space of every kind, hard blanks included, to single blanks."""
    spaced = F.replace("text", F.lit(" "), F.lit("   \t"))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(spaced).alias("cleaned"))


@query("p2_normalize_lines", r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, ' ', '  '), '.', chr(160) || chr(10) || ' ' || chr(10) || chr(10)), chr(160), ' '),
      '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS lines FROM documents
""")
def p2_normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stripped, their blanks squeezed, runs of empty lines squeezed to one."""
    noisy = F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("."), F.lit(" \n \n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_lines(noisy).alias("lines"))


@query("p3_local_part", "SELECT c_custkey, split_part(lower(c_name) || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '@example.invalid' END, '@', 1) AS local_part FROM customer")
def p3_local_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of an e-mail address before the @."""
    email = F.concat(F.lower("c_name"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise("@example.invalid"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.local_part(email).alias("local_part"))


@query("p4_split_title", """
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || '  tail' END AS name,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand || ' (x)|' || p_size || ' cfu' END AS details FROM part
""")
def p4_split_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with nested parentheses and a credit remark, taken apart."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    short = F.concat(key, F.lit(" - "), "p_name")
    full = F.concat(key, F.lit(" - "), "p_name", F.lit(" ("), "p_brand", F.lit(" (x)) tail - "), size, F.lit(" cfu"))
    split = titles.split_title(F.when(F.col("p_partkey") % 5 == 0, short).otherwise(full))
    rows = table(spark, sf_dir, "part").select("p_partkey", split.alias("t"))
    return rows.select("p_partkey", F.col("t.id").alias("id"), F.col("t.name").alias("name"), F.array_join("t.details", "|").alias("details"))


@query("p7_year_id_from_url", r"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate)::INTEGER END AS year,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'B' || o_orderkey END AS id FROM orders
""")
def p7_year_id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and id from the end of a URL's path, whatever its query, fragment or closing slash."""
    year, key = F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")
    tail = F.when(F.col("o_orderkey") % 3 == 0, "/about").when(F.col("o_orderkey") % 3 == 1, "/?a=/2020/x#y").otherwise("")
    url = F.concat(F.lit("https://x.invalid/courses/"), year, F.lit("/B"), key, tail)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.year_and_id(url).alias("r")).select("o_orderkey", "r.year", "r.id")


@query("p8_extract_urls", r"""
    SELECT page_id, array_to_string(list_transform(regexp_extract_all('see <' || url || '>, or (' || url || ').' || chr(10) || 'at ' || url || '., too', 'https?://[^\s)>]+'),
      lambda u: regexp_replace(u, '[.,)]+$', '')), ' ') AS urls FROM pages
""")
def p8_extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All URLs of a text without the punctuation after them."""
    said = F.concat(F.lit("see <"), "url", F.lit(">, or ("), "url", F.lit(").\nat "), "url", F.lit("., too"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.urls(said), " ").alias("urls"))


@query("p9_language_urls", r"""
    WITH found AS (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS language, url, page_id FROM pages)
    SELECT host, arg_min(url, page_id) FILTER (WHERE language = 'en') AS en, arg_min(url, page_id) FILTER (WHERE language = 'fr') AS fr FROM found
    GROUP BY host HAVING count(*) FILTER (WHERE language = 'en') > 0 AND count(*) FILTER (WHERE language = 'fr') > 0
""")
def p9_language_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first URL of each language of a host, where both languages are there."""
    language = F.regexp_extract("url", "^https?://[^/]+/(en|fr)/.*$", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), language.alias("language"))
    first = [F.min_by("url", F.when(F.col("language") == v, F.col("page_id"))).alias(v) for v in ("en", "fr")]
    return pages.groupBy("host").agg(*first).filter("en is not null and fr is not null")


@query("p10_child_url", r"SELECT page_id, regexp_replace(url, '/+$', '') || '/teachings' AS child FROM pages")
def p10_child_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page below a page."""
    return table(spark, sf_dir, "pages").select("page_id", text.child_url(F.col("url"), "teachings").alias("child"))


@query("p11_set_page_param", r"""
    WITH parts AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '(#.*)$', 1) AS fragment FROM pages)
    SELECT page_id, base || '?' || CASE WHEN regexp_matches(query, '(^|&)page=') THEN regexp_replace(query, '(^|&)page=[^&]*', '\1page=' || page_id % 9)
      WHEN query = '' THEN 'page=' || page_id % 9 ELSE query || '&page=' || page_id % 9 END || fragment AS page_url FROM parts
""")
def p11_set_page_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query parameter set in place, or added; fragments stay."""
    return table(spark, sf_dir, "pages").select("page_id", text.with_parameter(F.col("url"), "page", F.col("page_id") % 9).alias("page_url"))


@query("s13_letter_pages", """
    WITH heads AS (SELECT upper(substr(n_name, 1, 1)) || n_nationkey AS letter, n_nationkey % 4 + 1 AS n_pages FROM nation)
    SELECT letter, p::INTEGER AS page, 'https://x.invalid/people?mode=people&query=%2Binitial%3A' || letter || '&page=' || p AS url FROM heads, unnest(range(1, n_pages + 1)) AS t(p)
""")
def s13_letter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory's pages to fetch: as many for each letter as its first page says."""
    letter = F.concat(F.upper(F.substring("n_name", 1, 1)), F.col("n_nationkey").cast("string"))
    label = F.concat(F.lit("page 1 of "), (F.col("n_nationkey") % 4 + 1).cast("string"))
    heads = table(spark, sf_dir, "nation").select(letter.alias("letter"), F.explode(F.sequence(F.lit(1), text.page_count(label))).alias("page"))
    return heads.select("letter", "page", text.with_parameter(text.letter_url(F.lit("https://x.invalid/people"), F.col("letter")), "page", F.col("page")).alias("url"))


@query("p14_code_and_description", """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type || ' ' || p_size END AS description FROM part
""")
def p14_code_and_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sector's code and description after its label."""
    body = F.concat(F.replace("p_brand", F.lit(" "), F.lit("")), F.lit("  "), "p_type", F.lit("\n "), F.col("p_size").cast("string"))
    raw = F.concat(F.lit("Sector: "), F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(body))
    return table(spark, sf_dir, "part").select("p_partkey", text.code_and_description(raw).alias("s")).select("p_partkey", "s.name", "s.description")


_DETAILS_SQL = """
    SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS credits, p_brand || '; ' || p_type AS ssd, p_name AS language, '' AS teaching_mode,
    DATE '2025-01-01' + CAST(p_partkey % 28 AS INTEGER) AS begins, DATE '2025-03-05' + CAST(p_partkey % 20 AS INTEGER) AS ends FROM part
"""


@query("p17_course_details", _DETAILS_SQL)
def p17_course_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits, distinct sectors and languages, and the period of a details section in two languages."""
    begin, end = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("p_partkey") % 28).cast("int")), F.date_add(F.lit("2025-03-05").cast("date"), (F.col("p_partkey") % 20).cast("int"))
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), value, F.lit("\n"))
    section = F.concat(
        F.when(F.col("p_partkey") % 6 == 0, "").otherwise(line("Credits", F.col("p_size").cast("string"))),
        line("SSD", F.concat(F.col("p_brand"), F.lit(" (Module 1);"))),
        line("SSD", F.col("p_type")),
        line("SSD", F.col("p_brand")),
        line("Lingua di insegnamento", F.col("p_name")),
        F.lit("- Teaching Mode:\n- Campus: elsewhere\n"),
        F.lit("dal "), F.date_format(begin, "dd/MM/yyyy"), F.lit(" al 02/03/2025, from "), F.date_format(F.date_add(begin, 5), "MMM d, yyyy"), F.lit(" to "), F.date_format(end, "MMMM d, yyyy"),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", text.course_details(section).alias("d"))
    return rows.select("p_partkey", "d.credits", "d.ssd", "d.language", "d.teaching_mode", F.col("d.schedule.from").alias("begins"), F.col("d.schedule.to").alias("ends"))


@query("p16_unique_values", """
    WITH v AS (SELECT p_partkey, unnest([p_brand, p_type, p_brand, p_name, p_type]) AS x, unnest([1, 2, 3, 4, 5]) AS i FROM part),
    f AS (SELECT p_partkey, x, min(i) AS i FROM v GROUP BY p_partkey, x) SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS found FROM f GROUP BY p_partkey
""")
def p16_unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of a pattern in first-seen order."""
    lines = F.array(*[F.concat(F.lit("- k: "), c, F.lit(" ;")) for c in ("p_brand", "p_type", "p_brand", "p_name", "p_type")])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.unique_values(F.array_join(lines, "\n"), r"- k: ([^\n]+)"), "|").alias("found"))


@query("p18_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def p18_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in three spellings read back; anything else is null."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format(day, "d/M/yyyy")).when(k == 1, F.date_format(day, "MMM d, yyyy")).when(k == 2, F.date_format(day, "MMMM dd, yyyy")).otherwise("31/02/2025")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_value(said).alias("day"))


@query("p19_min_max_schedule", "SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS begins, CAST(max(l_shipdate) AS DATE) AS ends FROM lineitem GROUP BY l_orderkey")
def p19_min_max_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole span of an order's periods."""
    day = F.date_format(F.col("l_shipdate").cast("date"), "dd/MM/yyyy")
    periods = F.array_join(F.collect_list(F.concat(F.lit("dal "), day, F.lit(" al "), day)), "; ")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(periods.alias("said"))
    return rows.select("l_orderkey", text.schedule(F.col("said")).alias("s")).select("l_orderkey", F.col("s.from").alias("begins"), F.col("s.to").alias("ends"))


@query("p22_shorten", """
    WITH x AS (SELECT c_custkey, replace(replace('Department of ' || c_name || ' and ' || c_mktsegment || ' studies', 'Department of', 'Dept.'), ' and ', ' & ') AS s FROM customer)
    SELECT c_custkey, CASE WHEN length(s) > 38 THEN left(s, 37) || '…' ELSE s END AS label FROM x
""")
def p22_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart labels: ordered replacements, then at most 38 characters."""
    name = F.concat(F.lit("Department of "), "c_name", F.lit(" and "), "c_mktsegment", F.lit(" studies"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.shorten(name, (("Department of", "Dept."), (" and ", " & "))).alias("label"))


@query("p24_backoff", """
    SELECT c_custkey, coalesce(string_agg(CAST(least(0.5 * 2 ** k, 30.0) * 10 AS BIGINT)::VARCHAR, ',' ORDER BY k) FILTER (WHERE k IS NOT NULL), '') AS tenths
    FROM customer LEFT JOIN (SELECT unnest(range(0, 12)) AS k) ON k < c_custkey % 10 GROUP BY c_custkey
""")
def p24_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before each retry, in tenths of a second."""
    waits = text.waits((F.col("c_custkey") % 10).cast("int"), F.lit(0.5), F.lit(2.0), F.lit(30.0))
    tenths = F.transform(waits, lambda w: (w * 10).cast("long").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(tenths, ",").alias("tenths"))


@query("p25_row_context", """
    SELECT page_id, 'row=' || page_id || ' title=''' || CASE WHEN page_id % 3 = 0 THEN '<missing title>' ELSE 'T' || page_id END || ''' url=' ||
    CASE WHEN page_id % 5 = 0 THEN '<missing url>' ELSE url END AS said, replace('a"b"' || url, '"', '''') AS quoted, regexp_replace(url, '[^0-9]', '', 'g') AS digits, trim(replace(' see map ' || url, 'see map', '')) AS address FROM pages
""")
def p25_row_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message contexts, quotes, digits of a name and a label taken off."""
    title = F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.concat(F.lit("T"), F.col("page_id").cast("string")))
    url = F.when(F.col("page_id") % 5 != 0, F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.course_context(F.col("page_id"), title, url).alias("said"),
        text.single_quotes(F.concat(F.lit('a"b"'), "url")).alias("quoted"),
        text.digits(F.col("url")).alias("digits"),
        text.without_label(F.concat(F.lit(" see map "), "url"), "see map").alias("address"),
    )


@query("p30_last_with_prefix", """
    SELECT o_custkey, coalesce(max_by(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F')::VARCHAR, '') AS last_f FROM orders GROUP BY o_custkey
""")
def p30_last_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last paragraph with a given prefix."""
    said = F.concat("o_orderstatus", F.lit(": "), F.col("o_orderkey").cast("string"))
    # Of each customer's paragraphs the last one with the prefix is kept on the way; no list of them is made.
    last = F.max_by(said, F.when(F.startswith(said, F.lit("F: ")), F.col("o_orderkey")))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last.alias("last"))
    return rows.select("o_custkey", text.last_with_prefix(F.array(F.coalesce("last", F.lit(""))), "F: ").alias("last_f"))


@query("p31_url_key", "SELECT page_id, sha256(url) AS key FROM pages")
def p31_url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a page in the page table."""
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("key"))


@query("j7_page_table", """
    SELECT w.page_id, p.html IS NOT NULL AS cached, coalesce(length(p.html), 0)::BIGINT AS n_chars, CASE WHEN w.page_id % 11 = 0 THEN 'skip' WHEN w.page_id % 13 = 0 THEN 'fail' ELSE 'ok' END AS status
    FROM pages w LEFT JOIN (SELECT DISTINCT sha256(url) AS key, html FROM pages WHERE page_id % 2 = 0) p ON sha256(w.url) = p.key
""")
def j7_page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted pages against the page table by key, with the status of each fetch."""
    pages = table(spark, sf_dir, "pages")
    held = pages.filter(F.col("page_id") % 2 == 0).select(text.url_key(F.col("url")).alias("key"), "html").distinct()
    code = F.when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 13 == 0, 500).otherwise(200)
    wanted = pages.select("page_id", text.url_key(F.col("url")).alias("wanted"), code.alias("code"))
    rows = wanted.join(held, F.col("wanted") == F.col("key"), "left")
    return rows.select("page_id", F.col("html").isNotNull().alias("cached"), F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("n_chars"), text.fetch_status(F.col("code")).alias("status"))


WARES = {"tiny": ("small",), "tiny widget": ("small widget", "small  widget"), "gadget": ("widget", "gadget"), "band": ("ring",), "metal": ("steel", "brass", "copper", "tin"), "box": ("box", "case", "pack")}


def _case(column: str) -> str:
    whens = " ".join(f"WHEN contains(lower(trim({column})), {_value(a)}) THEN {_value(k)}" for a, k in classify.checklist(WARES))
    return f"CASE {whens} END"


@query("c1_classify", f"""
    WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE upper(p_type) || ' ' || p_name END AS raw FROM part)
    SELECT p_partkey, {_case('raw')} AS class, coalesce({_case('raw')}, raw, '') AS value, {_case('raw')} IS NOT NULL AS recognised FROM x
""")
def c1_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the longest contained alias, each distinct value looked up once; the raw value where there is none."""
    raw = F.when(F.col("p_partkey") % 9 != 0, F.concat(F.upper("p_type"), F.lit(" "), "p_name"))
    rows = classify.classify_distinct(table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "raw", WARES, "class")
    return rows.select("p_partkey", "class", F.coalesce("class", "raw", F.lit("")).alias("value"), F.col("class").isNotNull().alias("recognised"))


@query("c2_duplicate_aliases", "SELECT p_name AS alias, count(DISTINCT p_brand) AS n_keys FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def c2_duplicate_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that stand for several keys."""
    return classify.duplicate_aliases(table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("key")))


_NUMBERED = "p_partkey || '' AS alias, 'k' || p_partkey % 97 AS key, p_partkey AS place FROM part"


@query("c1_classify_by_table", f"""
    WITH a AS (SELECT {_NUMBERED}), v AS (SELECT DISTINCT o_orderkey || '/' || o_custkey AS said FROM orders),
    best AS (SELECT said, arg_max(key, (length(alias), -place)) AS class FROM v JOIN a ON contains(said, alias) GROUP BY said)
    SELECT o_orderkey, class FROM orders LEFT JOIN best ON said = o_orderkey || '/' || o_custkey
""")
def c1_classify_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values classified by an alias table that grows with the input, by equal pieces; the longest alias decides, then its place."""
    key = F.col("p_partkey")
    aliases = table(spark, sf_dir, "part").select(key.cast("string").alias("alias"), F.concat(F.lit("k"), (key % 97).cast("string")).alias("key"), key.alias("place"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_custkey").cast("string")).alias("said"))
    return classify.classify_by_table(rows, "said", aliases, "class").select("o_orderkey", "class")


@query("f5_keyword_tables", r"""
    WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS keyword FROM benchmark), d AS (SELECT DISTINCT lower(text) AS said FROM documents),
    hits AS (SELECT said, string_agg(keyword, '|' ORDER BY keyword) AS found FROM d JOIN w ON contains(said, keyword) GROUP BY said)
    SELECT doc_id, coalesce(found, '') AS found, found IS NOT NULL AND NOT contains(lower(text), 'licens') AS passes FROM documents LEFT JOIN hits ON said = lower(text)
""")
def f5_keyword_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate whose white list is a table of keywords: every word of the benchmark that a whole text holds, and the verdict."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))
    white = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("keyword"))
    rows = classify.keywords_by_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", white, "found")
    passes = report.passes_lists(F.col("found"), text.keywords_found(F.col("text"), ("licens",)), any_white=True)
    return rows.select("doc_id", F.array_join("found", "|").alias("found"), F.coalesce(passes, F.size("found") > 0).alias("passes"))


WHITE, BLACK = ("THE ", "licens"), ("idiot", "!!")


@query("f4_keyword_gate", """
    SELECT doc_id, concat_ws('|', CASE WHEN contains(lower(text), 'the') THEN 'the' END, CASE WHEN contains(lower(text), 'licens') THEN 'licens' END) AS white,
    concat_ws('|', CASE WHEN contains(lower(text), 'idiot') THEN 'idiot' END, CASE WHEN contains(text, '!!') THEN '!!' END) AS black,
    (contains(lower(text), 'the') OR contains(lower(text), 'licens')) AND NOT (contains(lower(text), 'idiot') OR contains(text, '!!')) AS passes FROM documents
""")
def f4_keyword_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords found by a white and a black list, and the verdict."""
    white, black = text.keywords_found(F.col("text"), WHITE), text.keywords_found(F.col("text"), BLACK)
    passes = report.passes_lists(white, black, any_white=True)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(white, "|").alias("white"), F.array_join(black, "|").alias("black"), passes.alias("passes"))


@query("j1_courses_of_people", """
    SELECT DISTINCT c_custkey, o_orderpriority AS name, coalesce(nullif(o_orderkey % 5, 0), 0)::BIGINT AS credits FROM customer JOIN orders ON o_custkey = c_custkey WHERE trim(c_mktsegment) = 'BUILDING'
""")
def j1_courses_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct offers of the people of one department."""
    people = table(spark, sf_dir, "customer").filter(report.in_department("c_mktsegment", "BUILDING")).select("c_custkey")
    offers = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 5).alias("credits"))
    return report.courses_of_people(people, report.light_course(offers).drop("id"), "c_custkey", "o_custkey")


_SOLD = """
    sold AS (SELECT DISTINCT s_nationkey, p_partkey AS id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS credits
             FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
"""


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("credits"))
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rows = pairs.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("s_nationkey", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "credits").distinct()


@query("j2_exclude_known", f"""
    WITH {_SOLD}, known AS (SELECT id, name, credits FROM sold WHERE s_nationkey = 3)
    SELECT * FROM sold s WHERE coalesce(s_nationkey, -1) <> 3 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.id IS NOT DISTINCT FROM s.id AND k.name IS NOT DISTINCT FROM s.name AND k.credits IS NOT DISTINCT FROM s.credits)
""")
def j2_exclude_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of others that one department does not have; null credits equal null credits."""
    sold = _sold(spark, sf_dir)
    others = sold.filter(F.coalesce("s_nationkey", F.lit(-1)) != 3)
    return report.without_known(others, sold.filter("s_nationkey = 3"), ["id", "name", "credits"])


@query("j2_people_with_empty", f"""
    WITH {_SOLD}, known AS (SELECT DISTINCT id, name, credits FROM sold WHERE s_nationkey < 20), people AS (SELECT DISTINCT s_nationkey FROM sold),
    rest AS (SELECT * FROM sold s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id IS NOT DISTINCT FROM s.id AND k.name IS NOT DISTINCT FROM s.name AND k.credits IS NOT DISTINCT FROM s.credits))
    SELECT p.s_nationkey, count(r.id)::INTEGER AS n_courses FROM people p LEFT JOIN rest r USING (s_nationkey) GROUP BY p.s_nationkey
""")
def j2_people_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone with what remains to them, those with nothing too."""
    sold = _sold(spark, sf_dir)
    left = report.without_known(sold, sold.filter("s_nationkey < 20"), ["id", "name", "credits"])
    people = report.nested_by_person(sold, left, ["s_nationkey"], ["id", "name", "credits"])
    return people.select("s_nationkey", F.size("courses").alias("n_courses"))


@query("j4_coalesce_variants", """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(nullif(CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.lang END, ''), 'q' || l.quality) AS language
    FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) d FULL OUTER JOIN (SELECT * FROM labels WHERE doc_id % 5 < 3) l ON d.doc_id = l.doc_id
""")
def j4_coalesce_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of a record merged field by field, the empty string counting as missing."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("language"))
    labels = table(spark, sf_dir, "labels").filter("doc_id % 5 < 3").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("language"))
    return merge.merge_variants(docs, labels, ["doc_id"], ["language"])


@query("a1_merge_groups", """
    WITH f AS (SELECT year(o_orderdate)::INTEGER AS year, o_custkey, o_orderstatus, nullif(o_orderpriority, '3-MEDIUM') AS v, min(o_orderkey) AS first FROM orders GROUP BY ALL)
    SELECT year, o_custkey, o_orderstatus, coalesce(string_agg(v, ';' ORDER BY first) FILTER (WHERE v IS NOT NULL), '') AS priorities FROM f GROUP BY year, o_custkey, o_orderstatus
""")
def a1_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each merged entity in the order in which they first come."""
    value = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey", "o_orderstatus", "o_orderkey", value.alias("v"))
    seen = merge.first_seen_values(rows, ["year", "o_custkey", "o_orderstatus"], "v", "o_orderkey", "seen")
    return seen.select("year", "o_custkey", "o_orderstatus", F.array_join("seen", ";").alias("priorities"))


@query("a4_first_and_conflicts", """
    WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderpriority END AS v FROM orders)
    SELECT o_custkey, arg_min(v, o_orderkey) FILTER (WHERE v IS NOT NULL) AS first, count(DISTINCT v) > 1 AS conflicting FROM x GROUP BY o_custkey
""")
def a4_first_and_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each entity that is not empty, and whether others differ."""
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k == 0, None).when(k == 1, "").otherwise(F.col("o_orderpriority")).alias("v"))
    return rows.groupBy("o_custkey").agg(merge.first_value(F.col("v"), F.col("o_orderkey")).alias("first"), merge.conflicting(F.col("v")).alias("conflicting"))


@query("a7_letter_suffix", """
    WITH g AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS year, o_custkey, o_orderstatus FROM orders)
    SELECT year, o_custkey, o_orderstatus, CASE WHEN count(*) OVER w = 1 THEN '' ELSE '-' || chr((64 + row_number() OVER (PARTITION BY year, o_custkey ORDER BY o_orderstatus))::INTEGER) END AS suffix FROM g WINDOW w AS (PARTITION BY year, o_custkey)
""")
def a7_letter_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters for the variants of an entity, none where it has one."""
    groups = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey", "o_orderstatus").distinct()
    return merge.suffixes(groups, ["year", "o_custkey"], "o_orderstatus")


@query("a9_status_counts", """
    SELECT CASE WHEN n_chars < 200 THEN 'skipped' WHEN contains(text, '!!') THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1
""")
def a9_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by outcome."""
    status = F.when(F.col("n_chars") < 200, "skipped").when(F.contains("text", F.lit("!!")), "failed").otherwise("ok")
    return report.status_counts(table(spark, sf_dir, "documents"), status)


@query("a11_group_sorted", """
    WITH d AS (SELECT DISTINCT trim(CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END) AS department, p_partkey % 50 AS id, p_name AS name, p_size % 7 AS credits FROM part WHERE p_size % 3 > 0)
    SELECT department, count(*)::INTEGER AS n_courses, string_agg(id || '/' || name || '/' || credits, ';' ORDER BY id, name, credits) AS courses FROM d GROUP BY department
""")
def a11_group_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct courses of each department, sorted; departments without courses vanish."""
    course = F.struct((F.col("p_partkey") % 50).alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 7).alias("credits"))
    courses = F.when(F.col("p_size") % 3 > 0, F.array(course)).otherwise(F.array().cast("array<struct<id:bigint,name:string,credits:int>>"))
    people = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 10 == 0, None).otherwise(F.col("p_brand")).alias("department"), courses.alias("courses"))
    grouped = report.department_courses(people)
    said = F.transform("courses", lambda c: F.concat_ws("/", c["id"].cast("string"), c["name"], c["credits"].cast("string")))
    return grouped.select("department", F.size("courses").alias("n_courses"), F.array_join(said, ";").alias("courses"))


@query("a12_credit_totals", """
    SELECT o_custkey, coalesce(nullif(trim(replace(CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'D' || chr(10) || o_custkey END, chr(10), ' ')), ''), '(no department)') AS department,
    sum(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 12 END, 0))::BIGINT AS credits FROM orders GROUP BY o_custkey
""")
def a12_credit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of each entry, missing ones counting as none; entries without a department are named so."""
    credits = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 12)
    # Summed on the way, so an entry is one course with all its credits and no list of orders is made.
    entries = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(credits).alias("credits"))
    name = F.when(F.col("o_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit("D\n"), F.col("o_custkey").cast("string")))
    return report.credit_totals(entries.select("o_custkey", name.alias("department"), F.array(F.struct("credits")).alias("courses")), keep=("o_custkey",))


@query("a13_grand_totals", "SELECT count(*) AS n, sum(p_size)::BIGINT AS credits, count(DISTINCT p_brand) AS departments FROM part")
def a13_grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over everything."""
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("credits"), F.count_distinct("p_brand").alias("departments"))


@query("o4_limit_ok_rows", """
    WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS oks FROM events)
    SELECT event_id, event_type FROM e WHERE oks < 50 OR (oks = 50 AND event_type = 'purchase')
""")
def o4_limit_ok_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order up to the fiftieth that counts."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return report.first_ok(events, F.col("event_type") == "purchase", ["ts", "event_id"], 50).select("event_id", "event_type")


@query("u2_union_of_offers", """
    SELECT id, name FROM (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size < 20 UNION SELECT p_partkey, p_name FROM part WHERE p_size > 10)
""")
def u2_union_of_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union of two sets of offers."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return part.filter("p_size < 20").drop("p_size").unionByName(part.filter("p_size > 10").drop("p_size")).distinct()


def _decoded(column: str) -> str:
    for said, meant in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        column = f"replace({column}, {_value(said)}, {_value(meant)})"
    return column


@query("h_title_and_links", rf"""
    SELECT page_id, trim(regexp_replace({_decoded("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")}, '\s+', ' ', 'g')) AS heading, array_to_string(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1), ' ') || ' /x?a=1&b=2' AS links FROM pages
""")
def h_title_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading of a page and the targets of its links."""
    html = F.concat(F.lit("<!-- <h1>no</h1><a href='/no'> -->"), "html", F.lit("<a class='x' href='/x?a=1&amp;b=2'>x</a><!-- <a href='/no'>"))
    return table(spark, sf_dir, "pages").select("page_id", markup.first_element(html, "h1").alias("heading"), F.array_join(markup.links(html), " ").alias("links"))


@query("h8_sections", r"""
    WITH s AS (SELECT conv_id, role AS title, min(turn) AS first, string_agg(trim(regexp_replace(text, '[ \t]+', ' ', 'g')), chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id, role)
    SELECT conv_id, title, body FROM s
""")
def h8_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a Markdown page, those of one title joined."""
    part = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text", F.lit("\n\n"))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))["part"], "")
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("# page\nlost\n"), joined).alias("markdown"))
    return markup.sections(pages, ["conv_id"], "markdown").select("conv_id", "title", "body")


def _markdown_sql() -> str:
    """``markdown`` of the given pages, whose markup is regular enough for patterns."""
    out = r"regexp_replace(regexp_replace(html, '^.*<body>', '', 's'), '<!--.*?-->', '', 'gs')"
    steps = (
        (r"[ \t\r\n]+", " "), (r'<a href="([^"]*)">([^<]*)</a>', r"[\2](\1)"), ("<li>", "\n- "), ("<h1>", "\n\n# "), ("<h2>", "\n\n## "), ("<br>", "\n"), ("</?b>|</li>|</?body>|</?html>", ""),
        ("</?(p|div|article|nav|footer|ul|h1|h2)( [^>]*)?>", "\n\n"),
    )
    for pattern, by in steps:
        out = f"regexp_replace({out}, {_value(pattern)}, {_value(by)}, 'g')"
    out = f"regexp_replace({_decoded(out)}, ' *\n *', chr(10), 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query("h5_html_to_text", f"SELECT page_id, url, markdown, nullif(trim(regexp_extract(markdown, '(?s)(?:^|\n)(# .*)$', 1)), '') AS body FROM (SELECT page_id, url, {_markdown_sql()} AS markdown FROM pages)")
def h5_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, from the first heading to the tail."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", markup.to_markdown(F.col("html")).alias("markdown"))
    return pages.select("page_id", "url", "markdown", markup.syllabus_text(F.col("markdown")).alias("body"))


@query("p13_absolute_links", rf"""
    WITH h AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) AS site, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages)
    SELECT page_id, (i - 1)::INTEGER AS at, site || {_decoded("h[i]")} AS link, {_decoded("h[i]")} AS wrapped FROM h, unnest(range(1, len(h) + 1)) AS t(i)
""")
def p13_absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of a page, resolved against it."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(markup.links(F.col("html"))).alias("at", "href"))
    return rows.select("page_id", "at", text.resolved(F.col("url"), F.col("href")).alias("link"), markup.wrapped("href").alias("wrapped"))


@query("k3_partition_layout", """
    SELECT c_mktsegment AS segment, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
""")
def k3_partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by folder after records were written one folder a (segment, year) and read back."""
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    rows = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("segment", F.year("o_orderdate").alias("year"), "o_orderkey")
    back = files.write_folders(rows, ["segment", "year"])
    return back.groupBy("segment", "year").agg(F.count("*").alias("n"))


@query("o3_global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, round(o_totalprice) DESC, o_orderkey) AS place FROM orders")
def o3_global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's place among all, by ranges and prefix sums; no window over the table."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice").alias("price"))
    return ranks.global_rank(rows, [("o_orderpriority", False), ("price", True), ("o_orderkey", False)]).select("o_orderkey", "place")


@query("s1_numbered_values", """
    WITH l AS (SELECT year(o_orderdate)::INTEGER AS year, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) + 1 AS line FROM orders)
    SELECT year, line, 'k' || o_orderkey AS value FROM l WHERE o_orderkey % 3 > 0
""")
def s1_numbered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a CSV's column that are not blank, in files of a year each, with the numbers of their rows."""
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" k"), k.cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), k.cast("string").alias("key"), value.alias("value"), "o_orderkey")
    folder = Tables(spark, "lines").path
    laid = rows.repartition("year").sortWithinPartitions("year", "o_orderkey").drop("o_orderkey")
    laid.write.partitionBy("year").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder, header=True)
    read = spark.read.csv(folder, header=True, escape='"')
    return ranks.numbered_lines(read, first=2).select("year", "line", F.trim("value").alias("value")).filter("value <> ''")


@query("p23_wrapped_labels", """
    WITH w AS (SELECT p_partkey, string_split(p_name || ' of the department for ' || lower(p_type) || ' and ' || p_name, ' ') AS words FROM part)
    SELECT p_partkey, list_reduce(words, lambda a, w: a || CASE WHEN length(regexp_extract(replace(a, '<br>', chr(10)), '[^\n]*$')) + 1 + length(w) <= 32 THEN ' ' ELSE '<br>' END || w) AS label FROM w
""")
def p23_wrapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of several words broken into lines of 32 characters at most."""
    label = F.concat("p_name", F.lit(" of the department for "), F.lower("p_type"), F.lit(" and "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", markup.wrapped(label).alias("label"))


@query("p30_paragraphs", """
    WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'The ') OR starts_with(x, 'Le ')) AS fit FROM documents)
    SELECT doc_id, coalesce(trim(CASE WHEN starts_with(fit[-1], 'The ') THEN substr(fit[-1], 5) END), '') AS last_the, coalesce(trim(substr(list_filter(fit, lambda x: starts_with(x, 'Le '))[-1], 4)), '') AS last_le FROM l
""")
def p30_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a text's lines the last with a prefix, in full however long it is."""
    lines = F.split("text", "\n")
    fit = F.filter(lines, lambda x: F.startswith(x, F.lit("The ")) | F.startswith(x, F.lit("Le ")))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.last_with_prefix(F.slice(fit, F.greatest(F.size(fit), F.lit(1)), 1), "The ").alias("last_the"), text.last_with_prefix(lines, "Le ").alias("last_le"))
    return rows.select("doc_id", F.coalesce("last_the", F.lit("")).alias("last_the"), F.coalesce("last_le", F.lit("")).alias("last_le"))
