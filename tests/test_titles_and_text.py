"""Titles, dates, fields and URLs, case by case."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from syllabary.functions import text, titles


def values(spark, column, *rows):
    out = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").withColumn("y", column(F.col("x")))
    return [r["y"].asDict(True) if hasattr(r["y"], "asDict") else r["y"] for r in out.orderBy("i").collect()]


def test_titles(spark):
    cases = {
        "10001 - GRAPH THEORY - 5 cfu": ("10001", "GRAPH THEORY", ["5 cfu"]),
        "B0001 - GRAPH THEORY (GT) - 6 cfu": ("B0001", "GRAPH THEORY", ["GT", "6 cfu"]),
        "00042 - BASICS OF LOGIC L-1 - 3 cfu": ("00042", "BASICS OF LOGIC L-1", ["3 cfu"]),
        "10002 - MACHINES M (Module 4)": ("10002", "MACHINES M", ["Module 4"]),
        "10003 - DATA STRUCTURES (CL.A) (Module 2)": ("10003", "DATA STRUCTURES", ["CL.A", "Module 2"]),
        "10004 - STATE-OF-THE-ART SYSTEMS - 6 CFU": ("10004", "STATE-OF-THE-ART SYSTEMS", ["6 CFU"]),
        "NO HYPHEN (HERE)": ("", "NO HYPHEN (HERE)", []),
        "1 - A (b (c) d) e": ("1", "A  e", ["b (c) d"]),
        "1 - A (open": ("1", "A (open", []),
        "1 - A) b (": ("1", "A) b (", []),
        "1 - A () (-x) b": ("1", "A   b", []),
        "1 - A – 3 CFU": ("1", "A – 3 CFU", []),
        "1 - A - 3 CFU — 4 cfu": ("1", "A— 4 cfu", ["3 CFU "]),
        "": ("", "", []),
    }
    found = values(spark, titles.split_title, *cases)
    assert [(x["id"], x["name"], x["details"]) for x in found] == list(cases.values())


def test_dates_and_schedule(spark):
    assert values(spark, text.date_value, "9/9/2025", "09/10/2025", "Sep 9, 2025", "september 09, 2025", "31/02/2025", "", None) == [
        datetime.date(2025, 9, 9), datetime.date(2025, 10, 9), datetime.date(2025, 9, 9), datetime.date(2025, 9, 9), None, None, None,
    ]
    found = values(spark, text.schedule, "dal 10/02/2025 al 01/03/2025; from Jan 5, 2025 to February 2, 2025", "none")
    assert found == [{"from": datetime.date(2025, 1, 5), "to": datetime.date(2025, 3, 1)}, None]


def test_details_keep_to_their_line(spark):
    section = "- Credits: 6\n- SSD: A/01\n- SSD: A/01;\n- SSD: B/02 (Modulo 1)\n- Teaching Mode:\n- Campus: X\n- Language: English"
    assert values(spark, text.course_details, section)[0] == {"credits": 6, "ssd": "A/01; B/02", "language": "English", "teaching_mode": "", "schedule": None}


def test_clean_and_lines(spark):
    assert values(spark, text.clean, "  a   b\n\tc  ", "", None) == ["a b c", "", None]
    assert values(spark, text.normalize_lines, " a  b \n\n\n \n c\t", "", None) == ["a b\n\nc", "", None]


def test_urls(spark):
    assert values(spark, text.urls, "see (https://a.b/c). and https://d.e/f,") == [["https://a.b/c", "https://d.e/f"]]
    assert values(spark, text.year_and_id, "https://x.y/i/2025/00B1/?q=1", "https://x.y/2025", "nothing", None) == [{"year": 2025, "id": "00B1"}, None, None, None]
    page = lambda u: text.with_parameter(u, "page", F.lit(3))
    assert values(spark, page, "https://x/y?a=1&page=2&b=#t", "https://x/y") == ["https://x/y?a=1&page=3&b=#t", "https://x/y?page=3"]
    both = lambda x: text.first_by_language(text.urls(x), r"https?://[^/]+/(it|en)/.*")
    assert values(spark, both, "https://h/it/1 https://h/en/2 https://h/it/3", "https://h/it/1") == [{"it": "https://h/it/1", "en": "https://h/en/2"}, None]


def test_codes_and_pager(spark):
    assert values(spark, text.code_and_description, "SSD: A/01 Some  field", "x:", "A/01") == [{"name": "A/01", "description": "Some field"}, None, {"name": "A/01", "description": ""}]
    assert values(spark, text.page_count, "page 1 of 12", "none", "") == [12, 1, 1]
