"""Entity merging: records of one (year, course, syllabus) become one, with ordered distinct attributes and conflicts.

One shuffle by the entity's key. ``merge_courses`` gathers the records of one course, of which there are as many as it has teachers;
``first_seen_values`` keeps one row a distinct value instead, for groups of any size. "First seen" always means the smallest of an explicit order
column, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabary.functions.text import normalize_lines


def has_value(x: Column) -> Column:
    """Neither null nor the empty string; 0 is a value."""
    return x.isNotNull() & (x.cast("string") != "")


def signature(pages: Column) -> Column:
    """A hash of map<language, struct<title, contents map>> that does not depend on the order of either map's keys."""
    inner = lambda p: F.array_sort(F.map_entries(p["contents"]))
    entries = F.transform(F.map_entries(pages), lambda e: F.struct(e["key"].alias("language"), e["value"]["title"].alias("title"), inner(e["value"]).alias("contents")))
    return F.sha2(F.to_json(F.array_sort(entries)), 256)


def first_seen(value: Column, order: Column) -> Column:
    """The distinct non-empty values of a group in the order in which they first come (an aggregate)."""
    pairs = F.collect_list(F.when(has_value(value), F.struct(order.alias("o"), value.alias("v"))))
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda p: p["v"]))


def first_seen_values(rows: DataFrame, entity: list[str], value: str, order: str, out: str) -> DataFrame:
    """``entity, out``: the same for groups of any size: only each distinct value's first place is kept before values are gathered."""
    firsts = rows.groupBy(*entity, value).agg(F.min(F.when(has_value(F.col(value)), F.col(order))).alias("first_place"))
    pairs = F.collect_list(F.when(has_value(F.col(value)), F.struct("first_place", F.col(value).alias("v"))))
    return firsts.groupBy(*entity).agg(F.array_sort(pairs)["v"].alias(out))


def first_value(value: Column, order: Column) -> Column:
    """The first non-empty value of a group (an aggregate)."""
    return F.min_by(value, F.when(has_value(value), order))


def conflicting(value: Column) -> Column:
    """Whether a group has different non-empty values, blanks and line ends apart (an aggregate)."""
    return F.count_distinct(F.when(has_value(value), normalize_lines(value.cast("string")))) > 1


def letters(n: Column) -> Column:
    """A, B, ... Z, AA, ... ZZ, AAA, ... for 0, 1, ..., of any length."""
    begin = F.struct(n.cast("long").alias("rest"), F.lit("").alias("said"))

    def step(s: Column, _: Column) -> Column:
        more = F.struct((F.floor(s["rest"] / 26) - 1).cast("long").alias("rest"), F.concat(F.char(s["rest"] % 26 + 65), s["said"]).alias("said"))
        return F.when(s["rest"] >= 0, more).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), begin, step, lambda s: s["said"])


def suffixes(groups: DataFrame, within: list[str], by: str, out: str = "suffix") -> DataFrame:
    """``out``: empty where an entity has one group, else -A, -B, ... -Z, -AA, ... in the order of ``by``."""
    own = Window.partitionBy(*within)
    n = F.row_number().over(own.orderBy(by)) - 1
    return groups.withColumn(out, F.when(F.count("*").over(own) == 1, "").otherwise(F.concat(F.lit("-"), letters(n))))


def merge_variants(preferred: DataFrame, other: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """A full outer join of two language variants; each field is the preferred one's where it has a value."""
    a = preferred.select(*key, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = other.select(*key, *[F.col(f).alias(f"b_{f}") for f in fields])
    pick = [F.when(has_value(F.col(f"a_{f}")), F.col(f"a_{f}")).otherwise(F.col(f"b_{f}")).alias(f) for f in fields]
    return a.join(b, key, "full_outer").select(*key, *pick)


def merge_courses(records: DataFrame) -> DataFrame:
    """Teaching records (``schemas.TEACHING`` plus ``teacher_dir``, ``file``) to one row for each (year, course id, syllabus).

    Records without a course id are left out. Columns: year, course_id, suffix, the merged attributes, teachers (each with its
    module, by name, e-mail and file), conflicts (names of attributes with several values) and files (the records' files, in order).
    """
    rows = records.filter(F.coalesce("course_title.id", F.lit("")) != "")
    rows = rows.withColumn("signature", signature(F.col("syllabus"))).withColumn("ord", F.struct("teacher_dir", "year", "file"))
    order = F.col("ord")
    listed = lambda c: first_seen(F.col(c), order)
    module = F.struct(
        "file",
        "url",
        F.map_filter(F.transform_values("syllabus", lambda _, p: p["url"]), lambda _, u: F.coalesce(u, F.lit("")) != "").alias("syllabus_urls"),
        F.col("course_title.details").alias("details"),
        *("credits", "schedule", "campus", "programme", "ssd", "language", "teaching_mode"),
    )
    teacher = F.struct(F.col("teacher.name").alias("name"), F.col("teacher.email").alias("email"), F.col("file").alias("by_file"), F.col("teacher").alias("teacher"), module.alias("module"))
    by_name = lambda a, b: _compare(a, b, ("name", "email", "by_file"))
    names = ("course_title.name", "integrated_course")
    conflicts = F.array_compact(F.array(*[F.when(conflicting(F.col(c)), F.lit(c)) for c in names]))
    merged = rows.groupBy("year", F.col("course_title.id").alias("course_id"), "signature").agg(
        first_value(F.col("course_title.name"), order).alias("name"),
        first_value(F.col("integrated_course"), order).alias("integrated_course"),
        listed("credits").alias("credits"),
        listed("ssd").alias("ssds"),
        listed("language").alias("languages"),
        listed("teaching_mode").alias("teaching_modes"),
        listed("campus").alias("campi"),
        listed("programme").alias("programmes"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("schedule").isNotNull(), F.struct(order.alias("o"), F.col("schedule").alias("v"))))), lambda p: p["v"])).alias("schedules"),
        F.transform(F.array_sort(F.collect_list(teacher), by_name), lambda t: F.struct(t["teacher"].alias("teacher"), t["module"].alias("module"))).alias("teachers"),
        F.min_by(F.transform_values("syllabus", lambda _, p: F.struct(p["title"].alias("title"), p["contents"].alias("contents"))), order).alias("syllabus"),
        conflicts.alias("conflicts"),
        F.transform(F.array_sort(F.collect_list(order)), lambda o: F.concat_ws("/", o["teacher_dir"], o["year"].cast("string"), o["file"])).alias("files"),
    )
    return suffixes(merged, ["year", "course_id"], "signature")


def _compare(a: Column, b: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for n in reversed(names):
        x, y = F.coalesce(a[n], F.lit("")), F.coalesce(b[n], F.lit(""))
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def links_of(merged: DataFrame) -> DataFrame:
    """``link, target``: for each record's folder a link to the merged course's file."""
    target = F.concat(F.lit("../../.files/"), F.col("year").cast("string"), F.lit("/course-"), F.col("course_id"), F.col("suffix"), F.lit(".yml"))
    name = F.concat(F.lit("course-"), F.col("course_id"), F.col("suffix"), F.lit(".yml"))
    rows = merged.select("year", F.explode("files").alias("file"), target.alias("target"), name.alias("name"))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return rows.select(F.concat(folder, F.lit("/"), "name").alias("link"), "target").distinct()
