"""The report chain: people and courses, exclusion of known courses, grouping by department, credit totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabary.functions import text
from syllabary.operators.ranks import global_rank


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def in_department(column: str, department: str) -> Column:
    return F.trim(column) == department


def not_in_department(column: str, department: str) -> Column:
    """Also true of rows without a department."""
    return F.coalesce(F.trim(column), F.lit("")) != department


def light_course(courses: DataFrame) -> DataFrame:
    """``id, name, credits`` with the reports' defaults: an unknown name, no credits; of several credits the first."""
    kind = dict(courses.dtypes)["credits"]
    credits = F.try_element_at("credits", F.lit(1)) if kind.startswith("array") else F.col("credits")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Unknown"))
    rest = [c for c in courses.columns if c not in ("id", "name", "credits")]
    return courses.select(*rest, F.coalesce("id", F.lit("Unknown")).alias("id"), name.alias("name"), F.coalesce(credits, F.lit(0)).alias("credits"))


def courses_of_people(people: DataFrame, courses: DataFrame, person: str, folder: str) -> DataFrame:
    """The distinct courses of each person: an inner join, so people without courses go."""
    return people.join(courses, people[person] == courses[folder]).drop(folder).distinct()


def without_known(offered: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``offered`` whose key, nulls included, is not in ``known``."""
    k = known.select(*[F.col(c).alias(f"known_{c}") for c in key]).distinct()
    on = same(F.col(key[0]), F.col(f"known_{key[0]}"))
    for c in key[1:]:
        on = on & same(F.col(c), F.col(f"known_{c}"))
    return offered.join(k, on, "left_anti")


def nested_by_person(people: DataFrame, left: DataFrame, person: list[str], key: list[str]) -> DataFrame:
    """Every person with their remaining courses, in order; people with none keep an empty list."""
    lists = left.groupBy(*person).agg(F.sort_array(F.collect_set(F.struct(*key))).alias("courses"))
    empty = F.array().cast(lists.schema["courses"].dataType)
    return people.select(*person).distinct().join(lists, person, "left").withColumn("courses", F.coalesce("courses", empty))


def department_courses(people: DataFrame, department: str = "department", courses: str = "courses") -> DataFrame:
    """``department, courses``: the distinct courses of each department, by id, name and credits; departments without any vanish."""
    rows = people.select(F.trim(F.coalesce(department, F.lit(""))).alias("department"), F.explode(courses).alias("c")).distinct()
    return rows.groupBy("department").agg(F.sort_array(F.collect_list("c")).alias("courses"))


def credit_totals(entries: DataFrame, department: str = "department", courses: str = "courses", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, department and credits of each entry (entries are not grouped again)."""
    name = F.trim(F.replace(F.coalesce(department, F.lit("")), F.lit("\n"), F.lit(" ")))
    total = F.aggregate(F.coalesce(courses, F.array().cast(entries.schema[courses].dataType)), F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["credits"], F.lit(0)))
    return entries.select(*keep, F.when(name == "", "(no department)").otherwise(name).alias("department"), total.alias("credits"))


def chart(totals: DataFrame, longest: int = 38) -> tuple[DataFrame, DataFrame]:
    """(``place, label, credits`` of a bar chart, the smallest bar first, equal ones by name; one row ``caption, all_credits,
    n_departments`` that says what it shows) of ``department, credits``."""
    named = totals.select(text.shorten(F.col("department"), (), longest).alias("label"), "credits", "department")
    rows = global_rank(named, [("credits", False), ("department", False)]).select("place", "label", "credits")
    sums = totals.agg(F.coalesce(F.sum("credits"), F.lit(0)).cast("long").alias("all_credits"), F.count("*").alias("n_departments"))
    said = F.concat(F.lit("Credits by department: "), F.col("all_credits").cast("string"), F.lit(" in "), F.col("n_departments").cast("string"), F.lit(" departments"))
    return rows, sums.select(said.alias("caption"), "all_credits", "n_departments")


def status_counts(rows: DataFrame, status: Column) -> DataFrame:
    """``status, n`` over ok, skipped and failed rows."""
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def first_ok(rows: DataFrame, ok: Column, order: list[str], limit: int) -> DataFrame:
    """Rows up to the ``limit``-th ok one, in an order; rows that are not ok do not count.

    The limit-th ok row's place is found first (a top-k, which Spark takes per partition), so no window holds the table.
    """
    place = F.struct(*order)
    last = rows.filter(ok).select(place.alias("p")).orderBy("p").limit(limit).agg(F.max("p").alias("last"), F.count("*").alias("n")).first()
    if limit <= 0 or last["n"] == 0:
        return rows.limit(0) if limit <= 0 else rows
    if last["n"] < limit:
        return rows
    bound = F.struct(*[F.lit(v).alias(c) for c, v in zip(order, last["last"], strict=True)])
    return rows.filter(place <= bound)


def top_of_each(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def passes_lists(found_white: Column, found_black: Column, any_white: bool) -> Column:
    """Keyword gate: one of the white list, where there is one, and none of the black list."""
    white = F.size(found_white) > 0 if any_white else F.lit(True)
    return white & (F.size(found_black) == 0)
