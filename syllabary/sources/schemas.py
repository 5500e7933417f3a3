"""Schemas of the catalogue's entities."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# The columns of the interchange files and the fields of the records.
CONTACT = T.StructType(_strings("uid", "name", "role", "department", "address", "email", "website", "vcard"))
COURSE_HEADER = T.StructType(
    _strings(
        "contact_uid", "contact_name", "contact_email", "sito_web", "didattica_url", "course_title", "course_url",
        "integrated_course", "campus", "degree_course", "lesson_period", "schedule_url", "virtuale_url",
    )
)
COURSE_BLOCK = T.StructType(_strings("course_title", "course_url", "integrated_course", "campus", "degree_course", "lesson_period", "schedule_url", "virtuale_url"))
PERSON = T.StructType(_strings("role", "affiliation", "ssd"))
SSD = T.StructType(_strings("name", "description"))
TEACHER = T.StructType([*_strings("id", "name", "email", "website", "role", "affiliation"), T.StructField("ssd", SSD)])
TITLE = T.StructType([*_strings("id", "name"), T.StructField("details", T.ArrayType(T.StringType()))])
SCHEDULE = T.StructType([T.StructField("from", T.DateType()), T.StructField("to", T.DateType())])
PAGE = T.StructType([*_strings("url", "title"), T.StructField("contents", T.MapType(T.StringType(), T.StringType()))])
TEACHING = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("credits", T.IntegerType()),
        *_strings("ssd", "language", "teaching_mode"),
        T.StructField("schedule", SCHEDULE),
        T.StructField("teacher", TEACHER),
        T.StructField("course_title", TITLE),
        *_strings("integrated_course", "campus", "programme"),
        T.StructField("syllabus", T.MapType(T.StringType(), PAGE)),
    ]
)
# End of fixed values.
