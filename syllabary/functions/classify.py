"""Classification by a dictionary of aliases: the longest alias that a value contains decides.

Small dictionaries are a literal expression. Dictionaries of any size are tables (``matching``): a value meets them where it lies,
in blocks, and only what it contains is compared with it. Nothing passes the driver and no value is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.functions.matching import Aliases
from syllabary.sources.shared import Tables

#: Aliases that a literal expression holds; larger dictionaries are tables.
MOST_LITERALS = 1000

Dictionary = Mapping[str, tuple[str, ...] | list[str]]


def checklist(dictionary: Dictionary) -> list[tuple[str, str]]:
    """(alias, key), longest alias first, equal lengths in the dictionary's order; an alias of two keys is an error."""
    keys: dict[str, str] = {}
    for key, aliases in dictionary.items():
        for alias in aliases:
            if alias in keys:
                raise ValueError(f"alias {alias!r} stands for both {keys[alias]!r} and {key!r}")
            keys[alias] = key
    return sorted(keys.items(), key=lambda x: -len(x[0]))


def classify(x: Column, dictionary: Dictionary) -> Column:
    """The key of the longest contained alias, null where there is none, as a literal expression: for dictionaries of some hundred
    aliases. ``classify_distinct`` takes dictionaries of any size."""
    ranked = checklist(dictionary)
    if not ranked:
        return F.lit(None).cast("string")
    aliases = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(k).alias("key")) for a, k in ranked])
    value = F.trim(F.lower(x))
    return F.get(F.filter(aliases, lambda a: F.contains(value, a["alias"])), F.lit(0))["key"]


def _with(df: DataFrame, out: str, column: Column) -> DataFrame:
    """``df`` with a last column ``out``, in place of one that it may have."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != out], column.alias(out))


def classify_by_table(df: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """``df`` with the class of ``column`` in ``out``, by a table of any size: ``alias, key, place`` (equal lengths: smaller place).

    An alias of two keys is an error; null aliases are left out, and the empty one stands in every value.
    """
    whole = dict(aliases.dtypes)["place"] in ("tinyint", "smallint", "int", "bigint")
    place = F.coalesce(F.col("place").cast("long"), F.lit(2**63 - 1)) if whole else F.coalesce(F.col("place").cast("double"), F.lit(float("inf")))
    own = aliases.filter("alias is not null").select("alias", "key", place.alias("place")).groupBy("alias")
    twice = F.min("key") != F.max("key")
    said = own.agg(twice.alias("twice"), F.max(F.octet_length(F.col("key").cast("string"))).alias("n"))
    size = F.octet_length("alias") + F.coalesce("n", F.lit(0))
    seen = said.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size"), F.min(F.when(F.col("twice"), F.col("alias"))).alias("twice")).first()  # one row
    if seen["twice"] is not None:
        raise ValueError(f"alias {seen['twice']!r} stands for several keys")
    table = Aliases(own.agg(F.min_by("key", "place").alias("key"), F.min("place").alias("place")), Tables(df.sparkSession, "aliases"), seen["n"], seen["size"])
    return _with(df, out, table.best(F.trim(F.lower(F.col(f"`{column}`")))))


def classify_distinct(df: DataFrame, column: str, dictionary: Dictionary, out: str) -> DataFrame:
    """``df`` with the class of ``column`` in ``out``, by a dictionary of any size: each distinct value is looked up once."""
    ranked = checklist(dictionary)
    if len(ranked) > MOST_LITERALS:
        rows = [(a, k, i) for i, (a, k) in enumerate(ranked)]
        return classify_by_table(df, column, df.sparkSession.createDataFrame(rows, "alias string, key string, place long"), out)
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    classes = values.select(F.col("value"), classify(F.col("value"), dictionary).alias("class"))
    return df.join(classes.withColumnRenamed("class", out), F.col(column) == F.col("value"), "left").drop("value")


def keywords_by_table(df: DataFrame, column: str, keywords: DataFrame, out: str) -> DataFrame:
    """``df`` with the keywords (of ``keyword``, a row each, any number) that ``column`` holds, whatever their case, in order."""
    told = keywords.select(F.trim(F.lower("keyword")).alias("alias")).filter("alias <> ''").distinct()
    seen = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("alias")), F.lit(0)).alias("size")).first()  # one row
    found = Aliases(told, Tables(df.sparkSession, "keywords"), seen["n"], seen["size"]).all(F.lower(F.col(f"`{column}`")))
    return _with(df, out, F.coalesce(found, F.array().cast("array<string>")))


def or_raw(x: Column, dictionary: Dictionary) -> Column:
    """struct(value, recognised): the class, or the raw value where there is none; a missing value is empty."""
    found = classify(x, dictionary)
    return F.struct(F.coalesce(found, x, F.lit("")).alias("value"), found.isNotNull().alias("recognised"))


def aliases_of(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """``alias, key`` as a table, to be checked for duplicates or joined."""
    return spark.createDataFrame([(a, k) for k, aliases in dictionary.items() for a in aliases], "alias string, key string")


def duplicate_aliases(aliases: DataFrame) -> DataFrame:
    """``alias, n_keys`` of aliases that stand for more than one key."""
    return aliases.groupBy("alias").agg(F.countDistinct("key").alias("n_keys")).filter("n_keys > 1")
