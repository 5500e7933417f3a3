"""Change sets: what has to be done to the files and links that are there so that they become those that are wanted.

One full outer join by path. A link or file that is there as it is wanted is kept, another is replaced, one that is no longer wanted
is deleted, and a folder where a link or file is wanted is in the way: a conflict, which is told and changes nothing. Doing the
changes and asking again gives nothing but what is kept and what is in the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("create", "replace", "keep", "delete", "conflict")


def change_set(there: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path, action, target, was``: ``there`` has ``path, kind`` (link, file or folder) and ``target``; ``wanted`` links have ``path, target``.

    Folders that nothing is wanted for are no part of it. A path that is wanted twice with different targets is a conflict.
    """
    one = wanted.filter("path is not null").groupBy("path").agg(F.min("target").alias("target"), (F.count_distinct(F.coalesce("target", F.lit(""))) > 1).alias("torn"), F.lit(True).alias("named"))
    old = there.select(F.col("path").alias("old_path"), "kind", F.col("target").alias("was"))
    rows = one.join(old, F.col("path") == F.col("old_path"), "full_outer")
    action = (
        F.when(F.col("named") & (F.col("torn") | (F.coalesce("kind", F.lit("")) == "folder")), "conflict")
        .when(F.col("named") & F.col("old_path").isNull(), "create")
        .when(F.col("named"), F.when((F.col("kind") == "link") & F.col("was").eqNullSafe(F.col("target")), "keep").otherwise("replace"))
        .when(F.col("kind") != "folder", "delete")
    )
    told = rows.select(F.coalesce("path", "old_path").alias("path"), action.alias("action"), F.when(F.col("named"), F.col("target")).alias("target"), "was")
    return told.filter("action is not null")


def applied(there: DataFrame, changes: DataFrame) -> DataFrame:
    """``path, kind, target`` after the changes."""
    done = changes.filter(F.col("action").isin("create", "replace")).select("path", F.lit("link").alias("kind"), "target")
    gone = changes.filter(F.col("action").isin("create", "replace", "delete")).select("path")
    return there.select("path", "kind", "target").join(gone, "path", "left_anti").unionByName(done)
