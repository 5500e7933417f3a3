"""Places in a total order, and numbers of lines, without a window over everything.

Rows are dealt into ranges of the order and written, each with the number of its range and its place there. As many counts as there
are ranges are summed up from the left, and a row's place is the sum before its range and its place in it.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syllabary.sources.shared import Tables

#: What ``monotonically_increasing_id`` gives are places within a partition, and the partition from this bit on.
_PLACE = (1 << 33) - 1


def global_rank(rows: DataFrame, order: list[tuple[str, bool]], out: str = "place", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``out``: 1, 2, ... in the order of columns, each (name, whether it falls), that should tell all rows apart (of
    those it doesn't, any is first). Nulls are last.

    Ranges are written before they are counted, since Spark draws them anew each time that a plan runs.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"carried_{i}" for i in range(len(rows.columns))]
    carried = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rows.columns, names, strict=True)])
    by = [(F.col(names[rows.columns.index(c)]), falls) for c, falls in order]
    by = [c.desc_nulls_last() if falls else c.asc_nulls_last() for c, falls in by]
    numbered = carried.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id())
    parts = F.shiftright("id", 33).cast("int").alias("range"), F.col("id").bitwiseAND(F.lit(_PLACE)).alias("at")
    written = Tables(spark, "ranks").keep(numbered.select(*names, *parts), "ranges")
    counts = sorted((r["range"], r["n"]) for r in written.groupBy("range").agg(F.count("*").alias("n")).collect())  # a row a range
    before = accumulate((c for _, c in counts), initial=0)
    starts = spark.createDataFrame([(k, b) for (k, _), b in zip(counts, before, strict=False)], "range int, before long")
    placed = written.join(F.broadcast(starts), "range")
    return placed.select(*[F.col(k).alias(c) for c, k in zip(rows.columns, names, strict=True) if c != out], (F.col("before") + F.col("at") + 1).alias(out))


def numbered_lines(rows: DataFrame, first: int = 1, out: str = "line") -> DataFrame:
    """Rows as they are read from files (``spark.read``) with ``out``: the number of each in its file, from ``first`` on.

    Each split of a file counts its rows; the sums of the splits before it are added. What is read twice is read in the same splits,
    as those follow from the files and the settings alone.
    """
    meta = rows.select("*", F.col("_metadata.file_path").alias("line_file"), F.col("_metadata.file_block_start").alias("line_split"), F.monotonically_increasing_id().alias("line_id"))
    splits = meta.groupBy("line_file", "line_split").agg(F.count("*").alias("n"), F.min("line_id").alias("least"))
    earlier = Window.partitionBy("line_file").orderBy("line_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("line_file", "line_split", "least", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    met = meta.join(starts, ["line_file", "line_split"])
    return met.withColumn(out, F.col("before") + F.col("line_id") - F.col("least") + first).drop("line_file", "line_split", "line_id", "least", "before")
