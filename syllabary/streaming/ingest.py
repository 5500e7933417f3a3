"""Streaming intake: new teaching records are folded into merged courses as they come.

The reader is a file stream over JSON lines of ``schemas.TEACHING``. A record is known by its folder, year and file; sent again it
replaces its older version, also where its course has changed: the course that it leaves is merged again without it. Of versions in
one batch the one of the largest hash counts. Below the table's folder lie

* ``records/batch=N/slot=S``: the versions of each batch, by a hash of their course, and a mark in the old course's slot for a record
  that left it;
* ``places/batch=N/slot=S``: which course each record of the batch belongs to, by a hash of the record;
* ``touched/batch=N`` and ``merged/batch=N``: the courses that the batch touched, and those of them that still have records.

A batch reads the slots that it touches and no others, so it costs what it brings; a repeated batch writes the same folders again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from syllabary.operators.merge import merge_courses
from syllabary.sources.schemas import TEACHING

RECORD = T.StructType([T.StructField("teacher_dir", T.StringType()), T.StructField("file", T.StringType()), *TEACHING.fields])
#: Slots of the tables; the list of those that a batch touches reaches the driver.
SLOTS = 256
_KEY = ["teacher_dir", "year", "file"]
_COURSE = ["course_year", "course_id"]
_LAID = T.StructType([T.StructField("left", T.BooleanType()), T.StructField("course_year", T.IntegerType()), T.StructField("course_id", T.StringType())])


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records as they arrive as JSON lines."""
    return spark.readStream.schema(RECORD).json(folder)


def _slot(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(SLOTS)).cast("int")


def _numbered(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField("batch", T.LongType()), T.StructField("slot", T.IntegerType())])


def _before(spark: SparkSession, path: str, schema: T.StructType, number: int, slots: DataFrame) -> DataFrame:
    """Rows of earlier batches in the given slots, by partition pruning."""
    wanted = [r["slot"] for r in slots.select("slot").distinct().collect()]  # SLOTS rows at most
    try:
        rows = spark.read.schema(_numbered(schema)).option("basePath", path).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], _numbered(schema))
    return rows.filter((F.col("batch") < number) & F.col("slot").isin(wanted))


def fold(batch: DataFrame, number: int, table: str) -> None:
    """Fold one batch of records into ``table``."""
    spark = batch.sparkSession
    laid = T.StructType([*RECORD, *_LAID])
    places = T.StructType([f for f in laid if f.name in (*_KEY, *_COURSE)])
    best = Window.partitionBy(*_KEY).orderBy(F.xxhash64(F.to_json(F.struct("*"))).desc())
    rows = batch.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")
    rows = rows.withColumn("left", F.lit(False)).withColumn("course_year", F.col("year")).withColumn("course_id", F.coalesce("course_title.id", F.lit("")))
    own = rows.select(*_KEY, *_COURSE).withColumn("slot", _slot(*_KEY))
    own.write.mode("overwrite").partitionBy("slot").parquet(f"{table}/places/batch={number}")
    own = spark.read.schema(T.StructType([*places, T.StructField("slot", T.IntegerType())])).parquet(f"{table}/places/batch={number}")
    # Where the batch's records were last, if elsewhere: there they leave a mark.
    earlier = _before(spark, f"{table}/places", places, number, own)
    last = earlier.join(own.select(*[F.col(c).alias(f"own_{c}") for c in (*_KEY, *_COURSE)]), [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in _KEY])
    last = last.groupBy(*_KEY, *[f"own_{c}" for c in _COURSE]).agg(*[F.max_by(c, "batch").alias(c) for c in _COURSE])
    moved = last.filter(~(F.col("course_id").eqNullSafe(F.col("own_course_id")) & F.col("course_year").eqNullSafe(F.col("own_course_year"))))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD if f.name not in _KEY]
    marks = moved.select(*_KEY, *rest, F.lit(True).alias("left"), *_COURSE)
    versions = rows.select(*laid.names).unionByName(marks.select(*laid.names)).withColumn("slot", _slot(*_COURSE))
    versions.write.mode("overwrite").partitionBy("slot").parquet(f"{table}/records/batch={number}")
    versions = spark.read.schema(T.StructType([*laid, T.StructField("slot", T.IntegerType())])).parquet(f"{table}/records/batch={number}")
    touched = versions.filter("course_id <> ''").select(*_COURSE, "slot").distinct()
    touched.select(*_COURSE).write.mode("overwrite").parquet(f"{table}/touched/batch={number}")
    every = _before(spark, f"{table}/records", laid, number, touched).unionByName(versions.withColumn("batch", F.lit(number).cast("long")))
    again = every.join(touched.select(*[F.col(c).alias(f"t_{c}") for c in _COURSE]), [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in _COURSE], "left_semi")
    latest_first = Window.partitionBy(*_KEY, *_COURSE).orderBy(F.desc("batch"))
    current = again.withColumn("place", F.row_number().over(latest_first)).filter("place = 1 and not left").select(*RECORD.names)
    merge_courses(current).write.mode("overwrite").parquet(f"{table}/merged/batch={number}")


def merge_stream(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` up to date with a stream of records; ``latest`` reads it."""
    return records.writeStream.foreachBatch(lambda batch, number: fold(batch, number, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The merged courses: of each (year, course) the groups of the last batch that touched it."""
    last = spark.read.parquet(f"{table}/touched").groupBy(*_COURSE).agg(F.max("batch").alias("last_batch"))
    rows = spark.read.parquet(f"{table}/merged")
    on = (F.col("year").eqNullSafe(F.col("course_year"))) & (rows["course_id"] == last["course_id"]) & (F.col("batch") == F.col("last_batch"))
    return rows.join(last, on, "left_semi").drop("batch")
