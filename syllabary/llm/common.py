"""What the operators share: tables by name, scratch tables in the shared folder, and column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of the Arrow batches between Spark and its Python workers, and of texts that a worker looks at together: both sides of
#: the pipe hold a batch outside the heap, and array operations need about forty times the bytes they look at.
BATCH, TOGETHER = 8 << 20, 1 << 20
#: A key is hot with more than one in ``HOT`` of all rows, so there are at most so many hot keys; each is dealt over ``SALTS`` tasks.
HOT, SALTS = 2000, 64

_own_folder: list[str] = []


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, read by Spark alone."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder of this process on a local master, as in
    tests, and an error on a cluster, whose machines share no such folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_own_folder[0]}"


class Scratch:
    """Tables of one run of one operator, in the shared folder: lineage ends there and a lost executor costs no rework."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        bound = "spark.sql.execution.arrow.maxBytesPerBatch"
        if int(spark.conf.get(bound).rstrip("b")) > BATCH:
            spark.conf.set(bound, f"{BATCH}b")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def together(batch: pa.RecordBatch, *texts: int, most: int = TOGETHER, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes in the columns numbered ``texts``, or one longer row, and ``rows`` rows."""
    if not len(batch):
        return
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(k)), 0)).astype(np.int64) for k in texts)
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        before = int(ends[start - 1]) if start else 0
        stop = min(max(int(np.searchsorted(ends, before + most, side="right")), start + 1), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def hot_keys(counted: DataFrame, key: str, rows: int) -> DataFrame:
    """The keys of ``counted`` (a row a key, with ``n`` rows of ``rows`` in all) that are hot: ``HOT`` at most, so they are broadcast."""
    return F.broadcast(counted.filter(F.col("n") > F.lit(rows) / HOT).select(F.col(key).alias("hot_key")).distinct())


def salted_join(many: DataFrame, one: DataFrame, on: list[str], key: str, hot: DataFrame, deal: list[str]) -> DataFrame:
    """``many`` with the row of ``one`` that has its ``on``. Rows of a hot ``key`` are dealt by ``deal`` over many tasks, to each of
    which its row of ``one`` is copied; others meet under one salt. A sort-merge join at every size."""
    left = many.join(hot, F.col(key) == F.col("hot_key"), "left")
    left = left.withColumn("salt", F.when(F.col("hot_key").isNull(), 0).otherwise(F.pmod(F.xxhash64(*deal), F.lit(SALTS)).cast("int"))).drop("hot_key")
    salts = F.when(F.col("hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = one.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("salt", F.explode(salts)).drop("hot_key")
    return left.hint("merge").join(right, [*on, "salt"]).drop("salt")
