"""Tables that one job writes for its next steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of this process on a local master, as in tests, and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_own[0]}"


class Tables:
    """Written steps of one job: lineage ends at each, so a lost executor costs its own tasks and nothing is computed twice."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df``, in folders ``by`` some columns, and return what is written."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
