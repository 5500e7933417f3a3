"""Records as documents: a file for each record, by a Spark data source whose tasks commit together.

Every row becomes one document (JSON, which is YAML too; fields in the schema's order, null ones left out; or, where the records have
a field ``document_text``, that text) at the path that its ``document_path`` names below a folder. It goes in two steps. Tasks write into folders of their attempts; as a task ends it tells
its folder, and when all have ended the driver writes the list of folders, a row a task. Then a Spark job moves each folder's files
to their places, so neither documents nor their names pass the driver. A job that fails in the first step leaves nothing; one that
fails in the second is done again from its list by ``place_documents``, which passes over what has been moved.

Folders may be of any file system that Arrow knows and all executors reach. Of the documents that are there, those of the same
paths are replaced and others stay. Rows without a path, or of one path, are an error before anything is written.
"""

from __future__ import annotations

import datetime
import decimal
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: The column that names a record's file, and the one that holds its text as it is to be written, if there is one.
PATH, TEXT = "document_path", "document_text"
#: Documents that a task writes, about, where there are more.
DOCUMENTS = 10_000


def plain(value):
    """A value without null fields, in types that JSON has; empty texts, lists and maps are values."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value) if isinstance(value, (decimal.Decimal, bytes)) else value


@dataclass
class Ended(WriterCommitMessage):
    """The folder of one task that has ended, and the number of its documents."""

    folder: str
    documents: int


def _drop(attempts: str) -> None:
    """Delete the folder of the attempts while tasks may still write there: under another name, where they don't find it."""
    system, base = fs.FileSystem.from_uri(attempts)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return
    gone = f"{base}-gone"
    try:
        system.move(base, gone)
    except (OSError, NotImplementedError):  # no file system for this; then where it is
        gone = base
    for left in reversed(range(20)):
        try:
            return system.delete_dir(gone)
        except OSError:  # a file came in between
            if not left:
                raise
            time.sleep(0.1)


class _Writer(DataSourceWriter):
    def __init__(self, attempts: str):
        self.attempts = attempts

    def write(self, rows: Iterator[Row]) -> Ended:
        system, base = fs.FileSystem.from_uri(self.attempts)
        folder, number, made = f"{base}/{uuid.uuid4().hex}", 0, set()
        for row in rows:
            fields = row.asDict()
            at = f"{folder}/{fields.pop(PATH)}"
            # Level by level, so that a task which is still at work when its job has been aborted can't bring the attempts back.
            for level in accumulate([folder, *at.removeprefix(f"{folder}/").split("/")[:-1]], "{}/{}".format):
                if level not in made:
                    system.create_dir(level, recursive=False)
                    made.add(level)
            with system.open_output_stream(at) as out:
                said = (fields[TEXT] or "") if TEXT in fields else json.dumps(plain(fields), ensure_ascii=False) + "\n"
                out.write(said.encode())
            number += 1
        return Ended(folder, number)

    def commit(self, messages: list[Ended | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.attempts)
        system.create_dir(base)
        with system.open_output_stream(f"{base}/ended.json") as out:
            out.write("".join(json.dumps({"folder": m.folder, "documents": m.documents}) + "\n" for m in messages if m and m.documents).encode())

    def abort(self, messages: list[Ended | None]) -> None:
        _drop(self.attempts)


class Documents(DataSource):
    """``format("documents")``: option ``attempts`` names the folder of the attempts."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["attempts"])


def place_documents(spark: SparkSession, attempts: str, target: str) -> None:
    """Move the documents of the ended tasks below ``attempts`` to their places below ``target``, and drop the attempts."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(target)
        for pdf in batches:
            for folder in pdf["folder"]:
                todo = [folder]
                while todo:  # folder by folder, so that no task lists all of its documents at once
                    inside = system.get_file_info(fs.FileSelector(here := todo.pop(), allow_not_found=True))
                    todo += [x.path for x in inside if x.type == fs.FileType.Directory]
                    moving, at = [x for x in inside if x.type == fs.FileType.File], base + here.removeprefix(folder)
                    if moving:
                        system.create_dir(at)
                    for one in moving:
                        system.move(one.path, f"{at}/{one.base_name}")
            yield pd.DataFrame({"moved": [len(pdf)]})

    ended = spark.read.schema("folder string, documents long").json(f"{attempts}/ended.json")
    ended.repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(move, "moved long").agg(F.sum("moved")).collect()
    system, base = fs.FileSystem.from_uri(attempts)
    system.delete_dir(base)


def write_documents(rows: DataFrame, target: str) -> None:
    """Write each row as a document below ``target``."""
    spark, target = rows.sparkSession, target.rstrip("/")
    sound = F.col(PATH).isNotNull() & (F.col(PATH) != "") & ~F.col(PATH).rlike(r"^/|(^|/)\.\.(/|$)|/$")
    paths = rows.groupBy(PATH).agg(F.count("*").alias("n"), F.max(~sound).alias("wrong"))
    seen = paths.agg(F.sum("n").alias("n"), F.min(F.when((F.col("n") > 1) | F.col("wrong"), F.struct(PATH))).alias("wrong")).first()  # one row
    if seen["wrong"]:
        raise ValueError(f"{seen['wrong'][PATH]!r} is no path of one document below the folder")
    if (seen["n"] or 0) > DOCUMENTS:
        rows = rows.repartition(-(-seen["n"] // DOCUMENTS))
    spark.dataSource.register(Documents)
    attempts = f"{target if '://' in target else 'file://' + target}.attempts-{uuid.uuid4().hex}"
    system, base = fs.FileSystem.from_uri(attempts)
    system.create_dir(base)  # tasks write below it as long as it is there
    try:
        rows.write.format("documents").option("attempts", attempts).mode("append").save()
    except Exception:
        _drop(attempts)
        raise
    place_documents(spark, attempts, target)
