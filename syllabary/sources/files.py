"""Files of the catalogue: CSV with checked headers, records of one YAML or JSON document each, folders by key."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyarrow import ArrowException, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.functions.text import clean, local_part
from syllabary.operators.ranks import numbered_lines
from syllabary.sources.schemas import TEACHING
from syllabary.sources.shared import Tables, shared_folder

#: Files of records that one task reads, and bytes of them that it holds at a time.
FILES, HELD = 10_000, 8 << 20


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], line: str | None = None) -> DataFrame:
    """A CSV with a header as strings; an error that lists the columns it lacks; ``line``: with each row's number (the header is 1)."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if line:
        df = numbered_lines(df, first=2, out=line)
        columns = (line, *columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df.select(*columns)


def read_column(spark: SparkSession, path: str, column: str, limit: int | None = None) -> DataFrame:
    """``line, value``: the values of a CSV's column that are not blank, trimmed, with the numbers of their rows (the header is 1).

    ``limit`` counts values that are not blank (0: none); an error if the column is not there.
    """
    df = spark.read.csv(path, header=True, escape='"')
    if column not in df.columns:
        raise ValueError(f"missing column: {column}")
    rows = numbered_lines(df, first=2).select("line", F.trim(F.col(f"`{column}`")).alias("value")).filter("value <> ''")
    return rows if limit is None else rows.orderBy("line").limit(limit)


def filled_values(rows: DataFrame, column: str, order: list[str], limit: int | None = None) -> DataFrame:
    """The values of a column that are not blank, trimmed, in order, ``limit`` of them at most (0: none)."""
    values = rows.select(*order, F.trim(column).alias("value")).filter("value <> ''")
    return values if limit is None else values.orderBy(*order).limit(limit)


def head(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows; all of them where the limit is 0 or less."""
    return rows if limit <= 0 else rows.orderBy(*order).limit(limit)


def _decoder():
    """A function of a YAML text: (JSON, error)."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    class Plain(loader):
        """Scalars stay strings, so no id turns into a number; fields are cast by the schema."""

    Plain.yaml_implicit_resolvers = {k: [x for x in v if x[0] == "tag:yaml.org,2002:null"] for k, v in loader.yaml_implicit_resolvers.items()}

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return json.dumps(yaml.load(text or "", Loader=Plain) or {}, ensure_ascii=False), None
        except yaml.YAMLError as error:
            return None, str(error).splitlines()[0]

    return one


def _decode(batches):
    """(path, JSON, error) of (path, YAML) rows."""
    one = _decoder()
    for pdf in batches:
        found = [one(x) for x in pdf["value"]]
        yield pd.DataFrame({"path": pdf["path"], "json": [x[0] for x in found], "error": [x[1] for x in found]})


def _visible(name: str) -> bool:
    """Whether Spark's readers see a file or folder of that name."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _below(folder: str, wanted: Callable[[fs.FileInfo], bool]):
    """A task's part of a listing: the wanted entries of folders, whose paths are told from ``folder`` on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for at in pdf["path"]:
                inside = system.get_file_info(fs.FileSelector(f"{base}/{at}".rstrip("/")))
                found = [f"{at}/{x.base_name}".lstrip("/") for x in inside if _visible(x.base_name) and wanted(x)]
                yield from (pd.DataFrame({"path": found[i : i + FILES]}) for i in range(0, len(found), FILES))

    return run


def _decode_files(folder: str):
    """(path, JSON, error) of the files of paths below ``folder``, some of them at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, (system, base) = _decoder(), fs.FileSystem.from_uri(folder)
        for pdf in batches:
            held, size = [], 0
            for at in pdf["path"]:
                with system.open_input_stream(f"{base}/{at}") as file:
                    said = file.read()
                held.append((at, *one(said.decode("utf-8", "replace"))))
                size += len(said)
                if size >= HELD:
                    yield pd.DataFrame(held, columns=["path", "json", "error"], dtype=object)
                    held, size = [], 0
            yield pd.DataFrame(held, columns=["path", "json", "error"], dtype=object)

    return run


def _known_to_arrow(folder: str, pattern: str) -> bool:
    """Whether tasks can list and read the files by themselves."""
    try:
        system, base = fs.FileSystem.from_uri(folder)
        return not re.search(r"[\[\]{}\\]", pattern) and not re.search(r"[*?\[\]{}\\]", folder) and system.get_file_info(base).type == fs.FileType.Directory
    except (ArrowException, OSError, NotImplementedError):
        return False


def _decoded_records(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path`` (from ``folder`` on), ``json, error`` of the files that are records by their places and names.

    Tasks list the folders, level by level, and read the files, so the driver knows none of them. Where the file system is unknown to
    Arrow, or a name is a pattern of Hadoop's, Spark's reader does it, whose list of all files is the driver's.
    """
    kinds = "path string, json string, error string"
    if not _known_to_arrow(folder, pattern):
        whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"^.*{folder.rstrip('/').rsplit('/', 1)[-1]}/", "")
        decoded = whole.select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(_decode, kinds).withColumn("path", path)
        return decoded.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    tables, tasks = Tables(spark, "listed"), 2 * spark.sparkContext.defaultParallelism
    folders = spark.range(1).select(F.lit("").alias("path"))
    for wanted in (lambda x: x.type == fs.FileType.Directory, lambda x: x.type == fs.FileType.Directory and re.fullmatch("[0-9]{4}", x.base_name)):
        folders = folders.mapInPandas(_below(folder, wanted), "path string").repartition(tasks)
    found = tables.keep(folders.mapInPandas(_below(folder, lambda x: x.type == fs.FileType.File and x.size > 0 and fnmatchcase(x.base_name, pattern)), "path string"), "files")
    return found.repartition(max(tasks, -(-found.count() // FILES))).mapInPandas(_decode_files(folder), kinds)


def read_records(spark: SparkSession, folder: str, pattern: str = "teaching-*.yml", schema: T.StructType = TEACHING) -> DataFrame:
    """Records of ``folder/TEACHER/YEAR/pattern``: ``teacher_dir, year_dir, file``, the schema's fields, and ``error``.

    Files elsewhere in the tree are left out. A file is a row; its decoding to JSON runs in Python, its fields are cast by Spark.
    """
    decoded = _decoded_records(spark, folder.rstrip("/"), pattern)
    numbers = [f.name for f in schema if isinstance(f.dataType, T.IntegerType)]
    plain = T.StructType([T.StructField(f.name, T.StringType()) if f.name in numbers else f for f in schema])
    record = decoded.withColumn("parts", F.split("path", "/")).withColumn("r", F.from_json("json", plain))
    record = record.filter((F.size("parts") == 3) & F.col("parts")[1].rlike("^[0-9]{4}$"))
    fields = [F.col(f"r.{f.name}").try_cast("int").alias(f.name) if f.name in numbers else F.col(f"r.{f.name}") for f in schema]
    return record.select(F.col("parts")[0].alias("teacher_dir"), F.col("parts")[1].cast("int").alias("year_dir"), F.col("parts")[2].alias("file"), *fields, "error")


def read_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The entries of YAML documents that are lists, fields of ``schema`` (numbers are cast from text, so no id turns into one), and
    ``error`` for a document that is no list."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    decoded = whole.mapInPandas(_decode, "path string, json string, error string")
    plain = T.StructType([T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.NumericType) else f for f in schema])
    entries = F.when(F.startswith("json", F.lit("[")), F.from_json("json", T.ArrayType(plain)))
    rows = decoded.withColumn("entries", entries).withColumn("error", F.coalesce("error", F.when(F.col("entries").isNull(), "not a list")))
    rows = rows.select(F.explode_outer("entries").alias("r"), "error").filter("r is not null or error is not null")
    return rows.select(*[F.col(f"r.{f.name}").try_cast(f.dataType).alias(f.name) if isinstance(f.dataType, T.NumericType) else F.col(f"r.{f.name}").alias(f.name) for f in schema], "error")


def read_dictionary(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """A dictionary file of ``key: [aliases]``, lower-case and in the file's order; it is a vocabulary, so the driver holds it."""
    rows = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), "value").mapInPandas(_decode, "path string, json string, error string").collect()
    if len(rows) != 1 or rows[0]["error"]:
        raise ValueError(f"{path}: " + (rows[0]["error"] if rows else "no file"))
    found = json.loads(rows[0]["json"])
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a dictionary")
    return {key: tuple(str(a).strip().lower() for a in aliases or ()) for key, aliases in found.items()}


def write_merged(merged: DataFrame, path: str) -> None:
    """Merged courses as JSON lines in a folder for each year, each with the name of its file, which ends with its letter."""
    name = F.concat(F.lit("course-"), "course_id", "suffix", F.lit(".yml"))
    merged.withColumn("file", name).write.mode("overwrite").partitionBy("year").json(path)


def teaching_path(email, year, teaching_id):
    """Where a teaching's record goes: folder of the e-mail's local part, year, file."""
    return F.concat_ws("/", local_part(clean(email)), year.cast("string"), F.concat(F.lit("teaching-"), teaching_id, F.lit(".yml")))


def write_folders(rows: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Write one folder for each key and read the layout back; rows of a key may come from many tasks, so no key needs one."""
    spark = rows.sparkSession
    path = path or f"{shared_folder(spark)}/folders-{uuid.uuid4().hex}"
    rows.write.partitionBy(*keys).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def write_records(rows: DataFrame, path: str) -> None:
    """Records as JSON lines without null fields, a folder for each teacher and year."""
    rows.write.mode("overwrite").partitionBy("teacher_dir", "year").json(path)


def merged_documents(merged: DataFrame) -> DataFrame:
    """Merged courses with the path of each one's document, ``.files/YEAR/course-ID-LETTER.yml``, for ``documents.write_documents``."""
    path = F.concat(F.lit(".files/"), F.col("year").cast("string"), F.lit("/course-"), "course_id", "suffix", F.lit(".yml"))
    return merged.select(path.alias("document_path"), *[c for c in merged.columns if c not in ("signature", "suffix", "files")])


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    """A CSV with a header: a new one, or rows after those that are there."""
    rows.write.mode("append" if append else "overwrite").csv(path, header=True, escape='"')
