"""Documents, one a record: written, read back, failures."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from syllabary.sources import documents, files
from syllabary.sources.schemas import TEACHING
from tests.test_merge_and_files import teaching


def test_documents_are_read_back(spark, tmp_path):
    rows = [teaching(f"t{i % 3}", str(i), credits=None if i % 4 == 0 else i, schedule={"from": "2025-02-01", "to": "2025-03-01"} if i % 2 else None) for i in range(20)]
    read = spark.read.schema(TEACHING).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 3))
    named = read.withColumn(documents.PATH, F.concat(F.col("teacher.id"), F.lit("/2025/teaching-"), F.regexp_extract("url", "([0-9]+)$", 1), F.lit(".yml")))
    target = str(tmp_path / "courses")
    for _ in range(2):  # written again they are replaced
        documents.write_documents(named, target)
        back = files.read_records(spark, target)
        key = lambda r: json.dumps(r.asDict(True), default=str, sort_keys=True)
        assert sorted(map(key, back.select(*TEACHING.names).collect())) == sorted(map(key, read.collect())) and back.filter("error is not null").count() == 0
    assert len(list((tmp_path / "courses").rglob("*.yml"))) == 20 and [p.name for p in tmp_path.iterdir()] == ["courses"]
    text = (tmp_path / "courses" / "t0" / "2025" / "teaching-0.yml").read_text()
    assert "credits" not in json.loads(text) and json.loads(text)["integrated_course"] == "" and list(json.loads(text))[0] == "year"


def test_failed_jobs_leave_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    df = spark.createDataFrame([(f"d/{i}.json", i) for i in range(8)], "document_path string, i int")
    documents.write_documents(df, target)
    broken = df.repartition(4).withColumn("i", F.when(F.col("i") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("i") + 100))
    with pytest.raises(Exception, match="no"):
        documents.write_documents(broken, target)
    assert {json.loads(p.read_text())["i"] for p in (tmp_path / "out").rglob("*.json")} == set(range(8))
    for wrong in ([("a", 1), ("a", 2)], [("../a", 1)], [("/a", 1)], [(None, 1)], [("a/", 1)]):
        with pytest.raises(ValueError, match="no path"):
            documents.write_documents(spark.createDataFrame(wrong, df.schema), target)
    documents.write_documents(df.limit(0), target)
    assert len(list((tmp_path / "out").rglob("*.json"))) == 8 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_late_tasks_leave_nothing(tmp_path):
    """A task that is still at work when its job is aborted."""
    (tmp_path / "a").mkdir()
    writer = documents._Writer(f"file://{tmp_path}/a")

    def rows():
        yield Row(document_path="d/e/1.json", i=1)
        assert [p.name for p in tmp_path.rglob("*.json")] == ["1.json"]
        writer.abort([])
        yield Row(document_path="d/f/2.json", i=2)

    with pytest.raises(OSError):
        writer.write(rows())
    assert not list(tmp_path.iterdir())


def test_moving_is_taken_up_again(spark, tmp_path):
    attempts, target = tmp_path / "a", tmp_path / "t"
    (attempts / "task" / "x").mkdir(parents=True)
    (attempts / "task" / "x" / "1").write_text("{}")
    (attempts / "dead").mkdir()
    (attempts / "dead" / "2").write_text("{}")
    (attempts / "ended.json").write_text(json.dumps({"folder": str(attempts / "task"), "documents": 2}) + "\n" + json.dumps({"folder": str(attempts / "gone"), "documents": 1}) + "\n")
    documents.place_documents(spark, f"file://{attempts}", f"file://{target}")
    assert [str(p.relative_to(target)) for p in target.rglob("*") if p.is_file()] == ["x/1"] and not attempts.exists()


def test_tasks_list_and_read_records(spark, tmp_path):
    """The driver has no list of the files; what Spark's reader passes over is passed over."""
    texts = {f"a+b c/{y}/teaching-{i} x.yml": f"credits: {i}" for y in (2024, 2025) for i in range(40)} | {"é/2024/teaching-é.yml": "year: [\n: x", "é/2024/teaching-1.yml": "\n"}
    passed = ("é/2024/teaching-0.yml", "é/2024/course-1.yml", "é/20245/teaching-1.yml", "é/2024/deep/teaching-1.yml", "_é/2024/teaching-1.yml", ".é/2024/teaching-1.yml", "é/2024/_teaching-1.yml", "é/teaching-1.yml")
    for name, said in (texts | dict.fromkeys(passed, "credits: 1") | {passed[0]: ""}).items():
        (tmp_path / "courses" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "courses" / name).write_text(said)
    told = {f"{r['teacher_dir']}/{r['year_dir']}/{r['file']}": (r["credits"], r["error"] is not None) for r in files.read_records(spark, str(tmp_path / "courses")).collect()}
    assert told == {n: (int(s[9:]) if s.startswith("credits") else None, "[" in s) for n, s in texts.items()}
    assert not [f for f in files.read_records(spark, str(tmp_path / "courses")).inputFiles() if f.endswith(".yml")]
    by_spark = files.read_records(spark, f"file://{tmp_path}/courses/", "teaching-[0-9]*.yml")
    assert {f"{r['teacher_dir']}/{r['year_dir']}/{r['file']}" for r in by_spark.collect()} == set(texts) - {"é/2024/teaching-é.yml"}
    (tmp_path / "none").mkdir()
    assert files.read_records(spark, str(tmp_path / "none")).count() == 0


def test_many_documents_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "DOCUMENTS", 7)
    wrote = []
    place = documents.place_documents
    monkeypatch.setattr(documents, "place_documents", lambda spark, attempts, target: (wrote.extend(Path(attempts.removeprefix("file://"), "ended.json").read_text().splitlines()), place(spark, attempts, target)))
    documents.write_documents(spark.range(0, 50, 1, 1).select(F.concat(F.lit("d/"), F.col("id") % 3, F.lit("/"), "id").alias(documents.PATH), "id"), str(tmp_path / "out"))
    assert sorted(int(p.name) for p in (tmp_path / "out").rglob("*") if p.is_file()) == list(range(50)) and len(wrote) > 4
