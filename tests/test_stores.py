"""Stored tables and files: what is left after failures, repeats and concurrent use."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quillwork.sources import intake as I
from quillwork.sources.cache_table import CacheTable, UpsertConflict
from quillwork.sources.document_files import list_document_files, read_document_files, write_document_files
from quillwork.sources.workbooks import sheets_of, workbook_of
from quillwork.streaming import jobs as J
from quillwork.streaming import sinks as K

DOCUMENTS = "output_name string, content string"


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def contents(path):
    return {n: open(f"{path}/{n}", encoding="utf-8", newline="").read() for n in sorted(os.listdir(path)) if not n.startswith(".")}


def test_one_file_a_document(spark):
    path = folder()
    rows = [(f"n{i}_20240601_120000.md", f"text {i}\nü") for i in range(300)]
    write_document_files(spark.createDataFrame(rows, DOCUMENTS), path, parts=5)
    assert contents(path) == dict(rows)


def test_awkward_documents(spark):
    path = folder()
    rows = [("a.md", "2"), ("a.md", "1"), ("a.md", "2"), (None, None), ("", "x"), ("../up/b.md", "b"), ("_hidden.md", "h"), ("no suffix", "n"), ("long.md", "word " * 200_000)]
    write_document_files(spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 as k", "'z' as name"), path)
    got = contents(path)
    assert got.pop("long.md") == "word " * 200_000
    assert got == {"a.md": "1", "a~2.md": "2", "a~3.md": "2", "document.md": "", "document~2.md": "x", "_._up_b.md": "b", "_hidden.md": "h", "no suffix": "n"}
    write_document_files(spark.createDataFrame([], DOCUMENTS), folder())


def test_a_failed_job_leaves_no_file(spark):
    path = folder()
    write_document_files(spark.createDataFrame([("kept.md", "before")], DOCUMENTS), path)
    # the name of a folder that does not exist cannot be moved to: its task fails after others have finished
    bad = spark.range(200).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.when(F.col("id") == 199, "x" * 300).otherwise(""), F.lit(".md")).alias("output_name"), F.lit("text").alias("content"))
    with pytest.raises(Exception, match="too long|File name"):
        write_document_files(bad.coalesce(4), path, parts=4)
    assert contents(path) == {"kept.md": "before"}


def test_workbooks_round_trip():
    sheets = [("One & <two>", [["a", "", "c"], [], ["", "x\ny", "é"], ["v"] * 30]), ("Empty", [])]
    assert [(n, [r for r in rows]) for n, rows in sheets_of(workbook_of(sheets))] == sheets


def test_intake_of_awkward_files(spark):
    path = folder()
    files = {
        "plan_notes-1.TXT": b"text", "empty.md": b"", "bad.md": b"\xc3\x28", "crlf.csv": b'a,b\r\n1,"x, ""y"""\r\n\r\n,2\r\n', "wide.csv": b"a\n1,2,\n", "head.csv": b"a,b", "open.csv": b'a\n"x\n', "none.csv": b"", "blank.csv": b"\n\n",
        "two words.txt": b"t", "p%20q.md": b"percent", "a.pdf": b"%PDF-1.7 /Type /Page /Type/Page\xff /Type /Pages", "b.PDF": b"", "x.exe": b"MZ", "noname": b"?", "b.xlsx": workbook_of([("S", [["h"], ["1"]])]), "c.XLSX": b"PK", "d.xls": b"",
        "long.csv": b"a,b\n" + b'"' + b"z" * 300_000 + b'",1\n',
    }
    for name, data in files.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
    asked = spark.createDataFrame([(n,) for n in [*files, "empty.md", "lost.csv", None]], "name string").selectExpr("*", "1 as size", "2 as kind")
    rows = I.intake(asked, path).collect()
    assert len(rows) == len(files) + 3
    got = {r.name: r for r in rows}
    assert got["plan_notes-1.TXT"].content == "# Plan Notes 1\n\ntext" and got["two words.txt"].success and got["p%20q.md"].content == "percent"
    assert got["empty.md"].success and got["empty.md"].content == "" and got["empty.md"].size == 0
    assert got["crlf.csv"].content == '- **Row 1**\n  - **a**: 1\n  - **b**: x, "y"\n- **Row 2**\n  - **b**: 2'
    assert got["wide.csv"].content == "- **Row 1**\n  - **a**: 1\n  - **Value 2**: 2" and got["head.csv"].content == ""
    assert got["a.pdf"].parts == 2 and got["a.pdf"].success and got["b.xlsx"].content == "## Sheet: S\n\n- **Row 1**\n  - **h**: 1"
    assert len(got["long.csv"].content) > 300_000
    failed = {n: r.error for n, r in got.items() if not r.success}
    assert failed == {
        "bad.md": "Invalid UTF-8", "open.csv": "Open quote in line 2", "none.csv": I.EMPTY_TABLE, "blank.csv": I.EMPTY_TABLE, "b.PDF": "Invalid paged file", "x.exe": "Unsupported file type: exe", "noname": "Unsupported file type: ",
        "c.XLSX": "Invalid workbook: BadZipFile", "d.xls": "Invalid workbook: BadZipFile", "lost.csv": "File not found: lost.csv", None: "File not found: ",
    }
    assert all(got[n].content is None and got[n].parts == 0 for n in failed)


def test_the_driver_holds_no_path_of_an_intake(spark):
    """Files are opened by the tasks that are given their names, each once, wherever they were dealt to."""
    path, flat = folder(), folder()
    rows = [(f"note_{i}.md", f"text {i}") for i in range(60)] + [("x.csv", "a\n1"), ("x.csv", "again")]
    for to, folders in ((path, 7), (flat, 1)):
        write_document_files(spark.createDataFrame(rows, DOCUMENTS), to, folders=folders)
        asked = spark.createDataFrame([(n,) for n, _ in rows] + [("note_1.md",), ("../note_1.md",), ("lost" * 100,), ("nul\0.md",), (".hidden.md",)], "name string")
        got = I.intake(asked, to, folders)
        assert got.inputFiles() == []
        got = got.collect()
        assert len(got) == 67 and sum(r.success for r in got) == 63 and {r.content for r in got if r.name == "note_1.md"} == {"text 1"}
        assert {r.name for r in I.read_files(spark, to, folders).collect()} == {n for n, _ in rows} | {"x~2.csv"}
        back = read_document_files(list_document_files(spark, to, folders), to, folders).collect()
        assert {r.output_name: bytes(r.content).decode() for r in back} == dict(rows[:60]) | {"x.csv": "a\n1", "x~2.csv": "again"}
    assert len(os.listdir(path)) == 7


def test_documents_are_read_back_by_tasks_without_their_paths_on_the_driver(spark):
    from quillwork.plans.queries import QUERIES

    from .conftest import SF

    got = QUERIES["write_markdown"](spark, SF)
    assert got.inputFiles() == [] and got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def entries(spark, rows):
    return spark.createDataFrame([(k, p, dt.datetime(2024, 6, 1, h)) for k, p, h in rows], "key string, payload string, written_at timestamp")


def test_cache_keeps_the_newest_and_readers_one_version(spark):
    cache = CacheTable(spark, folder(), buckets=4)
    assert cache.read().count() == 0 and cache.upsert(entries(spark, [])) == 0
    assert cache.upsert(entries(spark, [(f"k{i}", "old", 5) for i in range(40)] + [(None, "no key", 5)])) == 1
    before = cache.read()
    assert cache.upsert(entries(spark, [("k1", "new", 7), ("k1", "newer", 8), ("k2", "older", 1), ("k3", "same time", 5)])) == 2
    now = {r.key: r.payload for r in cache.read().collect()}
    assert now == {f"k{i}": "old" for i in range(40)} | {"k1": "newer", "k3": "same time"}
    assert {r.payload for r in before.collect()} == {"old"} and {r.payload for r in cache.read(1).collect()} == {"old"}
    old, new = cache._manifest(1)["folders"], cache._manifest(2)["folders"]
    touched = {b for b in new if new[b] != old.get(b)}
    assert 0 < len(touched) <= 3 < len(new)
    pages = spark.createDataFrame([("k1",), ("k9",), ("k99",), (None,)], "key string")
    assert {r.key: (r.payload, r.hit) for r in cache.lookup(pages, "2024-06-02 07:00:00", 86_400).collect()} == {"k1": ("newer", True), "k9": (None, False), "k99": (None, False), None: (None, False)}
    assert {r.key: r.hit for r in cache.lookup(pages, "2024-06-01 23:00:00", 86_400).collect()}["k9"]


def test_cache_upserts_conflict_and_leave_the_version(spark, monkeypatch):
    cache = CacheTable(spark, folder(), buckets=2)
    cache.upsert(entries(spark, [("a", "1", 1)]))
    other = CacheTable(spark, cache.root, buckets=2)
    publish = cache._publish

    def late(manifest):
        other.upsert(entries(spark, [("b", "2", 2)]))
        publish(manifest)

    monkeypatch.setattr(cache, "_publish", late)
    with pytest.raises(UpsertConflict):
        cache.upsert(entries(spark, [("a", "3", 3)]))
    assert {r.key: r.payload for r in cache.read().collect()} == {"a": "1", "b": "2"}
    monkeypatch.setattr(cache, "_publish", publish)
    cache.upsert(entries(spark, [("a", "3", 3)]))
    assert {r.key: r.payload for r in cache.read().collect()} == {"a": "3", "b": "2"}
    # the files of the upsert that lost, and of the first version where rewritten
    assert cache.vacuum(keep=1) >= 1 and {r.key: r.payload for r in cache.read().collect()} == {"a": "3", "b": "2"}


def test_batches_come_once_after_a_crash_before_the_commit(spark, monkeypatch):
    path, schema = folder(), "doc_id long, text string"
    tables = K.BatchTables(spark, folder())
    stream = lambda: K.scored_intake(spark.readStream.schema(schema).parquet(f"{path}/in"))
    commit, stops = tables._commit, []

    def stopped(batch):
        stops.append(batch)
        raise RuntimeError("stopped before the commit")

    for lot in (0, 1):
        spark.range(lot * 10, lot * 10 + 10).selectExpr("id as doc_id", "concat('text ', id) as text").write.mode("append").parquet(f"{path}/in")
        monkeypatch.setattr(tables, "_commit", stopped)
        with pytest.raises(Exception, match="stopped before the commit"):
            K.drain(stream(), tables, K.with_log)
        assert len(tables.committed()) == lot
        monkeypatch.setattr(tables, "_commit", commit)
        K.drain(stream(), tables, K.with_log)
    assert stops == [0, 1] and tables.committed() == [0, 1]
    scored = tables.read("scored", "doc_id long, total_score double, use_vision boolean, reason string")
    assert sorted(r.doc_id for r in scored.collect()) == list(range(20))
    assert tables.read("log", "level string, message string").count() == 20


def test_late_rows_are_counted(spark):
    path, tables = folder(), K.BatchTables(spark, folder())
    at = lambda h: dt.datetime(2024, 6, 1, h, 30)
    for hours in ([1, 5], [6, 2], [2, 7]):
        spark.createDataFrame([(i, "a", at(h)) for i, h in enumerate(hours)], "event_id long, event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
        K.drain(J.window_metrics(spark.readStream.schema("event_id long, event_type string, ts timestamp").parquet(f"{path}/in")), tables, lambda rows: {"metrics": rows})
    told = K.progress(tables).agg(F.sum("rows_in"), F.sum("late_rows")).first()
    # hour 2 comes twice after the watermark has passed it; hour 7 still waits
    assert tuple(told) == (6, 2)
    assert sorted(r.start.hour for r in tables.read("metrics", "start timestamp_ntz, event_type string, n long, points long").collect()) == [1, 5, 6]


def test_tables_without_a_batch_are_empty(spark):
    assert K.BatchTables(spark, folder()).read("log", "level string").collect() == []
