"""A sink for one file a document, as a Spark data source: executors write the files, the driver sees one message a task.

`docs.write.format("document_files")` stages the files of a task attempt in a folder of its own and moves them to their names once
all are written. A failed attempt removes what it made, a repeated one gives the same names, and what a lost executor leaves
stays in the staging folder, which the commit deletes. A failed job takes back the files of its finished tasks.

Tasks list and read files, too: Spark's file sources would hold every path on the driver and plan a task for each 32 small files.
Many files are dealt over subfolders by a hash of their names, so that no task lists them all.
"""

from __future__ import annotations

import errno
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_staging-"
#: Subfolders for as many files as a table has rows.
FOLDERS = 1024
#: Bytes of files that a task passes on at a time, but for a larger file.
READ_BYTES = 8 << 20


def _open(path: str):
    """The file system of a path or URI that pyarrow knows (local, hdfs, s3, gs), and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int
    size: int


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/{STAGING}{self.job}"

    def write(self, rows) -> Written:
        """Writes rows (output_name, content) and returns how many; nothing is left of an attempt that fails."""
        system, root = _open(self.path)
        attempt = uuid.uuid4().hex
        folder = f"{self._staging(root)}/{attempt}"
        names, size, placed = [], 0, []
        system.create_dir(folder, recursive=True)
        try:
            for row in rows:
                data = row["content"] or b""
                data = data.encode() if isinstance(data, str) else bytes(data)
                with system.open_output_stream(f"{folder}/{len(names)}") as out:
                    out.write(data)
                names.append(row["output_name"])
                size += len(data)
            # the names, for a job that fails later
            with system.open_output_stream(f"{folder}.names") as out:
                out.write(json.dumps(names).encode())
            for below in {name.rpartition("/")[0] for name in names} - {""}:
                system.create_dir(f"{root}/{below}", recursive=True)
            for i, name in enumerate(names):
                system.move(f"{folder}/{i}", f"{root}/{name}")
                placed.append(name)
        except BaseException:
            for name in placed:
                system.delete_file(f"{root}/{name}")
            system.delete_dir(folder)
            raise
        return Written(attempt, len(names), size)

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        if system.get_file_info(self._staging(root)).type.name == "Directory":
            system.delete_dir(self._staging(root))

    def abort(self, messages) -> None:
        """Takes back the files of finished tasks, by the lists that they left."""
        system, root = _open(self.path)
        for message in messages:
            if message is not None:
                with system.open_input_stream(f"{self._staging(root)}/{message.attempt}.names") as listed:
                    for name in json.loads(listed.read()):
                        if system.get_file_info(f"{root}/{name}").is_file:
                            system.delete_file(f"{root}/{name}")
        self.commit(messages)


class DocumentFiles(DataSource):
    """df (output_name, content: text or bytes) as files in a folder."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "output_name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("document_files only appends")
        return Writer(self.options["path"].rstrip("/"))


def _placed(name: Column, folders: int) -> Column:
    """The path of a file below its folder: its name, with several folders below a number by the name's hash."""
    return F.concat((F.crc32(name) % folders).cast("string"), F.lit("/"), name) if folders > 1 else name


def _hidden(name: str) -> bool:
    """What Spark's file sources pass over: staging, check sums, markers."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def list_document_files(spark: SparkSession, path: str, folders: int = 1) -> DataFrame:
    """output_name of the files in the folder path, or in its subfolders of write_document_files; each folder is listed by a task."""

    def names(batches):
        from pyarrow import fs

        system, root = _open(path)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{root}/{i}" if folders > 1 else root, allow_not_found=True))
                yield pa.RecordBatch.from_arrays([pa.array([f.base_name for f in found if f.is_file and not _hidden(f.base_name)], pa.string())], ["output_name"])

    tasks = min(folders, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.range(0, folders, 1, tasks).mapInArrow(names, "output_name string")


def read_document_files(files: DataFrame, path: str, folders: int = 1) -> DataFrame:
    """files (output_name and others) with content: the bytes of the file of that name, as write_document_files places it; null if
    there is none. Hidden names and names with a path have none. Rows stay in their tasks, which read file by file."""

    def content(system, root: str, name: str | None, place: str | None) -> bytes | None:
        if not name or "/" in name or "\0" in name or _hidden(name):
            return None
        try:
            if not system.get_file_info(f"{root}/{place}").is_file:
                return None
        except OSError as e:
            # no file can have the name
            if e.errno == errno.ENAMETOOLONG:
                return None
            raise
        with system.open_input_stream(f"{root}/{place}") as data:
            return data.read()

    def read(batches):
        system, root = _open(path)
        for batch in batches:
            first, held, size = 0, [], 0
            names, places = batch.column(at), batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                held.append(content(system, root, names[i].as_py(), places[i].as_py()))
                size += len(held[-1] or b"")
                if size >= READ_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns[:-1], pa.array(held, pa.binary())], columns)
                    first, held, size = i + 1, [], 0

    at, columns = files.columns.index("output_name"), [*files.columns, "content"]
    return files.select("*", _placed(F.col("output_name"), folders).alias("_place")).mapInArrow(read, files.schema.add("content", "binary"))


def write_document_files(docs: DataFrame, path: str, parts: int | None = None, folders: int = 1) -> None:
    """One file a document (output_name, content: text or bytes) in the folder path, or dealt over as many `folders` below it, written
    by executors; other columns are ignored.

    Documents of one name meet in one task, by order of content: the second and later ones get ~2, ~3 before the suffix, which
    `output_name` never makes. A null content is an empty file; a null or empty name is `document.md`; separators in a name
    become _. A file that is there already is replaced. An empty table writes nothing.
    """
    spark = docs.sparkSession
    spark.dataSource.register(DocumentFiles)
    name = F.regexp_replace(F.coalesce(F.nullif("output_name", F.lit("")), F.lit("document.md")), r"[/\\:]|^[._]", "_")
    rows = docs.select(name.alias("output_name"), "content")
    # most names come once: only repeated ones are numbered, so that a hot name costs its own rows a window
    often = rows.groupBy("output_name").count().where("count > 1")
    numbered = F.concat(F.regexp_replace("output_name", r"\.[^.]*$", ""), F.when(F.col("k") > 1, F.concat(F.lit("~"), F.col("k").cast("string"))).otherwise(""), F.regexp_extract("output_name", r"(\.[^.]*)?$", 0))
    again = rows.join(often.select("output_name"), "output_name", "left_semi").selectExpr("*", "row_number() over (partition by output_name order by content) as k")
    rows = rows.join(often.select("output_name"), "output_name", "left_anti").unionByName(again.select(numbered.alias("output_name"), "content"))
    rows = rows.select(_placed(F.col("output_name"), folders).alias("output_name"), "content")
    (rows.repartition(parts) if parts else rows).write.format("document_files").mode("append").save(path)
