"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in a local session."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Folders of tables that `stash` has written in this process and nobody has deleted.
STASHES: list[str] = []


def stash(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, for results that several branches use."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STASHES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that `stash` wrote, once nothing reads them any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        STASHES.remove(path)


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(batches, rows: int = 512):
    """Arrow batches cut into smaller ones, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_rows(docs: DataFrame) -> DataFrame:
    """docs as one column `row`: its columns may have any name and type, and meet no other."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def tree_sum(partials: DataFrame, columns: list[str], fan_in: int = 32) -> dict[str, np.ndarray]:
    """Sums of array<double> columns over all rows (one row per task, say): two levels, at most fan_in rows reach the driver.

    A column without rows gives an empty array.
    """
    import pyarrow as pa

    schema = ", ".join(f"{c} array<double>" for c in columns)

    def add(batches):
        total: dict[str, np.ndarray | None] = dict.fromkeys(columns)
        for batch in batches:
            for c in columns:
                for value in batch.column(c):
                    v = np.asarray(value.values, dtype=float)
                    total[c] = v.copy() if total[c] is None else total[c] + v
        if total[columns[0]] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64())) for v in total.values()], columns)

    rows = partials.select(*columns).repartition(fan_in).mapInArrow(add, schema).collect()
    return {c: np.sum([np.asarray(r[c]) for r in rows], axis=0) if rows else np.zeros(0) for c in columns}


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then maximal runs of bytes outside space and \\x09-\\x0D."""
    return text.lower().split()
