"""Exactly-once sinks of streams: micro-batches that may be repeated, appended to tables once.

A batch is written below its number, `batch=7`, in overwrite mode, to every table of the sink; then `committed/7` is created.
A batch that is repeated after a crash replaces what it wrote before, and readers see the batches with a commit only, so a batch
appears in all its tables at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import vision_decision
from ..sources.files import page_log

PROGRESS = "batch long, rows_in long, late_rows long, state_rows long"


class BatchTables:
    """Tables in a folder that driver and executors share, to which micro-batches are appended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self._fs.globStatus(self._new(f"{self.root}/committed/*")) or [])

    def append(self, batch: int, tables: Mapping[str, DataFrame]) -> None:
        """Writes a batch's rows to each table, then commits the batch. A committed batch is left as it is."""
        if self._fs.exists(self._new(f"{self.root}/committed/{batch}")):
            return
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        self._commit(batch)

    def _commit(self, batch: int) -> None:
        self._fs.create(self._new(f"{self.root}/committed/{batch}"), True).close()

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of a table's committed batches, with the number of their batch; none yet gives an empty table."""
        paths = [f"{self.root}/{name}/batch={b}" for b in self.committed()]
        full = f"{schema}, batch int"
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(*paths)


def drain(stream: DataFrame, tables: BatchTables, of_batch: Callable[[DataFrame], Mapping[str, DataFrame]], mode: str = "append") -> None:
    """Runs a stream over what is there, giving each batch's rows to `of_batch`, and logs a row for each batch as PROGRESS in the
    table `progress`: rows read, rows dropped for lateness and rows of state. Goes on from the checkpoint below tables.root."""

    def write(rows: DataFrame, batch: int) -> None:
        # several tables come from one batch: its rows are computed once
        rows.persist()
        try:
            tables.append(batch, of_batch(rows))
        finally:
            rows.unpersist()

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{tables.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [(p.batchId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators), sum(s.numRowsTotal for s in p.stateOperators)) for p in query.recentProgress]
    if seen:
        spark = stream.sparkSession
        # a batch is told again by every run that looks at it: the last word counts
        spark.createDataFrame(seen, PROGRESS).coalesce(1).write.mode("append").parquet(f"{tables.root}/progress")


def progress(tables: BatchTables) -> DataFrame:
    """PROGRESS of each batch with input or late rows."""
    rows = tables.spark.read.schema(PROGRESS).parquet(f"{tables.root}/progress")
    return rows.groupBy("batch").agg(*[F.max(c).alias(c) for c in ("rows_in", "late_rows", "state_rows")])


def scored_intake(documents: DataFrame) -> DataFrame:
    """Documents as they arrive, scored row by row, with the time and method that the log tells."""
    return vision_decision(documents).select("doc_id", "total_score", "use_vision", "reason")


def with_log(rows: DataFrame) -> dict[str, DataFrame]:
    """A batch of scored documents (doc_id, total_score, use_vision, reason) and its log rows (level, message)."""
    pages = rows.select(F.timestamp_seconds(F.col("doc_id")).alias("ts"), F.col("doc_id").alias("page_no"), F.when(F.col("use_vision"), "vision").otherwise("text").alias("method"), F.lit(0).cast("long").alias("seconds"), F.lit(False).alias("from_cache"))
    return {"scored": rows, "log": page_log(pages).select("level", "message")}
