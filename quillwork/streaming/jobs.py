"""Structured Streaming jobs: scored intake, reuse within a day, and metrics in event-time windows.

Each job reads new files as they come, keeps its progress in a checkpoint folder and appends to a Parquet table. `run` drains
what is there and returns the table.
"""

from __future__ import annotations

import json
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import vision_decision
from ..sources.files import shared_folder


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of the files of a table, with the schema that the files have now."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    # watermarks need an instant; times without a zone are read in the session's
    return stream.withColumns({c: stream[c].cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"})


def run(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Drains what the stream has now. With the same folder a later run goes on where the last one ended."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def intake(documents: DataFrame) -> DataFrame:
    """Documents scored and routed as they arrive: row by row, without state."""
    return vision_decision(documents).select("doc_id", "total_score", "use_vision", "reason")


def reuse(events: DataFrame, keys: list[str], ttl: float = 86_400, late: str = "10 minutes", groups: int = 1024) -> DataFrame:
    """keys and ts of the events that are worked on: the first of a key, then the first that comes `ttl` seconds or more after the
    last one worked on; what comes earlier reuses its result.

    The state of a key is one instant, forgotten once the watermark has passed its time to live. Keys are dealt by a hash over
    `groups` states, since a call of Python for each key costs far more than its events; a checkpoint keeps its number of groups.
    Events have to arrive in time order up to `late`; one older than the last of its key worked on is taken as reuse. Null keys are a
    key of their own; keys travel as text, so they are of types that text stands for; rows without ts are dropped.
    """
    names, kinds, wait = [f"k{i}" for i in range(len(keys))], dict(events.dtypes), round(ttl * 1_000_000)

    def admit(group, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = {tuple(k): at for *k, at in json.loads(state.get[0])} if state.exists else {}
        rows = [row for b in batches for row in zip(b["at"].tolist(), zip(*[b[n] for n in names], strict=True), strict=True)]
        out = []
        for at, key in sorted(rows, key=itemgetter(0)):
            if key not in last or at - last[key] >= wait:
                out.append((*key, at))
                last[key] = at
        mark = max(0, state.getCurrentWatermarkMs())
        held = [(*key, at) for key, at in last.items() if at + wait > mark * 1000]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max((max(row[-1] for row in held) + wait) // 1000, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*names, "at"])

    marked = events.where("ts is not null").withWatermark("ts", late)
    # the watermark is on ts: rows that it has passed are dropped by that column
    dealt = marked.select(F.pmod(F.hash(*keys), F.lit(groups)).alias("group"), *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)], F.unix_micros("ts").alias("at"), "ts")
    worked = dealt.groupBy("group").applyInPandasWithState(admit, ", ".join(f"{n} string" for n in names) + ", at long", "held string", "append", "EventTimeTimeout")
    return worked.select(*[F.col(n).cast(kinds[k]).alias(k) for k, n in zip(keys, names, strict=True)], F.timestamp_micros("at").alias("ts"))


def window_metrics(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events, errors and value by event type and window; windows are given out once the watermark has passed them, and rows
    that come later are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    d = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 7).alias("points"))
    return d.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "points")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events at most `gap` apart."""
    d = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return d.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
