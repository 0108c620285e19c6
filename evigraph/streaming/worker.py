"""The processing worker as Structured Streaming: at-least-once input, writes that may be repeated.

A batch writes its rows under a folder of its own number and then its manifest; a repeated batch overwrites the same folder,
and readers take only batches that have a manifest. So several tables change together although files know no transaction.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trace_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Events as they arrive in a folder of parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each event once within the delay by which events may be late; state older than that is dropped."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def stage_windows(events: DataFrame, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Events and time by stage and window of arrival time."""
    by = events.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "stage")
    return by.agg(F.count("*").alias("n_events"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_ms")).select(F.col("window.start").alias("window_start"), "stage", "n_events", "total_ms")


def sessions(events: DataFrame, gap: str = "1 hour", delay: str = "7 days") -> DataFrame:
    """Bursts of events of a family with no longer gap between them."""
    by = events.withWatermark("created_at", delay).groupBy(F.session_window("created_at", gap), "family_id")
    return by.agg(F.count("*").alias("n_events")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "family_id", "n_events")


LAST = "job_id string, attempt int, n_events long, outcome string"


def _fold_job(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    """The newest attempt of a job and its outcome over all batches; a job without events for ``keep_ms`` of event time is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    attempt, sequence, n, outcome = state.get if state.exists else (0, -1, 0, "")
    newest = 0
    for f in frames:
        n += len(f)
        newest = max([newest, *(int(t.timestamp() * 1000) for t in f["created_at"].dropna())])
        for a, s, o in sorted(zip(f["attempt"], f["sequence"], f["outcome"], strict=True), key=lambda x: (x[0], x[1])):
            if (a, s) >= (attempt, sequence):
                attempt, sequence, outcome = int(a), int(s), o or ""
    state.update((attempt, sequence, n, outcome))
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
    yield pd.DataFrame({"job_id": [key[0]], "attempt": [attempt], "n_events": [n], "outcome": [outcome]})


def job_states(events: DataFrame, keep_hours: float = 168.0, delay: str = "7 days") -> DataFrame:
    """The running state of every job, in update mode, by custom state that goes ``keep_hours`` of event time after a job's last event."""
    return events.withWatermark("created_at", delay).groupBy("job_id").applyInPandasWithState(partial(_fold_job, keep_ms=int(keep_hours * 3_600_000)), LAST, "attempt int, sequence int, n long, outcome string", "update", GroupStateTimeout.EventTimeTimeout)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def commit_batch(tables: dict[str, DataFrame], root: str, batch: int) -> None:
    """Write all tables of a batch, then its manifest; repeating it leaves the same files."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    fs, p = _fs(spark, f"{root}/_manifests/{batch}.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"batch": batch, "tables": sorted(tables)}).encode()))
    out.close()


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table from batches that have a manifest."""
    done = spark.read.json(f"{root}/_manifests").select(F.col("batch").cast("int").alias("batch"), F.explode("tables").alias("t")).where(F.col("t") == table).select("batch")
    return spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}").join(done, "batch", "left_semi").drop("batch")


def run_available(stream: DataFrame, process: Callable[[DataFrame], dict[str, DataFrame]], root: str) -> None:
    """Process all input that is there and stop; a restart goes on after the last committed batch."""
    query = stream.writeStream.foreachBatch(lambda df, n: commit_batch(process(df), root, n)).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
