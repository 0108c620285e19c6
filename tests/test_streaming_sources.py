import datetime
import json

from conftest import rows
from pyspark.sql import functions as F

from evigraph.sources import files
from evigraph.streaming import worker

EVENT = "event_id string, job_id string, family_id string, stage string, attempt int, sequence int, outcome string, duration_ms int, created_at timestamp"


def events(n, start=0):
    t = datetime.datetime(2026, 1, 1)
    return [(f"e{i}", f"j{i % 3}", "f", "asr", 1 + i // 3, i, "succeeded" if i % 2 else "failed", i, t + datetime.timedelta(minutes=i)) for i in range(start, start + n)]


def test_worker_commits_once_and_resumes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(events(6), EVENT).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    run = lambda: worker.run_available(worker.trace_stream(spark, src, schema, 1), lambda df: {"events": df, "jobs": df.select("job_id").distinct()}, out)
    run()
    assert worker.committed(spark, out, "events").count() == 6
    run()
    assert worker.committed(spark, out, "events").count() == 6
    spark.createDataFrame(events(4, 6), EVENT).coalesce(1).write.mode("append").parquet(src)
    run()
    assert worker.committed(spark, out, "events").count() == 10
    worker.commit_batch({"events": spark.createDataFrame(events(1), EVENT)}, out, 7)
    worker.commit_batch({"events": spark.createDataFrame(events(1), EVENT)}, out, 7)
    assert worker.committed(spark, out, "events").count() == 11


def run_memory(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_deduplication_windows_and_state(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(events(6) + events(2), EVENT).coalesce(1).write.parquet(src)
    stream = worker.trace_stream(spark, src, spark.read.parquet(src).schema)
    assert run_memory(worker.deduplicated(stream), "dedup", "append").count() == 6
    assert rows(run_memory(worker.stage_windows(stream), "windows", "complete"), "stage", "n_events") == [("asr", 8)]
    got = rows(run_memory(worker.job_states(stream), "jobs", "update"), "job_id", "attempt", "n_events")
    assert got == [("j0", 2, 3), ("j1", 2, 3), ("j2", 2, 2)]


def test_recorded_responses(spark, tmp_path):
    lines = [{"recording_id": "r", "stage": "core", "attempt": 1, "status": 500, "content": None}, {"recording_id": "r", "stage": "core", "attempt": 2, "status": 200, "content": "```json\n{\"a\": 1}\n```"}, {"recording_id": "r", "stage": "events", "attempt": 1, "status": 200, "content": "[1]"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    spark.dataSource.register(files.RecordedResponses)
    df = spark.read.format("recorded_responses").option("path", str(tmp_path)).load()
    assert df.count() == 3
    assert rows(files.first_good(df), "recording_id", "stage", "attempt", "content") == [("r", "core", 2, '{"a": 1}')]
    assert [r["x"] for r in df.orderBy("stage", "attempt").select(files.retryable(F.col("status")).alias("x")).collect()] == [True, False, False]


def test_datasets_and_snapshots(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"dataset_id": "x", "cases": [{"case_id": "c1", "title": "t", "transcript": {"recording_id": "r", "segments": [{"segment_id": "s", "start": 0, "end": 1, "text": "hi"}]}, "unknown": 1}]}))
    got = files.json_dataset(spark, str(tmp_path / "d.json")).select("dataset_id", "case_id", "transcript.segments").collect()
    assert got[0]["case_id"] == "c1" and got[0]["segments"][0]["text"] == "hi"
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "a.wav").write_bytes(b"abc")
    (tmp_path / "audio" / "b.txt").write_bytes(b"abc")
    assert files.recordings(spark, str(tmp_path / "audio")).count() == 1
    assert {r["sha256"] for r in files.snapshot(spark, str(tmp_path / "audio")).collect()} == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}
    assert files.markdown([{"a": 1}], "T").count("|") == 6 and "No rows" in files.markdown([], "T")
    files.write_report({"b": 1, "a": "ё"}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["a"] == "ё"
