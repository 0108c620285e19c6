"""Readers and writers of the project's formats: JSON datasets, recorded model responses, snapshots of files, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: File types of recordings.
AUDIO = ("wav", "mp3", "m4a", "aac", "ogg", "opus", "flac", "webm", "mp4")

CASES = "case_id string, title string, language string, construction_tags array<string>, speaker_id string, speaker_name string, transcript struct<recording_id:string,duration_seconds:double,language_hints:array<string>,full_text:string,segments:array<struct<segment_id:string,start:double,end:double,text:string,chunk_id:string>>>, raw_extraction string"


def json_dataset(spark: SparkSession, path: str, schema: str = CASES, root: str = "cases") -> DataFrame:
    """The cases of a JSON document {dataset_id, cases: [...]}, with a declared schema; unknown fields are left out."""
    doc = spark.read.schema(f"dataset_id string, {root} array<struct<{_struct(schema)}>>").option("multiLine", True).json(path)
    return doc.select("dataset_id", F.explode(root).alias("c")).select("dataset_id", "c.*")


def _struct(schema: str) -> str:
    out, depth, name = [], 0, True
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == " " and depth == 0 and name and out and out[-1] not in ", ":
            out.append(":")
            name = False
            continue
        if ch == "," and depth == 0:
            name = True
        out.append(ch)
    return "".join(out).replace(", ", ",")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, path, split) of a manifest of datasets."""
    doc = spark.read.schema("datasets array<struct<dataset_id:string,path:string,split:string>>").option("multiLine", True).json(path)
    return doc.select(F.explode("datasets").alias("d")).select("d.*")


def recordings(spark: SparkSession, path: str, most_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """(path, length, modificationTime) of the audio files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*AUDIO) & (F.col("length") > 0) & (F.col("length") <= most_bytes))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def json_object(content: Column) -> Column:
    """The object of a model's answer, its Markdown fence taken off; null where it is no JSON object."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(content, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    return F.when(F.startswith(bare, F.lit("{")) & F.json_object_keys(bare).isNotNull() & F.try_parse_json(bare).isNotNull(), bare)


def retryable(status: Column) -> Column:
    """Whether an answer of a remote service may be asked for again; null is a broken connection."""
    return status.isNull() | status.isin(408, 409, 425, 429) | (status >= 500)


class RecordedResponses(DataSource):
    """Recorded answers of a model, one JSON object a line: format ``recorded_responses``, option ``path`` (a folder or file)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_responses"

    def schema(self) -> str:
        return "recording_id string, stage string, attempt int, status int, content string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordedReader(self.options["path"])


class _RecordedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.glob("*.jsonl")) if p.is_dir() else [p])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    r = json.loads(line)
                    content = r.get("content")
                    yield r["recording_id"], r["stage"], int(r.get("attempt", 1)), r.get("status"), content if content is None or isinstance(content, str) else json.dumps(content)


def first_good(responses: DataFrame) -> DataFrame:
    """The first attempt of each recording and stage whose content is a JSON object; primary, repair and fallback in this order."""
    rows = responses.withColumn("object", json_object(F.col("content"))).where("object is not null")
    return rows.groupBy("recording_id", "stage").agg(F.min_by(F.struct("attempt", "object"), "attempt").alias("x")).select("recording_id", "stage", "x.attempt", F.col("x.object").alias("content"))


def database_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_report(report: dict, path: str) -> None:
    """A small report as JSON with sorted keys."""
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def markdown(rows: list[dict], title: str) -> str:
    """A report's rows as a Markdown table."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(lines) + "\n"
