"""Processing traces: durations, attributes that may leave the system, spans, retention and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import lexicon


def once(events: DataFrame, *keys: str) -> DataFrame:
    """Each event once, however often it was delivered.

    With ``keys`` (which an event determines) the rows are laid out by them first, so that what follows by these keys needs no
    further shuffle: repeats are rare, and a partial deduplication would save nothing.
    """
    return events.repartition(*keys).dropDuplicates([*keys, "event_id"]) if keys else events.dropDuplicates(["event_id"])


def stage_totals(events: DataFrame) -> DataFrame:
    """Time and attempts by job and stage; null durations count as none."""
    return once(events, "job_id").groupBy("job_id", "stage").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("total_ms"), F.size(F.collect_set("attempt")).cast("long").alias("n_attempts"), F.count("*").alias("n_events"))


def job_totals(events: DataFrame) -> DataFrame:
    """Time, attempts and outcome of the last event of each job."""
    last = F.max_by(F.col("outcome"), F.struct("attempt", "sequence", "event_id"))
    return once(events, "job_id").groupBy("job_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("total_ms"), F.max("attempt").cast("long").alias("attempts"), last.alias("outcome"))


def safe_attributes(events: DataFrame) -> DataFrame:
    """Attributes without sensitive keys, keys in lower case and cut to 64, values to 256 characters, one row each."""
    rows = once(events).select("event_id", F.explode("attributes").alias("k", "v"))
    hidden = F.lit(False)
    for part in lexicon.SENSITIVE_KEYS:
        hidden = hidden | F.contains(F.lower("k"), F.lit(part))
    return rows.where(~hidden).select("event_id", F.substring(F.lower("k"), 1, 64).alias("key"), F.substring("v", 1, 256).alias("value"))


def gaps(events: DataFrame) -> DataFrame:
    """Milliseconds between consecutive events of a trace, in order of attempt and sequence."""
    w = Window.partitionBy("trace_id").orderBy("attempt", "sequence", "event_id")
    return once(events, "trace_id").withColumn("previous", F.lag("created_at").over(w)).where("previous is not null").select("trace_id", "event_id", F.expr("timestampdiff(MILLISECOND, previous, created_at)").alias("gap_ms"))


def late(events: DataFrame, hours: int = 24) -> DataFrame:
    """By stage: events, and events that came after a newer event of their job."""
    w = Window.partitionBy("job_id").orderBy("attempt", "sequence", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = once(events, "job_id").withColumn("newest", F.max("created_at").over(w))
    return rows.groupBy("stage").agg(F.count("*").alias("n_events"), F.sum((F.col("created_at") < F.col("newest")).cast("long")).alias("n_late"))


def expired(events: DataFrame, cutoff: str) -> DataFrame:
    """Traces of jobs whose last event is final and older than the cutoff: what retention would delete."""
    jobs = once(events, "job_id").groupBy("job_id").agg(F.max("created_at").alias("last"), F.max_by("outcome", F.struct("attempt", "sequence", "event_id")).alias("outcome"), F.count("*").alias("n_events"))
    return jobs.where((F.col("last") < F.lit(cutoff).cast("timestamp")) & F.col("outcome").isin("succeeded", "failed")).select("job_id", "n_events")


def over_budget(events: DataFrame, most_ms: int) -> DataFrame:
    """Recordings whose traces took longer than a budget."""
    return once(events, "recording_id").groupBy("recording_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("total_ms")).where(F.col("total_ms") > most_ms)


def stage_quantiles(events: DataFrame) -> DataFrame:
    """Number, least, mean and greatest duration of each stage."""
    return once(events).where("duration_ms is not null").groupBy("stage").agg(F.count("*").alias("n"), F.min("duration_ms").cast("long").alias("least_ms"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").cast("long").alias("most_ms"), F.expr("percentile(duration_ms, 0.5)").alias("median_ms"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregation and no sort."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x")).select(key, "x.*")
