"""Strict parsing with quarantine: every rule is a boolean column, the first that fails gives the issue code.

Each operator returns rows, never an exception; a bad object does not take its siblings along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def first_failure(rules: Sequence[Rule]) -> Column:
    """The code of the first rule that is violated, in the given order, or null; a rule that is null counts as violated."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules), F.lit(None).cast("string"))


def quarantine(rows: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(accepted, issues): both from one pass over ``rows``; issues have the code in ``issue_code``."""
    judged = rows.withColumn("issue_code", first_failure(rules))
    return judged.where("issue_code is null").drop("issue_code"), judged.where("issue_code is not null")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order; an aggregation that combines before the shuffle, so hot keys cost nothing."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def dropped_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key that comes more than once: how many rows a deduplication drops."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("n_dropped", F.col("n") - 1).drop("n")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues by code."""
    return issues.groupBy("issue_code").agg(F.count("*").alias("n_issues"))


def segment_rules() -> list[Rule]:
    """Invariants of a segment: an id, a positive span, some text."""
    return [
        ("segment_id_missing", F.col("segment_id").isNotNull() & (F.col("segment_id") != "")),
        ("segment_span_invalid", (F.col("start") >= 0) & (F.col("end") > F.col("start"))),
        ("segment_text_empty", F.length(F.trim("text")) > 0),
    ]


def mention_rules() -> list[Rule]:
    """Invariants of a mention: ids, a name, segments, a confidence in range, not reviewed yet."""
    return [
        ("mention_id_missing", F.col("mention_id").isNotNull()),
        ("name_empty", F.length(F.trim("name")) > 0),
        ("source_segments_missing", F.size("source_segment_ids") > 0),
        ("confidence_invalid", F.col("confidence").isNull() | F.col("confidence").between(0, 1)),
        ("status_not_unreviewed", F.col("verification_status") == "unreviewed"),
        ("relation_missing", F.col("relation_to_speaker").isNotNull() | (F.col("category") != "family_member")),
    ]


def edge_rules() -> list[Rule]:
    """Invariants of a relationship: two ends that differ, and roles that fit its type."""
    s, o = F.col("subject_role"), F.col("object_role")
    legal = (
        F.when(F.col("relationship_type") == "parent_child", ((s == "parent") & (o == "child")) | ((s == "child") & (o == "parent")))
        .when(F.col("relationship_type") == "spouse", (s == "spouse") & (o == "spouse"))
        .when(F.col("relationship_type") == "sibling", s.contains("sibling") & o.contains("sibling"))
        .otherwise(F.lit(False))
    )
    return [
        ("subject_missing", F.col("subject_person_id").isNotNull()),
        ("object_missing", F.col("object_person_id").isNotNull()),
        ("endpoints_equal", F.col("subject_person_id") != F.col("object_person_id")),
        ("roles_illegal", legal),
    ]


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side and on which they are: both, left_only, right_only."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))
