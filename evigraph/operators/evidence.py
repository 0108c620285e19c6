"""Checking candidate evidence against its source text, and the contexts around it.

Defined results: a candidate of an unknown segment, or with a null or empty text, keeps its row and says so in ``status``;
nothing is guessed where a text occurs more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import lexicon
from evigraph.functions.text import has_phrase, normalize, occurrences


def segments_of(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(record, seg_ord, segment_id, start, end, text) of every transcript, each record once; the order is kept as a number."""
    rows = cases.select(F.col(key).alias("record"), F.col("transcript.segments").alias("s")).dropDuplicates(["record"])
    return rows.select("record", F.posexplode("s").alias("seg_ord", "g")).select("record", "seg_ord", "g.segment_id", "g.start", "g.end", "g.text")


def recover_offsets(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Classify claimed offsets of (record, evidence_id, segment_id, text, start_char, end_char) and recover missing ones.

    already_valid, recovered (the text occurs once), ambiguous, missing, unknown_segment or invalid_text.
    """
    source = segments.select("record", "segment_id", F.col("text").alias("source"))
    j = candidates.join(source, ["record", "segment_id"], "left")
    length = F.length("text")
    valid = (F.substring("source", F.col("start_char") + 1, length) == F.col("text")) & (F.col("end_char") - F.col("start_char") == length)
    found = occurrences(F.col("source"), F.col("text"))
    j = j.withColumn("found", F.when(F.col("source").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(valid, F.lit(False)), found).otherwise(F.array().cast("array<int>")))
    status = (
        F.when(F.col("text").isNull() | (F.col("text") == ""), "invalid_text")
        .when(F.col("source").isNull(), "unknown_segment")
        .when(F.coalesce(valid, F.lit(False)), "already_valid")
        .when(F.size("found") == 1, "recovered")
        .when(F.size("found") > 1, "ambiguous")
        .otherwise("missing")
    )
    j = j.withColumn("status", status)
    start = F.when(F.col("status") == "already_valid", F.col("start_char")).when(F.col("status") == "recovered", F.get("found", F.lit(0)))
    return j.select("record", "evidence_id", "segment_id", "status", start.alias("start_char"), (start + length).alias("end_char"))


def context_windows(segments: DataFrame, most_chars: int = lexicon.CONTEXT_CHARS) -> DataFrame:
    """Windows of one or two consecutive segments within a length, each normalized text once per record.

    The next segment comes by ``lead``; no row meets another record's.
    """
    w = Window.partitionBy("record").orderBy("seg_ord")
    pairs = segments.withColumn("next", F.lead("text").over(w))
    windows = pairs.select("record", "seg_ord", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("text").alias("text")), F.struct(F.lit(2).alias("n"), F.concat("text", F.lit(" "), "next").alias("text")))).alias("x")).select("record", "seg_ord", "x.n", "x.text")
    windows = windows.where(F.col("text").isNotNull() & (F.length("text") <= most_chars)).withColumn("norm", normalize(F.col("text")))
    first = Window.partitionBy("record", "norm").orderBy("seg_ord", "n")
    return windows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def top_contexts(windows: DataFrame, most: int = lexicon.TOP_CONTEXTS) -> DataFrame:
    """The first ``most`` windows of each record by number of segments, length and text."""
    w = Window.partitionBy("record").orderBy("n", F.length("text"), "text", "seg_ord")
    return windows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def previous_context(segments: DataFrame, most_chars: int = lexicon.CONTEXT_CHARS) -> DataFrame:
    """Each segment with the one before it, if both fit the length together."""
    w = Window.partitionBy("record").orderBy("seg_ord")
    joint = F.length("text") + F.length("before") + 1
    return segments.withColumn("before", F.lag("text").over(w)).withColumn("joint_chars", F.when(joint <= most_chars, joint).otherwise(F.length("text"))).withColumn("has_previous", F.coalesce(joint <= most_chars, F.lit(False)))


def ordered_segments(rows: DataFrame, key: str, references: str, segments: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """(key, segments) with the distinct references of each row in transcript order; unknown ones last, in order, or dropped.

    ``rows`` have the column record.
    """
    each = rows.select("record", key, F.explode(F.array_distinct(F.col(references))).alias("segment_id"))
    each = each.join(segments.select("record", "segment_id", "seg_ord"), ["record", "segment_id"], "left" if keep_unknown else "inner")
    at = F.struct(F.col("seg_ord").isNull().alias("unknown"), "seg_ord", "segment_id")
    return each.groupBy("record", key).agg(F.array_sort(F.collect_set(at)).alias("s")).select("record", key, F.transform("s", lambda x: x["segment_id"]).alias("segments"))


def identity_segment(rows: DataFrame, key: str, name: str, references: str, segments: DataFrame) -> DataFrame:
    """(key, segment_id): the first cited segment that names the row, else the first one cited, both in transcript order."""
    each = rows.select("record", key, normalize(F.col(name)).alias("n"), F.explode(F.array_distinct(F.col(references))).alias("segment_id"))
    each = each.join(segments.select("record", "segment_id", "seg_ord", normalize(F.col("text")).alias("t")), ["record", "segment_id"])
    named = F.coalesce((F.length("n") > 0) & has_phrase(F.col("t"), F.col("n")), F.lit(False))
    return each.groupBy("record", key).agg(F.min_by("segment_id", F.struct((~named).alias("no"), "seg_ord")).alias("segment_id"))


def nearest_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, within: float, size: str) -> DataFrame:
    """As-of join forward: for each left row the nearest right row of its keys that begins within a distance; ties go to the longest.

    The distance is cut into cells of its own width, so each left row meets two cells instead of its whole group.
    """
    cell = lambda c: F.floor(F.col(c) / within)
    a = left.withColumn("_cell", F.explode(F.array(cell(at), cell(at) + 1)))
    b = right.withColumn("_cell", cell(start))
    j = a.join(b, [*keys, "_cell"]).where((F.col(start) >= F.col(at)) & (F.col(start) - F.col(at) <= within))
    return j.withColumn("distance", F.col(start) - F.col(at)).drop("_cell").withColumn("_key", F.struct("distance", -F.col(size), F.col(start)))


def unique_near(pairs: DataFrame, keys: list[str], target: str) -> DataFrame:
    """The targets of left rows that have exactly one distinct target near them."""
    return pairs.groupBy(*keys).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")


def weakest_class(class_column: Column) -> Column:
    """The weakest of an array of evidence classes."""
    rank = F.transform(class_column, lambda c: F.array_position(F.array(*map(F.lit, lexicon.EVIDENCE_CLASSES)), c))
    return F.get(F.array(*map(F.lit, lexicon.EVIDENCE_CLASSES)), (F.array_max(rank) - 1).cast("int"))


def unknown_references(rows: DataFrame, key: str, references: str, known: DataFrame, known_id: str) -> DataFrame:
    """(key, reference) of the array ``references`` that name no row of ``known``."""
    each = rows.select(key, F.explode(F.array_distinct(F.col(references))).alias("reference"))
    return each.join(known.select(F.col(known_id).alias("reference")).distinct(), "reference", "left_anti").select(key, "reference")
