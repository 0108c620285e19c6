"""Quality metrics: precision and recall over sets and multisets, edit counts with their backtrace, thresholds.

Defined results: an empty comparison has precision and recall 1; a rate over nothing has denominator 1; null texts are empty.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, 1 where b is 0; not rounded."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def prf(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 beside the columns tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def multiset_counts(actual: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """tp, fp, fn of two bags of values by ``keys``: counts of both sides, then the smaller of the two."""
    a = actual.groupBy(*keys, value).agg(F.count("*").alias("a"))
    e = expected.groupBy(*keys, value).agg(F.count("*").alias("e"))
    j = a.join(e, [*keys, value], "full_outer").select(*keys, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("e", F.lit(0)).alias("e"))
    return j.groupBy(*keys).agg(F.sum(F.least("a", "e")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"))


def micro(rows: DataFrame) -> DataFrame:
    """One row: sums of tp, fp, fn and what follows from them."""
    return prf(rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))))


#: Words of a text whose edits are counted; beyond it the counts of a cell would not fit their bits.
MOST_WORDS = 1 << 20


def edits(reference: Sequence, hypothesis: Sequence) -> tuple[int, int, int, int]:
    """(distance, substitutions, deletions, insertions), the least in this order among all alignments.

    One row of the table at a time. The counts of a cell are one number of 63 bits, 21 for each of distance, substitutions and
    deletions, so the least tuple is the least number; what insertions a cell takes from its left is a running minimum, so a row
    is a few vector operations. Sequences are bounded by ``MOST_WORDS``.
    """
    if max(len(reference), len(hypothesis)) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words to compare")
    sub, dele, ins = (1 << 42) + (1 << 21), (1 << 42) + 1, 1 << 42
    number: dict = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in x], dtype=np.int64) for x in (reference, hypothesis))
    across = np.arange(len(b) + 1, dtype=np.int64) * ins
    row = across.copy()
    for i, r in enumerate(a, 1):
        new = row + dele
        new[0] = i * dele
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(b == r, 0, sub))
        row = np.minimum.accumulate(new - across) + across
    x = int(row[-1])
    d, s, k = x >> 42, x >> 21 & (1 << 21) - 1, x & (1 << 21) - 1
    return d, s, k, d - s - k


EDITS = T.StructType([T.StructField(n, T.LongType()) for n in ("errors", "substitutions", "deletions", "insertions", "reference_size")])


@F.pandas_udf(EDITS)
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Word-level edit counts; no built-in has the backtrace, so vectorized Python."""
    out = []
    for r, h in zip(reference, hypothesis, strict=True):
        a, b = (r or "").split(), (h or "").split()
        out.append((*edits(a, b), len(a)))
    return pd.DataFrame(out, columns=EDITS.names)


def error_rates(rows: DataFrame, by: str) -> DataFrame:
    """Summed edit counts and error rate by a column and over all (null), by grouping sets."""
    grouped = rows.rollup(by).agg(*(F.sum(c).alias(c) for c in ("errors", "substitutions", "deletions", "insertions", "reference_size")), F.count("*").alias("n_cases"))
    return grouped.withColumn("rate", F.col("errors") / F.greatest("reference_size", F.lit(1)))


def gate(measures: DataFrame, thresholds: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """One row a threshold: measure, value, passed. ``measures`` is one row with a column a measure."""
    names = [n for n, _, _ in thresholds]
    long = measures.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', cast(`{n}` as double)" for n in names) + ") as (measure, value)"))
    least = F.coalesce(*(F.when(F.col("measure") == n, F.lit(a)) for n, a, _ in thresholds), F.lit(None).cast("double"))
    most = F.coalesce(*(F.when(F.col("measure") == n, F.lit(b)) for n, _, b in thresholds), F.lit(None).cast("double"))
    return long.withColumn("passed", (F.col("value") >= F.coalesce(least, F.col("value"))) & (F.col("value") <= F.coalesce(most, F.col("value"))))


def unique_keys(pairs: DataFrame, left: str, key: str) -> DataFrame:
    """(left, key) of what has exactly one distinct key; the rest is unmatched, never guessed."""
    return pairs.where(F.col(key).isNotNull()).groupBy(left).agg(F.min(key).alias(key), F.max(key).alias("_b")).where(F.col(key) == F.col("_b")).drop("_b")


def set_counts(actual: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """tp, fp, fn of two sets of values by ``keys``; repeated values count once."""
    return multiset_counts(actual.select(*keys, value).distinct(), expected.select(*keys, value).distinct(), keys, value)


def person_counts(mapped: DataFrame, gold: DataFrame, by: str, key: str) -> DataFrame:
    """tp, fp, fn of mentions against gold people: distinct matched people are right, every further mention is not.

    ``mapped``: by and key of every mention, null where it matches nobody; ``gold``: by and key of every person.
    """
    a = mapped.groupBy(by).agg(F.size(F.collect_set(key)).cast("long").alias("tp"), F.count(F.lit(1)).alias("n"))
    g = gold.select(by, key).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("g"))
    j = a.join(g, by, "full_outer").select(by, F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("g", F.lit(0)).alias("g"))
    return j.select(by, "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def duplicates(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """For each ``by``: rows beyond the first of their key."""
    return rows.groupBy(by, *keys).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.sum(F.col("n") - 1).alias("n_duplicates"))


def equal_share(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how many expected keys have the expected value, and their share."""
    j = expected.select(key, F.col(value).alias("_e")).join(actual.select(key, F.col(value).alias("_a")), key, "left")
    counts = j.agg(F.coalesce(F.sum(F.col("_e").eqNullSafe(F.col("_a")).cast("long")), F.lit(0)).alias("n_equal"), F.count(F.lit(1)).alias("n_expected"))
    return counts.withColumn("share", ratio(F.col("n_equal"), F.col("n_expected")))


def resolution_scores(actual: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """For each ``by``: right statuses, merges into a wrong person, and people of gold that were called new.

    ``actual``: mention_id, status, person_id; ``gold``: by, mention_id, gold_status, gold_person.
    """
    j = gold.join(actual, "mention_id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    merged = (F.col("status") == "resolved") & ~F.col("person_id").eqNullSafe(F.col("gold_person"))
    split = (F.col("gold_status") == "resolved") & (F.col("status") == "new_person")
    out = j.groupBy(by).agg(F.count(F.lit(1)).alias("n_mentions"), n(F.col("status") == F.col("gold_status")).alias("n_right"), n(merged).alias("n_merged"), n(split).alias("n_split"))
    return out.withColumn("accuracy", ratio(F.col("n_right"), F.col("n_mentions")))


def closure(objects: DataFrame, references: str, known: DataFrame, by: str) -> DataFrame:
    """For each ``by``: objects, and those that cite something and only what is known. ``known``: by and id."""
    one = objects.withColumn("_o", F.monotonically_increasing_id()).select(by, "_o", F.explode_outer(references).alias("id"))
    have = known.select(by, "id").distinct().withColumn("_known", F.lit(True))
    each = one.join(have, [by, "id"], "left").groupBy(by, "_o").agg(F.count("id").alias("n"), F.count("_known").alias("k"))
    closed = (F.col("n") > 0) & (F.col("n") == F.col("k"))
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("n_objects"), F.sum(closed.cast("long")).alias("n_closed"))
