"""Speech regions to chunks, padding, and merging of overlapping transcript parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import lexicon
from evigraph.functions.text import name_key


def smart_ranges(regions: DataFrame, key: str, most: float = lexicon.CHUNK_SECONDS, gap: float = lexicon.GAP_SECONDS) -> DataFrame:
    """Merge the sorted regions of a key while the whole stays within ``most`` seconds and gaps within ``gap``.

    The cap on the whole makes this a fold, not islands: one array fold a recording, whose regions are bounded by its length.
    """
    rows = regions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    empty = F.array().cast("array<struct<start:double,end:double>>")

    def step(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (r["end"] - last["start"] <= most) & (r["start"] - last["end"] <= gap)
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(F.struct(r["start"].alias("start"), r["end"].alias("end")))))

    return rows.select(key, F.posexplode(F.aggregate("r", empty, step)).alias("chunk", "x")).select(key, "chunk", "x.start", "x.end")


def padded(ranges: DataFrame, total: str, padding: float = lexicon.PADDING_SECONDS, most: float = lexicon.FINAL_SECONDS) -> DataFrame:
    """Widen each range on both sides within [0, total]; what is over ``most`` seconds is trimmed evenly."""
    a, b = F.greatest(F.col("start") - padding, F.lit(0.0)), F.least(F.col("end") + padding, F.col(total))
    over = F.greatest(b - a - most, F.lit(0.0))
    return ranges.withColumn("padded_start", a + over / 2).withColumn("padded_end", b - (over - over / 2))


def shared_words(before: Column, after: Column, most: Column) -> Column:
    """The largest number k of at least 2 and at most ``most`` words by which one text ends and the next begins, or 0."""
    a = F.transform(F.split(F.trim(before), r"\s+"), name_key)
    b = F.transform(F.split(F.trim(after), r"\s+"), name_key)
    limit = F.least(most, F.size(a), F.size(b))
    same = F.filter(F.sequence(F.lit(2), F.greatest(limit, F.lit(2))), lambda k: (k <= limit) & (F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k)) & ~F.array_contains(F.slice(b, F.lit(1), k), ""))
    return F.when((limit >= 2) & before.isNotNull() & after.isNotNull(), F.coalesce(F.array_max(same), F.lit(0))).otherwise(F.lit(0))


def merge_parts(parts: DataFrame, key: str) -> DataFrame:
    """Join the ordered parts (start, end, index, text) of a key; words said twice in overlapping audio come once."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "index", "end", F.trim(F.coalesce("text", F.lit(""))).alias("text")))).alias("p"))
    rows = rows.withColumn("p", F.filter("p", lambda x: x["text"] != ""))
    start = F.struct(F.lit("").alias("text"), F.lit(float("-inf")).alias("end"), F.lit(0).alias("removed"))

    def step(acc: Column, x: Column) -> Column:
        overlap = acc["end"] - x["start"]
        most = F.least(F.lit(lexicon.OVERLAP_WORDS), F.greatest(F.lit(2), (F.floor(F.greatest(overlap, F.lit(0.0)) * lexicon.WORDS_PER_SECOND) + 1).cast("int")))
        k = F.when(overlap > 0, shared_words(acc["text"], x["text"], most)).otherwise(F.lit(0))
        ws = F.split(x["text"], r"\s+")
        rest = F.array_join(F.slice(ws, k + 1, F.greatest(F.size(ws) - k, F.lit(0))), " ")
        return F.struct(F.trim(F.concat_ws(" ", F.nullif(acc["text"], F.lit("")), F.nullif(rest, F.lit("")))).alias("text"), F.greatest(acc["end"], x["end"]).alias("end"), (acc["removed"] + k).alias("removed"))

    merged = rows.select(key, F.aggregate("p", start, step).alias("m"))
    return merged.select(key, F.col("m.text").alias("text"), F.col("m.removed").alias("n_words_removed"))
