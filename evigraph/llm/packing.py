"""Filling containers of fixed capacity by cost-balanced packing.

The cost of a document in a sequence is estimated as ``linear * n + quadratic * n ** 2`` (tokens and attention within the
document). Documents are taken in descending size, each goes to the sequence of lowest cost that has room for it. A
document over the capacity is cut at multiples of the capacity: its full pieces are containers of their own, only the
rest takes part. Documents are dealt by the hash of their key into shards of bounded size that are packed independently, so
no task holds more than about ``SHARD_ITEMS`` items, whatever key or size is frequent.

Defined results: empty and null texts have one row with no container; equal sizes are taken in order of their keys; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import materialize

#: Items packed together in one task.
SHARD_ITEMS = 40_000
LINEAR, QUADRATIC = 1.0, 1 / 512

PACKED = "budget_id string, capacity int, container_id string, doc_id bigint, piece int, start_token bigint, n_tokens bigint, cost double"


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


class _Sequences:
    """Open sequences by room left; finds the one of lowest cost that has at least a given room."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.best: list[tuple[float, int] | None] = [None] * (2 * self.width)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]

    def _update(self, room: int) -> None:
        best, i = self.best, room + self.width
        best[i] = self.heaps[room][0] if self.heaps[room] else None
        i >>= 1
        while i:
            a, b = best[2 * i], best[2 * i + 1]
            new = b if a is None else a if b is None or a <= b else b
            if best[i] == new:
                break
            best[i] = new
            i >>= 1

    def add(self, room: int, cost_: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost_, sequence))
        if self.heaps[room][0] == (cost_, sequence):
            self._update(room)

    def take(self, room: int, rooms: list[int]) -> tuple[float, int] | None:
        """Remove and give the cheapest sequence with at least ``room`` left; ``rooms`` has each sequence's room."""
        best, found = self.best, None
        lo, hi = room + self.width, 2 * self.width
        while lo < hi:
            if lo & 1:
                if best[lo] is not None and (found is None or best[lo] < found):
                    found = best[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                if best[hi] is not None and (found is None or best[hi] < found):
                    found = best[hi]
            lo >>= 1
            hi >>= 1
        if found is not None:
            r = rooms[found[1]]
            heapq.heappop(self.heaps[r])
            self._update(r)
        return found


def pack(sizes: Sequence[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[int]:
    """The sequence number of each item; ``sizes`` descends and none exceeds ``capacity``.

    Starts with as many sequences as the sum of the sizes needs at least; an item that fits nowhere opens another.
    """
    n = -(-sum(sizes) // capacity)
    rooms = [capacity] * n
    open_ = _Sequences(capacity)
    for i in range(n):
        open_.add(capacity, 0.0, i)
    out = []
    for s in sizes:
        found = open_.take(s, rooms)
        if found is None:
            found = (0.0, len(rooms))
            rooms.append(capacity)
        c, i = found
        rooms[i] -= s
        open_.add(rooms[i], c + cost(s, linear, quadratic), i)
        out.append(i)
    return out


def _pack_shards(batches: Iterator[pa.RecordBatch], linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    """Shards arrive one after the other, each with its items in descending size."""
    schema = pa.schema([("budget_id", pa.string()), ("capacity", pa.int32()), ("container_id", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("cost", pa.float64())])

    def flush(key: tuple, docs: list, pieces: list, starts: list, sizes: list) -> pa.RecordBatch:
        budget, capacity, shard = key
        where = pack(sizes, capacity, linear, quadratic)
        n = len(docs)
        return pa.RecordBatch.from_arrays(
            [pa.array([budget] * n), pa.array([capacity] * n, pa.int32()), pa.array([f"{budget}-{shard}-{w}" for w in where]), pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([cost(s, linear, quadratic) for s in sizes])],
            schema=schema,
        )

    key, held = None, ([], [], [], [])
    for b in batches:
        columns = [b.column(n).to_pylist() for n in ("budget_id", "capacity", "shard", "doc_id", "piece", "start_token", "n_tokens")]
        for budget, capacity, shard, *item in zip(*columns, strict=True):
            if key != (budget, capacity, shard):
                if held[0]:
                    yield flush(key, *held)
                key, held = (budget, capacity, shard), ([], [], [], [])
            for values, x in zip(held, item, strict=True):
                values.append(x)
    if held[0]:
        yield flush(key, *held)


def budget_rows(budgets: DataFrame, limit: int = 1000) -> list[tuple]:
    """The rows of the small table of budgets that have a capacity; more than ``limit`` is an error, so what goes into the plan is bounded."""
    usable = budgets.where(F.col("max_tokens") > 0).select("budget_id", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens")).distinct()
    rows = [(r["budget_id"], r["max_tokens"], r["overlap_tokens"]) for r in usable.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} budgets")
    return sorted(rows)


def _each_budget(budgets: list[tuple]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(b).alias("budget_id"), F.lit(m).cast("int").alias("capacity")) for b, m, _ in budgets)))


def pack_documents(sizes: DataFrame, budgets: list[tuple], shard_items: int = SHARD_ITEMS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Where each piece of each document goes, for each budget. ``sizes``: doc_id, n_tokens."""
    if not budgets:
        return sizes.sparkSession.createDataFrame([], PACKED)
    sizes = materialize(sizes)
    shards = -(-sizes.count() // shard_items) or 1
    each = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size"), _each_budget(budgets).alias("b")).select("doc_id", "size", "b.*")
    each = each.withColumn("full", F.floor(F.col("size") / F.col("capacity")).cast("int"))
    price = F.lit(linear) * F.col("n_tokens") + F.lit(quadratic) * F.col("n_tokens") * F.col("n_tokens")
    full = (
        each.where("full > 0")
        .select("budget_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
        .select("budget_id", "capacity", F.concat_ws("-", "budget_id", F.lit("d"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", (F.col("piece").cast("bigint") * F.col("capacity")).alias("start_token"), F.col("capacity").cast("bigint").alias("n_tokens"))
        .withColumn("cost", price)
    )
    empty = each.where("size = 0").select("budget_id", "capacity", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0.0).alias("cost"))
    rest = each.withColumn("n_tokens", F.col("size") - F.col("full") * F.col("capacity")).where("n_tokens > 0")
    rest = rest.select("budget_id", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", F.col("full").alias("piece"), (F.col("full").cast("bigint") * F.col("capacity")).alias("start_token"), "n_tokens")
    packed = (
        rest.repartition(max(shards * len(budgets), 1), "budget_id", "shard")
        .sortWithinPartitions("budget_id", "shard", F.desc("n_tokens"), "doc_id", "piece")
        .mapInArrow(partial(_pack_shards, linear=linear, quadratic=quadratic), PACKED)
    )
    return packed.unionByName(full).unionByName(empty)


def fill(packed: DataFrame) -> DataFrame:
    """For each budget: documents, containers, tokens, unused tokens and the share of capacity that is used."""
    by = packed.where("container_id is not null").groupBy("budget_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"), F.sum("cost").alias("c"))
    out = by.groupBy("budget_id", "capacity").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), F.max("c").alias("dearest"))
    return out.withColumn("unused_tokens", F.col("n_containers") * F.col("capacity") - F.col("n_tokens")).withColumn("share_used", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
