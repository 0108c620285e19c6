"""Parent-child rows to full hierarchies: chains, depths, roots, descendants and rings.

Plan: connected components by alternating large-star / small-star rounds, then each component is co-located and
walked by an iterative depth-first traversal with node colours. Components with more edges than ``max_edges`` are never
put into one task: chains are contracted and joined end to end by doubling, and rings are found by labels that spread along the
edges, with the same rows.

Defined results: rows with a null end are ignored; repeated edges count once; an empty table gives an empty result;
a self edge makes its person a ring of one; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import discard, materialize

#: Edges that one task may hold at once.
MAX_EDGES = 100_000
RING, BELOW_RING = -1, -2

CHAINS = "person_id string, root_person_id string, depth int, path string"


def is_flipped() -> Column:
    """Whether the object of an edge is the parent: it has that role and the subject has not."""
    return F.coalesce(F.col("object_role") == "parent", F.lit(False)) & ~F.coalesce(F.col("subject_role") == "parent", F.lit(False))


def parent_of() -> Column:
    """The parent of a ``parent_child`` edge."""
    return F.when(is_flipped(), F.col("object_person_id")).otherwise(F.col("subject_person_id"))


def parent_edges(edges: DataFrame) -> DataFrame:
    """(parent, child) of the ``parent_child`` rows that have both ends, each edge once.

    The parent is the end whose role is ``parent``; without such a role it is the subject.
    """
    both = (F.col("relationship_type") == "parent_child") & F.col("subject_person_id").isNotNull() & F.col("object_person_id").isNotNull()
    return (
        edges.where(both)
        .select(
            parent_of().alias("parent"),
            F.when(is_flipped(), F.col("subject_person_id")).otherwise(F.col("object_person_id")).alias("child"),
        )
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as columns ``u`` and ``v``; the component is its least node.

    Alternates large-star and small-star rounds until the edge set stands still. Each round is two aggregations, which
    combine before the shuffle, and two joins of a one-row-per-key side, so a hub's edges may be split by AQE.
    """
    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = cur.where("u <> v").select("u", "v").union(cur.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(cur.where("u = v").select("u", "v"))
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        nxt = materialize(small.distinct(), n=F.count(F.lit(1)), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        discard(cur)
        cur = nxt
        now = (cur.metrics["n"], cur.metrics["h"])
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v"), F.col("v")))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))


def strong_components(kids: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components by one depth-first traversal with an explicit stack.

    White nodes have no number yet, grey ones are open, black ones closed; an edge to a grey node closes a ring.
    """
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    grey: set[str] = set()
    out = []
    for start in sorted(kids):
        if start in number:
            continue
        number[start] = low[start] = len(number)
        open_.append(start)
        grey.add(start)
        work = [(start, iter(kids[start]))]
        while work:
            node, rest = work[-1]
            for k in rest:
                if k not in number:
                    number[k] = low[k] = len(number)
                    open_.append(k)
                    grey.add(k)
                    work.append((k, iter(kids[k])))
                    break
                if k in grey:
                    low[node] = min(low[node], number[k])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while True:
                        x = open_.pop()
                        grey.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    out.append(group)
    return out


def _kids_of(edges: list[tuple[str, str]]) -> dict[str, list[str]]:
    """The children of every person of a component in order, self edges left out."""
    kids: dict[str, list[str]] = {}
    for p, c in sorted(set(edges)):
        kids.setdefault(p, [])
        kids.setdefault(c, [])
        if p != c:
            kids[p].append(c)
    return kids


def walk_component(edges: list[tuple[str, str]]) -> Iterator[tuple[str, str, int, str, str]]:
    """(person, root, depth, path, ring) rows of one component; a ring is named by its least member, other rows have ''."""
    kids = _kids_of(edges)
    has_parent = {c for _, c in edges}
    loops = {p for p, c in edges if p == c}
    ring: dict[str, str] = {}
    for group in strong_components(kids):
        if len(group) > 1 or group[0] in loops:
            ring |= dict.fromkeys(group, min(group))
    below = set()
    todo = list(ring)
    while todo:
        for k in kids[todo.pop()]:
            if k not in ring and k not in below:
                below.add(k)
                todo.append(k)
    for x in sorted(ring):
        yield x, "", RING, "", ring[x]
    for x in sorted(below):
        yield x, "", BELOW_RING, "", ""
    for root in sorted(k for k in kids if k not in has_parent):
        stack = [(root, 0, root)]
        while stack:
            node, depth, path = stack.pop()
            yield node, root, depth, path, ""
            for k in reversed(kids[node]):
                if k not in ring and k not in below:
                    stack.append((k, depth + 1, f"{path}/{k}"))


def below_component(edges: list[tuple[str, str]]) -> Iterator[tuple[str, str, int]]:
    """(ancestor, descendant, distance) of one component, rings included; nobody is their own descendant."""
    kids = _kids_of(edges)
    for start in sorted(kids):
        seen = {start}
        front, n = [start], 0
        while front:
            n += 1
            nxt = []
            for x in front:
                for k in kids[x]:
                    if k not in seen:
                        seen.add(k)
                        nxt.append(k)
                        yield start, k, n
            front = nxt


WALK = "component string, person_id string, root_person_id string, depth int, path string, ring string"
_WALK = pa.schema([("component", pa.string()), ("person_id", pa.string()), ("root_person_id", pa.string()), ("depth", pa.int32()), ("path", pa.string()), ("ring", pa.string())])
BELOW = "component string, ancestor_id string, descendant_id string, distance int"
_BELOW = pa.schema([("component", pa.string()), ("ancestor_id", pa.string()), ("descendant_id", pa.string()), ("distance", pa.int32())])


def _by_component(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Components arrive in order of their key; only one is held at a time, and its rows leave in small batches."""
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        return batch

    def flush(component: str, edges: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        for r in make(edges):
            rows.append((component, *r))
            if len(rows) >= 20_000:
                yield out()

    key, edges = None, []
    for b in batches:
        for k, p, c in zip(*(b.column(n).to_pylist() for n in ("component", "parent", "child")), strict=True):
            if k != key:
                if edges:
                    yield from flush(key, edges)
                key, edges = k, []
            edges.append((p, c))
    if edges:
        yield from flush(key, edges)
    if rows:
        yield out()


def _parted(edges: DataFrame, max_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """(component, parent, child) of the components that one task may hold, and of the larger ones, if there are any."""
    edges = materialize(edges.select("parent", "child").where("parent is not null and child is not null").distinct())
    comps = connected_components(edges.select(F.col("parent").alias("u"), F.col("child").alias("v")))
    tagged = materialize(edges.join(comps, edges["child"] == comps["node"]).select("component", "parent", "child"))
    discard(edges)
    sizes = tagged.groupBy("component").count().where(F.col("count") > max_edges).select("component")
    if sizes.limit(1).count() == 0:
        return tagged, None
    return tagged.join(sizes, "component", "left_anti"), materialize(tagged.join(sizes, "component", "left_semi"))


def _co_located(tagged: DataFrame, make, schema: pa.Schema, ddl: str) -> DataFrame:
    return tagged.repartition("component").sortWithinPartitions("component").mapInArrow(partial(_by_component, make=make, schema=schema), ddl)


def hierarchy(edges: DataFrame, max_edges: int = MAX_EDGES, paths: bool = True) -> DataFrame:
    """All chains of (parent, child) edges: component, person_id, root_person_id, depth, path, ring.

    A person on a ring has the one row depth -1, a person below a ring the one row depth -2, both with empty root and path.
    ``max_edges`` bounds what a task holds, not what it writes: a component has as many rows as chains, and their paths are as
    long as the chains. Without ``paths`` the components above ``max_edges`` leave the path empty, so that a chain of n edges
    does not cost n * n.
    """
    small, giants = _parted(edges, max_edges)
    walked = _co_located(small, walk_component, _WALK, WALK)
    return walked if giants is None else walked.unionByName(_distributed(giants, paths))


def all_descendants(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of (parent, child) edges, each pair at its least distance.

    Persons on rings have descendants like any other, the other members of their ring among them.
    """
    small, giants = _parted(edges, max_edges)
    found = _co_located(small, below_component, _BELOW, BELOW).drop("component")
    return found if giants is None else found.unionByName(_distributed_below(giants))


def _followed(links: DataFrame) -> DataFrame:
    """(node, top) of functional links (node, up): the last node that each one leads to; null where the links never end.

    Links are doubled in every round, so a chain of n takes about log2(n) of them.
    """
    far = materialize(links.select("node", F.col("up").alias("top")), n=F.count(F.lit(1)))
    total = moving = far.metrics["n"]
    length = 1
    # a chain has at most ``total`` links; one round more tells those that have ended from those that never do
    while moving and length <= 2 * total:
        at = far.select(F.col("node").alias("at"), F.col("top").alias("on"))
        nxt = materialize(far.join(at, far["top"] == at["at"], "left").select("node", F.coalesce("on", "top").alias("top"), F.col("on").isNotNull().alias("moved")), n=F.count_if("moved"))
        discard(far)
        moving, length = nxt.metrics["n"], 2 * length
        far = nxt
    return far.select("node", F.when(~F.col("moved"), F.col("top")).alias("top")) if total else far


def _tainted(edges: DataFrame) -> DataFrame:
    """Nodes (column node) that some ring leads to or that are on one, for edges (parent, child).

    A node with one parent has that parent's fate, so chains are first contracted to their top by doubled links; a top without
    parents is clean and its edges go; a node with an edge from its own chain, or from a tainted node, keeps a self edge, which
    marks it as tainted. What remains are nodes with several unsettled parents, and the same is done to them. The number of
    rounds is the depth of couples both of whose parents are unsettled, not the depth of the tree.
    """
    rest = materialize(edges.select("parent", "child").distinct(), n=F.count(F.lit(1)))
    fate = materialize(edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct().select("node", F.col("node").alias("rep"), F.lit(False).alias("hit")))
    while rest.metrics["n"]:
        parents = rest.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up"))
        top = _followed(parents.where("n = 1").select(F.col("child").alias("node"), "up"))
        top = top.select(F.col("node").alias("at"), "top")
        nxt = materialize(fate.join(top, fate["rep"] == top["at"], "left").select("node", F.coalesce("top", "rep").alias("rep"), (F.col("hit") | (F.col("at").isNotNull() & F.col("top").isNull())).alias("hit")))
        discard(fate)
        fate = nxt
        many = parents.where("n > 1").select("child")
        moved = rest.join(many, "child", "left_semi").join(top, F.col("parent") == F.col("at"), "left").select("child", F.coalesce("top", "parent").alias("parent"), (F.col("at").isNotNull() & F.col("top").isNull()).alias("hit"))
        moved = materialize(moved.select("child", "parent", (F.col("hit") | (F.col("parent") == F.col("child"))).alias("hit")).distinct())
        bad = moved.where("hit").select("child").distinct()
        still = moved.join(bad, "child", "left_anti").join(many.withColumnRenamed("child", "m"), F.col("parent") == F.col("m"), "left_semi").select("parent", "child")
        nxt = materialize(still.union(bad.select(F.col("child").alias("parent"), "child")).distinct(), n=F.count(F.lit(1)))
        discard(rest)
        rest = nxt
    return fate.where("hit").select("node")


def _greatest_reaching(edges: DataFrame, src: str, dst: str, seed: int) -> DataFrame:
    """(node, label): the node of greatest hash that reaches each node over ``edges`` from ``src`` to ``dst``.

    Labels move along the edges and, in the same round, each node takes over the label of its label: whatever reaches that node
    reaches it as well. Hashes are fresh for every ``seed``, so the rounds grow with the logarithm of the distance.
    """
    label = F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), F.col("node").alias("k"))
    cur = materialize(edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).distinct().select("node", label.alias("label")))
    while True:
        along = edges.join(cur, edges[src] == cur["node"]).groupBy(F.col(dst).alias("to")).agg(F.max("label").alias("a"))
        over = cur.select(F.col("node").alias("at"), F.col("label").alias("b"))
        nxt = cur.join(along, cur["node"] == along["to"], "left").join(over, F.col("label.k") == F.col("at"), "left")
        best = F.greatest("label", F.coalesce("a", "label"), F.coalesce("b", "label"))
        nxt = materialize(nxt.select("node", best.alias("label"), (best > F.col("label")).alias("moved")), n=F.count_if("moved"))
        discard(cur)
        cur = nxt.select("node", "label")
        cur._evigraph_path = nxt._evigraph_path
        if not nxt.metrics["n"]:
            return cur


def _rings(edges: DataFrame, tainted: DataFrame | None = None) -> DataFrame:
    """(node, ring) of all nodes on rings; a ring is named by its least member.

    Only nodes that a ring leads to and that lead to a ring can be on one. Among them two nodes of one ring have the same
    greatest node that reaches them and the same greatest that they reach; where both are one node, that node's ring is found.
    The rest goes on with the edges inside groups of equal labels and fresh hashes.
    """
    out = edges.select(F.col("parent").alias("node"), F.col("parent").alias("ring")).limit(0)
    rest, seed = edges.select("parent", "child"), 0
    while True:
        rest = _between(rest, tainted if tainted is not None else _tainted(rest))
        rest = materialize(_between(rest, _tainted(rest.select(F.col("child").alias("parent"), F.col("parent").alias("child")))).distinct(), n=F.count(F.lit(1)))
        tainted = None
        if not rest.metrics["n"]:
            return out
        seed += 1
        above = _greatest_reaching(rest, "parent", "child", seed).select("node", F.col("label.k").alias("a"))
        below = _greatest_reaching(rest, "child", "parent", seed).select("node", F.col("label.k").alias("d"))
        both = materialize(above.join(below, "node"))
        loops = rest.where("parent = child").select(F.col("parent").alias("node"), F.lit(True).alias("loop")).distinct()
        members = both.where("a = d").join(loops, "node", "left")
        whole = members.groupBy(F.col("a").alias("key")).agg(F.min("node").alias("ring"), ((F.count(F.lit(1)) > 1) | F.coalesce(F.max("loop"), F.lit(False))).alias("is_ring")).where("is_ring")
        out = out.union(materialize(members.join(whole, members["a"] == whole["key"]).select("node", "ring")))
        left = both.where("a <> d")
        ends = left.select(F.col("node").alias("child"), F.col("a").alias("a2"), F.col("d").alias("d2"))
        rest = materialize(rest.join(left, rest["parent"] == left["node"]).join(ends, "child").where("a = a2 and d = d2").select("parent", "child"), n=F.count(F.lit(1)))
        if not rest.metrics["n"]:
            return out


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among ``nodes``."""
    return edges.join(nodes, edges["parent"] == nodes["node"], "left_semi").join(nodes, F.col("child") == nodes["node"], "left_semi").select("parent", "child")


def _distributed(tagged: DataFrame, paths: bool = True) -> DataFrame:
    """The rows of ``walk_component`` for components of any size: chains are joined end to end, twice as long in each round."""
    edges = tagged.select("component", "parent", "child")
    tainted = materialize(_tainted(edges))
    rings = materialize(_rings(edges, tainted))
    nodes = edges.select("component", F.col("parent").alias("node")).union(edges.select("component", "child")).distinct()
    empty = F.lit("")
    ring_rows = nodes.join(rings, "node").select("component", F.col("node").alias("person_id"), empty.alias("root_person_id"), F.lit(RING).alias("depth"), empty.alias("path"), "ring")
    below = nodes.join(tainted, "node", "left_semi").join(rings.select("node"), "node", "left_anti")
    below_rows = below.select("component", F.col("node").alias("person_id"), empty.alias("root_person_id"), F.lit(BELOW_RING).alias("depth"), empty.alias("path"), empty.alias("ring"))
    roots = nodes.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    tail = F.col("child") if paths else empty
    at_root = roots.select(F.col("node").alias("r"))
    clean = edges.join(tainted, edges["child"] == tainted["node"], "left_anti").select("component", F.col("child").alias("node"), F.col("parent").alias("top"), F.lit(1).alias("steps"), tail.alias("tail"))
    parts = materialize(clean.join(at_root, clean["top"] == at_root["r"], "left").select(*clean.columns, F.col("r").isNull().alias("open")), n=F.count_if("open"))
    while parts.metrics["n"]:
        upper = parts.select(F.col("node").alias("at"), F.col("top").alias("on"), F.col("steps").alias("more"), F.col("tail").alias("head"), F.col("open").alias("further"))
        lower = parts.where("open")
        longer = lower.join(upper, lower["top"] == upper["at"]).select("component", "node", F.col("on").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), (F.concat_ws("/", "head", "tail") if paths else empty).alias("tail"), F.col("further").alias("open"))
        nxt = materialize(parts.where("not open").unionByName(longer), n=F.count_if("open"))
        discard(parts)
        parts = nxt
    path = F.concat_ws("/", "top", "tail") if paths else empty
    chain_rows = parts.select("component", F.col("node").alias("person_id"), F.col("top").alias("root_person_id"), F.col("steps").alias("depth"), path.alias("path"), empty.alias("ring"))
    root_rows = roots.select("component", F.col("node").alias("person_id"), F.col("node").alias("root_person_id"), F.lit(0).alias("depth"), (F.col("node") if paths else empty).alias("path"), empty.alias("ring"))
    return ring_rows.unionByName(below_rows).unionByName(root_rows).unionByName(chain_rows)


def _distributed_below(tagged: DataFrame) -> DataFrame:
    """The rows of ``below_component`` for components of any size; the distance covered doubles in each round."""
    steps = materialize(tagged.where("parent <> child").select(F.col("parent").alias("ancestor_id"), F.col("child").alias("descendant_id")).distinct())
    out = materialize(steps.select("ancestor_id", "descendant_id", F.lit(1).alias("distance")), n=F.count(F.lit(1)))
    span, before = 1, 0
    while out.metrics["n"] > before:
        before = out.metrics["n"]
        on = steps.select(F.col("ancestor_id").alias("x"), F.col("descendant_id").alias("y"))
        # out has all pairs up to ``span`` steps, steps those that some walk of exactly ``span`` joins
        far = out.join(on, out["descendant_id"] == on["x"]).select("ancestor_id", F.col("y").alias("descendant_id"), (F.col("distance") + span).alias("distance"))
        both = out.union(far).where("ancestor_id <> descendant_id").groupBy("ancestor_id", "descendant_id").agg(F.min("distance").alias("distance"))
        nxt = materialize(both, n=F.count(F.lit(1)))
        longer = materialize(steps.alias("a").join(steps.alias("b"), F.col("a.descendant_id") == F.col("b.ancestor_id")).select("a.ancestor_id", "b.descendant_id").distinct())
        discard(out)
        discard(steps)
        out, steps, span = nxt, longer, 2 * span
    return out


def chains(walked: DataFrame) -> DataFrame:
    """person_id, root_person_id, depth, path of every chain, each once."""
    return walked.select("person_id", "root_person_id", "depth", "path")


def rings(walked: DataFrame) -> DataFrame:
    """One row for each ring: its component, its least member, its size and its members joined by commas."""
    members = walked.where(F.col("depth") == RING).groupBy("component", "ring").agg(F.array_sort(F.collect_set("person_id")).alias("m"))
    return members.select("component", F.col("ring").alias("first_person_id"), F.size("m").cast("long").alias("n_members"), F.array_join("m", ",").alias("members"))
