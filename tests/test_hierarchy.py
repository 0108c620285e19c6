"""Hierarchies against a brute-force walk, in both the co-located and the distributed way."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from evigraph.operators import hierarchy as H

EDGE = "relationship_type string, subject_person_id string, subject_role string, object_person_id string, object_role string"


def brute(edges):
    """All rows from the definition: reachability by closure, chains by recursion."""
    edges = set(edges)
    nodes = {x for e in edges for x in e}
    kids = {n: {c for p, c in edges if p == n} for n in nodes}

    def reach(n):
        seen, todo = set(), list(kids[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids[x]
        return seen

    ring = {n for n in nodes if n in reach(n)}
    below = {x for r in ring for x in reach(r)} - ring
    out = {(n, "", -1, "") for n in ring} | {(n, "", -2, "") for n in below}

    def walk(n, root, path):
        out.add((n, root, len(path) - 1, "/".join(path)))
        for k in kids[n] - ring - below:
            walk(k, root, [*path, k])

    for n in nodes - {c for _, c in edges}:
        walk(n, n, [n])
    return sorted(out)


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "parent string, child string")


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(24)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(18 + 4 * seed)}
    want = brute(edges)
    assert rows(H.chains(H.hierarchy(frame(spark, edges)))) == want
    if seed < 2:
        assert rows(H.chains(H.hierarchy(frame(spark, edges), max_edges=0))) == want


def test_edges_are_oriented_by_role_and_counted_once(spark):
    df = spark.createDataFrame(
        [
            ("parent_child", "a", "parent", "b", "child"),
            ("parent_child", "b", "child", "a", "parent"),
            ("parent_child", "b", None, "c", None),
            ("parent_child", None, "parent", "c", "child"),
            ("spouse", "a", "spouse", "x", "spouse"),
            ("parent_child", "c", "parent", None, None),
        ],
        EDGE,
    ).withColumn("parent", F.lit("clash"))
    assert rows(H.parent_edges(df)) == [("a", "b"), ("b", "c")]


def test_empty_table(spark):
    assert rows(H.chains(H.hierarchy(frame(spark, [])))) == []


def test_self_edge_and_long_chain(spark):
    chain = [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(300)]
    got = {r[0]: r[1:] for r in rows(H.chains(H.hierarchy(frame(spark, [*chain, ("s", "s"), ("s", "t")]))))}
    assert got["s"] == ("", -1, "") and got["t"] == ("", -2, "")
    assert got["p0300"][1] == 300 and got["p0300"][2].count("/") == 300


def test_descendants_and_rings(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("x", "z"), ("s", "s")]
    for most in (H.MAX_EDGES, 0):
        assert rows(H.all_descendants(frame(spark, edges), most)) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("x", "y", 1), ("x", "z", 1), ("y", "x", 1), ("y", "z", 2)]
    assert rows(H.rings(H.hierarchy(frame(spark, edges))), "first_person_id", "n_members", "members") == [("s", 1, "s"), ("x", 2, "x,y")]


def test_descendants_match_in_both_ways(spark):
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(34)}
    assert rows(H.all_descendants(frame(spark, edges))) == rows(H.all_descendants(frame(spark, edges), 0))


def test_two_rings_of_one_large_component_stay_two(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "x"), ("y", "z"), ("r", "m"), ("r", "q"), ("q", "w")]
    for most in (H.MAX_EDGES, 1):
        walked = H.hierarchy(frame(spark, edges), max_edges=most)
        assert rows(H.chains(walked)) == brute(edges)
        assert rows(H.rings(walked), "first_person_id", "members") == [("a", "a,b"), ("x", "x,y")]


def test_rings_inside_rings_and_couples_in_a_large_component(spark):
    """Chords, couples of which one parent is new, and a lattice below a ring."""
    edges = {(f"s{i:02d}", f"s{i + 1:02d}") for i in range(12)} | {(f"m{i:02d}", f"s{i + 1:02d}") for i in range(12)}
    edges |= {(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)} | {("r2", "r0"), ("s03", "k"), ("r5", "k"), ("k", "t"), ("t", "u"), ("u", "t"), ("u", "v")}
    edges |= {("r6", "l0"), ("r6", "j0")} | {(f"{a}{i}", f"{b}{i + 1}") for i in range(3) for a in "lj" for b in "lj"}
    walked = H.hierarchy(frame(spark, edges), max_edges=1)
    assert rows(H.chains(walked)) == brute(edges)
    assert rows(H.rings(walked), "first_person_id", "n_members") == [("r0", 7), ("t", 2)]


def test_deep_chain_of_a_large_component_takes_few_rounds(spark):
    n = 3000
    edges = [(f"p{i:05d}", f"p{i + 1:05d}") for i in range(n)] + [(f"p{n:05d}", "z0")] + [(f"z{i}", f"z{i + 1}") for i in range(500)] + [("z500", "z400")]
    walked = H.hierarchy(frame(spark, edges), max_edges=10, paths=False)
    got = {r["person_id"]: (r["root_person_id"], r["depth"]) for r in walked.collect()}
    assert got[f"p{n:05d}"] == ("p00000", n) and got["z300"] == ("p00000", n + 301)
    assert got["z400"] == got["z500"] == ("", -1) and sum(d == -1 for _, d in got.values()) == 101


def test_components(spark):
    edges = [(f"{c}{i}", f"{c}{i + 1}") for c in "abc" for i in range(20)]
    got = rows(H.connected_components(spark.createDataFrame(edges, "u string, v string")))
    assert len(got) == 63 and {x for _, x in got} == {"a0", "b0", "c0"}
    assert all(n[0] == c[0] for n, c in got)
