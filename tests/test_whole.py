"""Whole jobs: what queries over the tables must not leave out."""

import os

import pytest
from conftest import rows

from evigraph.operators import ledger
from evigraph.plans import text_queries

EDGE = "edge_id string, family_id string, relationship_type string, subject_person_id string, subject_role string, object_person_id string, object_role string, source_claim_ids array<string>, created_at timestamp"


def edges(spark, *rows_):
    return spark.createDataFrame([(f"e{i}", "f", *r, None) for i, r in enumerate(rows_)], EDGE)


@pytest.fixture
def table(spark, tmp_path):
    """A function that writes one table of a small data folder, and the folder."""

    def write(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_dates_of_every_statement(spark, table):
    texts = ["9 мая. После войны. В конце восьмидесятых. Просто так.", "слово " * 60 + "в 1937 году", "x" * 400, "", None]
    sf = table("documents", list(enumerate(texts)), "doc_id long, text string")
    got = rows(text_queries.temporal_parse(spark, sf), "doc_id", "pos", "kind")
    assert got == [(0, 0, "relative"), (0, 1, "relative"), (0, 2, "decade"), (0, 3, "unknown"), (1, 0, "year"), (2, 0, "unknown")]


def test_parents_without_roles(spark):
    people = spark.createDataFrame([("f", (p,)) for p in "abcd"], "family_id string, person struct<person_id:string>")
    e = edges(spark, ("parent_child", "a", None, "b", None, []), ("parent_child", "b", "child", "c", "parent", []), ("spouse", "a", None, "c", None, []), ("sibling", "b", None, None, None, []), ("friend", "a", None, "d", None, []))
    assert rows(ledger.adjacency(people, e)) == [("f", "a", "", "b", "c", ""), ("f", "b", "a,c", "", "", ""), ("f", "c", "", "b", "a", ""), ("f", "d", "", "", "", "")]


def test_edges_without_claims_stay(spark):
    stated = ("parent_child", "a", "parent", "b", "child", ["c1", None])
    e = edges(spark, stated, ("spouse", "b", "spouse", "a", "spouse", None), ("sibling", "a", None, "c", None, []), ("sibling", "c", None, "a", None, ["c2"]), ("spouse", "a", None, None, None, None))
    assert rows(ledger.graph(e), "relationship_type", "subject", "object", "n_claims", "claims") == [("parent_child", "a", "b", 1, "c1"), ("sibling", "a", "c", 1, "c2"), ("spouse", "a", "b", 0, "")]
    digest = lambda e: ledger.digest(ledger.graph(e), ["relationship_type", "subject", "object", "claims"]).first()
    assert digest(edges(spark, stated)) != digest(edges(spark, stated, ("spouse", "b", None, "c", None, None)))


def test_each_the_others_parent_is_a_conflict(spark):
    e = edges(spark, ("parent_child", "a", None, "b", None, []), ("parent_child", "a", "child", "b", "parent", []), ("parent_child", "c", "parent", "d", "child", []), ("parent_child", "d", "child", "c", "parent", []), ("parent_child", "c", None, "d", None, []), ("sibling", "e", "older_sibling", "f", "younger_sibling", []), ("sibling", "e", "younger_sibling", "f", "older_sibling", []), ("spouse", "g", None, "h", None, []), ("spouse", "h", "spouse", "g", "spouse", []))
    assert rows(ledger.pair_conflicts(e), "first_id", "second_id", "n_types", "types", "n_edges") == [("a", "b", 1, "parent_child", 2), ("e", "f", 1, "sibling", 2)]
