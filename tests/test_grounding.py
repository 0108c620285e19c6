import json

import pytest
from conftest import rows

from evigraph.operators import grounding as G

A, B, C = ({"mention_id": i, "name": n, "source_segment_ids": None} for i, n in (("a", "Анна"), ("b", "Болат"), ("c", "Вера")))


@pytest.mark.parametrize(("text", "want"), [
    ("Анна и Болат поженились в 1950 году.", [("spouse", "a", "b", "pair.couple")]),
    ("Супруги Анна и Болат жили там.", [("spouse", "a", "b", "pair.couple")]),
    ("Болат женился на Анне.", [("spouse", "a", "b", "pair.direct")]),
    ("Анна мен Болат үйленді.", [("spouse", "a", "b", "pair.couple")]),
    ("Анна и Болат — брат и сестра.", [("sibling", "a", "b", "pair.sibling")]),
    ("Анна и Болат двоюродные, как брат и сестра.", []), ("Анна и Болат не поженились.", []), ("Анна и Болат, бывшие супруги, женаты были.", []),
    ("Анна, Болат и Вера поженились.", []), ("Анна и Болат жили. Они поженились.", []), ("Анна поженились Болат.", []), ("", []),
])
def test_pairs(text, want):
    assert G.pair_signals(text, [A, B, C]) == want


def test_decisions_and_classes(spark):
    claims = spark.createDataFrame([("r", "1", "spouse", "a", "b"), ("r", "2", "sibling", "b", "a"), ("r", "3", "spouse", "a", "c"), ("q", "4", "spouse", "a", "b")], "record string, relationship_id string, relationship_type string, subject string, object string")
    told = spark.createDataFrame([("r", "spouse", "b", "a")], "record string, relationship_type string, subject string, object string")
    assert rows(G.claim_decisions(claims, told), "relationship_id", "decision") == [("1", "supported"), ("2", "contradicted"), ("3", "insufficient"), ("4", "insufficient")]
    people = spark.createDataFrame([("r", "x", "X"), ("r", "y", "Y"), ("r", "s", "S"), ("r", "z", None), ("q", "s", "S")], "record string, mention_id string, name string")
    seen = spark.createDataFrame([("r", "x", "exact"), ("r", "x", "case"), ("r", "y", "genitive")], "record string, mention_id string, form string")
    got = rows(G.mention_classes(people, seen, spark.createDataFrame([("r",), ("r",)], "record string"), spark.createDataFrame([("r", "S"), ("q", "S")], "record string, speaker string")), "record", "mention_id", "evidence_class")
    assert got == [("q", "s", "E_inferred"), ("r", "s", "C_speaker_anchored"), ("r", "x", "A_explicit"), ("r", "y", "B_morphologically_explicit"), ("r", "z", "E_inferred")]


def test_passes_merge_by_kind(spark):
    data = [("r", "p", 2, {"name": " Anna "}), ("r", "p", 1, {"name": "anna"}), ("r", "p", 1, {"name": "Bob"}), ("r", "e", 1, {"t": "x"}), ("r", "e", 3, {"t": "x", "u": "y"}), ("r", "other", 1, {})]
    df = spark.createDataFrame([(a, b, c, json.dumps(d)) for a, b, c, d in data], "record string, kind string, pass_order int, payload string")
    got = rows(G.merge_passes(df, {"p": ["name"], "e": ["t", "u"]}), "kind", "key", "pass_order", "n_dropped")
    assert got == [("e", "x\x1f", 1, 0), ("e", "x\x1fy", 3, 0), ("p", "anna", 1, 1), ("p", "bob", 1, 0)]
