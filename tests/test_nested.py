import json

from conftest import rows

from evigraph.operators import nested as N

LAYOUT = N.Layout("payload", N.ENTITIES, N.WRAPPERS)


def flat(document):
    return sorted(r[:4] for r in N.visit(document, "r1", LAYOUT))


def test_shapes_of_a_collection():
    one = {"mention_id": "m1", "name": "A"}
    want = [("people_mentions", "m1", "payload", "r1")]
    for shape in ([one], one, {"m1": one}, json.dumps([one]), [None, one, "x", 3]):
        assert flat({"people_mentions": shape}) == want
    for shape in (None, [], "", "not json", 7, {"k": {"name": "no id"}}):
        assert flat({"people_mentions": shape}) == []


def test_children_know_their_parent_and_fall_with_it():
    doc = {"result": {"extraction": json.dumps({"people_mentions": [{"mention_id": "m1", "name_variants": [{"variant_id": "v1"}]}, {"name_variants": [{"variant_id": "lost"}]}]})}}
    assert flat(doc) == [("name_variants", "v1", "people_mentions", "m1"), ("people_mentions", "m1", "payload", "r1")]


def test_deep_paths():
    doc = {"resolutions": [{"mention_id": "m", "trace": {"supporting_signals": [{"rule_id": "x"}]}}], "processing": {"passes": [{"pass_id": "p", "calls": [{"call_id": "c"}]}]}}
    assert flat(doc) == [("calls", "c", "passes", "p"), ("passes", "p", "payload", "r1"), ("resolutions", "m", "payload", "r1"), ("supporting_signals", "x", "resolutions", "m")]


def test_bad_documents_give_no_row(spark):
    data = [("a", None), ("b", ""), ("c", "{"), ("d", "[1]"), ("n", '{"events": [{"event_id": "x", "w": NaN}]}'), ("o", '{"events": ' + "[" * 100_000), ("e", '{"events": [{"event_id": "e1"}, {"event_id": ""}, {"event_id": null}]}'), ("e", '{"events": [{"event_id": "e1"}, {"event_id": ""}, {"event_id": null}]}'), (None, "{}")]
    df = spark.createDataFrame(data, "id string, doc string")
    out = N.flatten_records(df, "t", "id", "doc", LAYOUT)
    assert rows(out.distinct(), "record_id", "entity", "entity_id") == [("e", "events", "e1")]
    assert rows(N.flatten_records(df.limit(0), "t", "id", "doc", LAYOUT)) == []


def test_round_trip_through_partitioned_tables(spark, tmp_path):
    doc = json.dumps({"events": [{"event_id": "e1", "title": "t", "date": {"value": "1950", "kind": "year", "approximate": False}}], "stories": [{"story_id": "s1", "summary": "x"}]})
    tagged = N.flatten_records(spark.createDataFrame([("r", doc)], "id string, doc string"), "t", "id", "doc", LAYOUT)
    N.write_tables(tagged, str(tmp_path / "t"))
    e = N.read_table(spark, str(tmp_path / "t"), "events").collect()
    assert len(e) == 1 and e[0]["title"] == "t" and e[0]["date"]["value"] == "1950" and e[0]["parent_id"] == "r"
    assert N.read_table(spark, str(tmp_path / "t"), "calls").count() == 0


def test_nothing_is_lost(spark):
    """Collections where they are no table, unknown wrappers, and what stands beside the tables."""
    doc = {
        "speaker": "x", "stories": [{"story_id": "s", "events": [{"event_id": "e"}], "passes": [{"pass_id": "p"}]}],
        "unknown": {"deep": {"people_mentions": [{"mention_id": "m", "name": "n"}], "note": 1}}, "loose": [1, {"a": 2}],
    }
    got = list(N.visit(doc, "r", N.Layout("root", N.ENTITIES, N.WRAPPERS)))
    by = {e: (i, p, k, json.loads(x)) for e, i, p, k, x in got}
    assert set(by) == {"stories", "people_mentions", "rest"} and by["people_mentions"][:3] == ("m", "root", "r")
    assert by["stories"][3] == doc["stories"][0] and by["rest"][3] == {"speaker": "x", "unknown.deep.note": 1, "loose": [1, {"a": 2}]}
    df = spark.createDataFrame([("r", json.dumps(doc)), ("q", None)], "k string, d string")
    stored = N.stored(N.flatten_records(df, "s", "k", "d", N.Layout("root", N.ENTITIES, N.WRAPPERS)))
    assert rows(N.typed(stored, "people_mentions"), "entity_id", "name") == [("m", "n")] and stored.count() == 3
