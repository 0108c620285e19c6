import json

from evigraph.operators import nested as N
from evigraph.operators import sanitize as S

CASE = "case_id string, transcript struct<segments:array<struct<segment_id:string,text:string>>>"


def judged(spark, doc, segments=(("s1", "Анна и её брат"),)):
    tagged = N.flatten_records(spark.createDataFrame([("r", json.dumps(doc))], "id string, doc string"), "t", "id", "doc", N.Layout("raw_extraction", N.ENTITIES, N.WRAPPERS))
    texts = S.transcripts(spark.createDataFrame([("r", (list(segments),))], CASE))
    return {(r["entity"], r["entity_id"], r["issue_code"]) for r in S.sanitize(tagged, texts).collect()}


def test_bad_objects_fall_alone_and_take_their_references(spark):
    doc = {
        "people_mentions": [
            {"mention_id": "a", "name": "Анна", "source_segment_ids": ["s1"]},
            {"mention_id": "b", "name": "Брат", "source_segment_ids": ["s9"]},
            {"mention_id": "c", "name": " ", "source_segment_ids": []},
            {"mention_id": "d", "name": "Вера", "confidence": 2},
            {"mention_id": "e", "name": "Ира"},
            {"mention_id": "e", "name": "Ирина"},
        ],
        "relationship_claims": [
            {"relationship_id": "r1", "relationship_type": "sibling", "subject_mention_id": "a", "object_mention_id": "e"},
            {"relationship_id": "r2", "relationship_type": "sibling", "subject_mention_id": "a", "object_mention_id": "b"},
            {"relationship_id": "r3", "relationship_type": "sibling", "subject_mention_id": "a", "object_mention_id": "a"},
            {"relationship_id": "r4", "relationship_type": "spouse", "subject_mention_id": None, "object_mention_id": "a"},
        ],
        "events": [{"event_id": "e1", "participant_mention_ids": ["a"]}, {"event_id": "e2", "participant_mention_ids": []}, {"event_id": "e3", "participant_mention_ids": ["zz"]}],
        "stories": [{"story_id": "t1", "summary": "x", "person_mention_ids": ["a"], "event_ids": ["e1"]}, {"story_id": "t2", "summary": "x", "event_ids": ["e3"]}],
        "coreference_links": [
            {"coreference_id": "c1", "anaphor_text": "её", "source_segment_ids": ["s1"], "status": "resolved", "candidate_mention_ids": ["a"]},
            {"coreference_id": "c2", "anaphor_text": "их", "source_segment_ids": ["s1"], "candidate_mention_ids": []},
            {"coreference_id": "c3", "anaphor_text": "её", "source_segment_ids": ["s1"], "status": "ambiguous", "candidate_mention_ids": ["a"]},
        ],
        "conflict_sets": [{"conflict_id": "k1", "claim_refs": [{"object_id": "r1"}, {"object_id": "r2"}]}, {"conflict_id": "k2", "claim_refs": [{"object_id": "r1"}]}],
        "evidence_spans": [{"evidence_id": "v1", "segment_id": "s1", "start_char": 0, "end_char": 4}, {"evidence_id": "v2", "segment_id": "s1", "start_char": 3}, {"evidence_id": "v3", "segment_id": "s8"}],
        "unresolved_questions": [{"question_id": "q1", "question": "?"}, {"question_id": "q2", "question": ""}],
        "descriptions": [{"description_id": "d1", "person_mention_id": "a", "description": "x"}, {"description_id": "d2", "person_mention_id": "b", "description": "x"}],
    }
    assert judged(spark, doc) == {
        ("people_mentions", "a", None), ("people_mentions", "b", "unknown_segment"), ("people_mentions", "c", "name_empty"), ("people_mentions", "d", "confidence_invalid"), ("people_mentions", "e", None), ("people_mentions", "e", "duplicate_id"),
        ("relationship_claims", "r1", None), ("relationship_claims", "r2", "unknown_object"), ("relationship_claims", "r3", "endpoints_equal"), ("relationship_claims", "r4", "unknown_subject"),
        ("events", "e1", None), ("events", "e2", "participants_missing"), ("events", "e3", "unknown_participant"),
        ("stories", "t1", None), ("stories", "t2", "unknown_event"),
        ("coreference_links", "c1", None), ("coreference_links", "c2", "anaphor_not_in_text"), ("coreference_links", "c3", "ambiguous_needs_two"),
        ("conflict_sets", "k1", "unknown_claim"), ("conflict_sets", "k2", "too_few_claims"),
        ("evidence_spans", "v1", None), ("evidence_spans", "v2", "offsets_incomplete"), ("evidence_spans", "v3", "unknown_segment"),
        ("unresolved_questions", "q1", None), ("unresolved_questions", "q2", "question_empty"),
        ("descriptions", "d1", None), ("descriptions", "d2", "unknown_person"),
    }


def test_empty_extraction(spark):
    assert judged(spark, {}) == set()
    assert judged(spark, {"events": None, "people_mentions": "x"}) == set()


FULL = "case_id string, speaker_name string, transcript struct<segments:array<struct<segment_id:string,text:string>>>"


def test_every_rule_of_the_contract_fires(spark):
    """One object breaks each rule about uncertainty, provenance, states, ends, dates, participants, texts, stories and questions."""
    segments = [("s1", "Анна жила в Омске, кажется, около 1950 года."), ("s2", "Болат не работал. Он умер."), ("s3", "Я помню Анну и Болата."), ("s4", "Мой брат Болат."), ("s5", "Анна бывшая жена Болата.")]
    base = {"source_segment_ids": ["s1"], "evidence_ids": ["v1"], "evidence_class": "A_explicit"}
    unc = lambda **x: base | {"evidence_class": "U_uncertain"} | {"uncertainty": {"status": "uncertain"} | x}
    d = lambda i, **x: base | {"description_id": i, "person_mention_id": "a", "description": "Анна жила в Омске"} | x
    e = lambda i, **x: base | {"event_id": i, "event_type": "move", "participant_mention_ids": ["a"], "description": "Анна жила в Омске"} | x
    r = lambda i, **x: {"relationship_id": i, "relationship_type": "sibling", "subject_mention_id": "a", "object_mention_id": "b", "source_segment_ids": ["s3"]} | x
    t = lambda i, **x: base | {"story_id": i, "summary": "Анна жила в Омске", "person_mention_ids": ["a"], "event_ids": []} | x
    q = lambda i, **x: {"question_id": i, "question": "где Анна", "related_mention_ids": ["a"], "source_segment_ids": ["s1"]} | x
    doc = {
        "evidence_spans": [{"evidence_id": "v1", "segment_id": "s1", "text": segments[0][1], "evidence_class": "A_explicit"}, {"evidence_id": "v2", "segment_id": "s2", "text": segments[1][1], "evidence_class": "E_inferred"}, {"evidence_id": "v3", "segment_id": "s2", "text": "x", "derived_from_evidence_ids": ["v3"]}],
        "people_mentions": [
            {"mention_id": "a", "name": "Анна", "source_segment_ids": ["s1", "s3", "s5"]}, {"mention_id": "b", "name": "Болат", "source_segment_ids": ["s2", "s3", "s4", "s5"]}, {"mention_id": "k", "name": "Серік", "source_segment_ids": ["s4"]},
            {"mention_id": "n", "name": "Ольга", "source_segment_ids": ["s1"]}, {"mention_id": "w", "name": "Анна", "source_segment_ids": ["s1"], "verification_status": "confirmed"},
            {"mention_id": "y", "name": "Анна", "source_segment_ids": ["s1"], "name_variants": [{"variant_id": "1", "surface": "Аня", "source_segment_ids": ["s9"]}]},
        ],
        "descriptions": [
            d("ok"), d("d1", evidence_ids=["zz"]), d("d2", **unc(source_segment_ids=["s9"])), d("d3", **unc(source_segment_ids=["s2"])), d("d4", **unc(evidence_ids=["v2"])), d("d5", **unc(evidence_ids=["v1"], markers=["возможно"]), assertion_mode="uncertain"),
            d("d6", **unc(), assertion_mode="explicit"), d("d7", **(unc() | {"evidence_class": "A_explicit", "provenance": {"evidence_ids": ["v1"]}, "assertion_mode": "uncertain"})), d("d8", evidence_class="E_inferred"), d("d9", provenance={"evidence_ids": ["zz"]}), d("d10", provenance={"evidence_ids": ["v1", "v2"]}),
            d("d11", derived_from_claim_ids=["d11"]), d("d12", derived_from_claim_ids=["x", "x"]), d("d13", person_mention_id="b"), d("d14", description="Анна летала"), d("d15", perspective="сосед"),
            d("d16", person_mention_id="b", source_segment_ids=["s2"], evidence_ids=["v2"], evidence_class="E_inferred", description="Болат работал"), d("d17", source_segment_ids=["s3", "s4"], evidence_ids=None, evidence_class=None, person_mention_id="a", description="Болат"),
        ],
        "relationship_claims": [
            r("ok"), r("r1", source_segment_ids=["s5"], relationship_type="spouse"), r("r2", relationship_state="former", evidence_class="A_explicit", provenance={"evidence_ids": []}, evidence_ids=[]), r("r3", relationship_state="former", state_evidence_ids=["v2"], evidence_ids=["v1"]),
            r("r4", source_segment_ids=["s4"]), r("r5", subject_mention_id="k", source_segment_ids=["s4"], relationship_type="spouse"), r("r6", evidence_class="C_speaker_anchored"), r("r7", subject_mention_id="b", object_mention_id="a", source_segment_ids=["s1"]),
        ],
        "events": [
            e("ok"), e("e1", participant_mention_ids=[]), e("e2", title="Чужое"), e("e3", description="Анна летала"), e("e4", location="Париж"), e("e5", date={"verification_status": "confirmed"}), e("e6", date={"original_expression": " "}), e("e7", date={"original_expression": "в 1960 году"}),
            e("e8", date={"source_evidence_ids": ["v2"]}), e("e9", date={"kind": "exact_date", "original_expression": "около 1950 года", "value": "1950-01-01"}), e("e10", date={"kind": "exact_date", "value": "1950-02-30"}), e("e11", date={"kind": "relative", "normalized_value": "1950"}),
            e("e12", participant_mention_ids=["a", "b"]), e("e13", participant_mention_ids=["b"], description="жила в Омске"),
        ],
        "stories": [t("ok"), t("t1", title="Чужое"), t("t2", summary="Анна летала"), t("t3", person_mention_ids=["b"]), t("t4", source_segment_ids=["s2"], evidence_ids=["v2"], evidence_class="E_inferred", summary="Он умер", person_mention_ids=[], sensitivity="normal"), t("t5", source_segment_ids=["s3"], evidence_ids=None, evidence_class=None, summary="помню", event_ids=["ok"])],
        "unresolved_questions": [q("ok"), q("q1", source_segment_ids=["s3"]), q("q2", question="где Париж"), q("q3", source_segment_ids=["s9"])],
        "coreference_links": [{"coreference_id": "c1", "anaphor_text": "Он", "source_segment_ids": ["s2"], "candidate_mention_ids": ["b"], "antecedent_mention_ids": ["zz"]}, {"coreference_id": "c2", "anaphor_text": "Он", "source_segment_ids": ["s2"], "verification_status": "confirmed"}],
        "conflict_sets": [{"conflict_id": "k1", "status": "strange", "claim_refs": [{"object_id": "ok"}, {"object_id": "ok2"}]}, {"conflict_id": "k2", "status": "strange", "claim_refs": [{"object_id": "ok"}, {"object_id": "r2x"}]}],
    }
    tagged = N.flatten_records(spark.createDataFrame([("r", json.dumps(doc))], "id string, doc string"), "t", "id", "doc", N.Layout("raw_extraction", N.ENTITIES, N.WRAPPERS))
    texts = S.transcripts(spark.createDataFrame([("r", "Серік", (segments,))], FULL))
    got = {(r["entity"][:5], r["entity_id"]): r["issue_code"] for r in S.sanitize(N.stored(tagged), texts).collect()}
    want = {
        "people": {"a": None, "b": None, "k": None, "n": "name_not_in_evidence", "w": "status_not_unreviewed", "y": "variant_unknown_segment"},
        "evide": {"v1": None, "v2": None, "v3": "derivation_self"},
        "descr": {"ok": None, "d1": "unknown_evidence", "d2": "uncertainty_unknown_segment", "d3": "uncertainty_outside_scope", "d4": "uncertainty_unrelated_evidence", "d5": "uncertainty_unsupported_marker", "d6": "uncertainty_not_in_mode", "d7": "uncertainty_class", "d8": "class_not_weakest", "d9": "provenance_evidence", "d10": "provenance_mismatch", "d11": "derivation_self", "d12": "derivation_repeated", "d13": "person_ungrounded", "d14": "description_unsupported", "d15": "perspective_unsupported", "d16": "description_unsupported", "d17": "names_another_person"},
        "relat": {"ok": None, "r1": "state_lost", "r2": "state_class", "r3": "state_evidence_outside", "r4": "subject_outside_evidence", "r5": "contradicts_kinship", "r6": "speaker_without_kinship", "r7": "subject_outside_evidence"},
        "event": {"ok": None, "e1": "participant_omitted", "e2": "title_unsupported", "e3": "description_unsupported", "e4": "location_unsupported", "e5": "date_status", "e6": "date_expression_lost", "e7": "date_unsupported", "e8": "date_evidence_outside", "e9": "date_exactified", "e10": "date_invalid", "e11": "date_without_anchor", "e12": "participants_mismatch", "e13": "participant_ungrounded"},
        "stori": {"ok": None, "t1": "title_unsupported", "t2": "summary_unsupported", "t3": "person_ungrounded", "t4": "sensitivity_understated", "t5": "event_outside_story"},
        "unres": {"ok": None, "q1": "nothing_open", "q2": "question_adds_facts", "q3": "unknown_segment"},
        "coref": {"c1": "unknown_antecedent", "c2": "status_not_unreviewed"},
        "confl": {"k1": "unknown_claim", "k2": "unknown_claim"},
    }
    flat = {(k[:5], i): c for k, x in want.items() for i, c in x.items()}
    assert {k: (got.get(k, "?"), c) for k, c in flat.items() if got.get(k, "?") != c} == {}


def test_cleaner_rules(spark):
    ddl = "record string, segment_id string, raw string, readable string, corrections array<struct<original:string,corrected:string>>, fragments array<string>"
    data = [
        ("ok", "Анна нет точнее Вера пришла ээ", "Вера пришла ээ", [("Анна", "Вера")], ["ээ"]), ("segment_missing", None, "x", None, None), ("correction_without_cue", "Анна пришла", "Вера пришла", [("Анна", "Вера")], None),
        ("correction_original_missing", "нет пришла", "Вера", [("Анна", "Вера")], None), ("correction_outcome_missing", "Анна нет", "Анна", [("Анна", "Вера")], None), ("fragment_missing", "a", "a", None, ["b"]),
        ("fragment_is_correction", "Анна нет Вера", "Анна Вера", [("Анна", "Вера")], ["Анна"]), ("fragment_not_kept", "a b", "a", None, ["b"]), ("ok", "", "", [], []),
    ]
    df = spark.createDataFrame([(c, f"s{i}", *x) for i, (c, *x) in enumerate(data)], ddl)
    assert all((r["issue_code"] or "ok") == r["record"] for r in S.cleaner_issues(df).collect())
