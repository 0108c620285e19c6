"""Untrusted extractions to accepted objects and issues, all kinds in one plan.

Every object is judged by ordered rules over itself and over what its own record knows: its segments, and the mentions and
relationships that were accepted before. The first rule that fails gives the issue; a bad object does not take its siblings
along, but what refers to it falls in its own turn. What a record knows is one row of arrays, so each kind costs one join on
the record, and no object meets another record.

Defined results: of objects with one id the first in order of their content stands and the others have the issue duplicate_id;
absent arrays are empty; a record without segments knows none; privacy is forced, not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import lexicon
from evigraph.functions.kinship import CORRECTIONS, FIRST_PERSON
from evigraph.functions.temporal import ABOUT, AFTER, BEFORE, is_date, occurs_in, relationship_state
from evigraph.functions.text import all_supported, drops_negation, has_phrase, is_open, is_supported, normalize, question_adds_facts, sensitivity, title_supported, words
from evigraph.operators import nested
from evigraph.operators.contract import first_failure, first_wins
from evigraph.operators.evidence import weakest_class
from evigraph.operators.grounding import claim_decisions, named_pairs
from evigraph.operators.linguistics import name_occurrences, relationship_signals, with_people
from evigraph.runtime import materialize

_NONE = "array<string>"


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NONE))


def _refs(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NONE))


def _all_known(refs: str, known: str) -> Column:
    return F.size(F.array_except(_refs(refs), _known(known))) == 0


def _judge(rows: DataFrame, entity: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(record_id, entity, entity_id, issue_code) and the row's columns; of equal ids only the first may be accepted."""
    order = Window.partitionBy("record_id", "entity_id").orderBy(F.col("issue_code").isNotNull(), "digest")
    judged = rows.withColumn("issue_code", first_failure(rules)).withColumn("entity", F.lit(entity))
    judged = judged.withColumn("n", F.row_number().over(order))
    return judged.withColumn("issue_code", F.when((F.col("n") > 1) & F.col("issue_code").isNull(), "duplicate_id").otherwise(F.col("issue_code"))).drop("n")


def _ids(judged: DataFrame, name: str) -> DataFrame:
    """One row a record with the ids that were accepted."""
    return judged.where("issue_code is null").groupBy("record_id").agg(F.array_sort(F.collect_set("entity_id")).alias(name))


def _typed(tagged: DataFrame, entity: str) -> DataFrame:
    rows = nested.typed(tagged, entity)
    return rows.withColumn("digest", F.xxhash64(*(F.to_json(F.struct(c)) for c in rows.columns)))


_SEGMENTS = "array<struct<segment_id:string,text:string>>"


def transcripts(cases: DataFrame) -> DataFrame:
    """(record_id, speaker, segs, segments, full_text) of each transcript: its segments, their ids and their normalized text."""
    speaker = F.col("speaker_name") if "speaker_name" in cases.columns else F.lit(None).cast("string")
    return _texts(cases.select(F.col("case_id").alias("record_id"), speaker.alias("speaker"), F.transform("transcript.segments", lambda g: F.struct(g["segment_id"].alias("segment_id"), g["text"].alias("text"))).alias("segs")))


def payload_transcripts(tagged: DataFrame) -> DataFrame:
    """The same of records that carry their transcript in the payload, from their row of the rest table."""
    at = lambda *paths: F.coalesce(*(F.get_json_object("payload", f"$['{p}']") for p in paths))
    rows = tagged.where((F.col("entity") == nested.REST) & (F.col("parent_entity") == "payload"))
    return _texts(rows.select("record_id", at("extraction.speaker_name", "result.extraction.speaker_name").alias("speaker"), F.from_json(at("transcript.segments", "result.transcript.segments"), _SEGMENTS).alias("segs")))


def _texts(rows: DataFrame) -> DataFrame:
    rows = first_wins(rows, ["record_id"], [F.to_json("segs").isNull(), F.to_json("segs")])
    text = F.array_join(F.transform("segs", lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return rows.select("record_id", "speaker", "segs", F.transform("segs", lambda s: s["segment_id"]).alias("segments"), normalize(text).alias("full_text"))


def _ok(c: Column) -> Column:
    """A condition that holds where something that it needs is absent: absent optional fields are not judged."""
    return F.coalesce(c, F.lit(True))


def _quoted(ids: str, known: str, key: str) -> Column:
    """The texts that an array of ids names among an array of structs, joined; null where it names none."""
    hits = F.filter(F.coalesce(known, F.expr("array()")), lambda x: F.array_contains(_refs(ids), x[key]))
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, lambda x: F.coalesce(x["text"], F.lit(""))), " "))


def _borne(c: Column) -> Column:
    """A condition on the cited text; it holds where nothing is cited."""
    return F.col("cited").isNull() | _ok(c)


def _within(part: str, whole: str) -> Column:
    """Whether the ids of ``part`` are among those of ``whole``; not judged where either is absent."""
    return _ok(F.size(F.array_except(part, whole)) == 0)


def _with_context(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with ``evidence`` (the record's accepted spans) and ``cited``: the text of the evidence, else of the segments, cited."""
    each = spans.where("issue_code is null").select("record_id", F.struct(F.col("entity_id").alias("evidence_id"), "text", "evidence_class", "segment_id").alias("e"))
    rows = rows.join(each.groupBy("record_id").agg(F.collect_set("e").alias("evidence")), "record_id", "left")
    return rows.withColumn("cited", F.coalesce(_quoted("evidence_ids", "evidence", "evidence_id"), _quoted("source_segment_ids", "segs", "segment_id")))


def _claim_rules() -> list[tuple[str, Column]]:
    """What every claim must keep: no review claimed, known segments and evidence, uncertainty in scope, class and provenance."""
    u, p = F.col("uncertainty"), F.col("provenance")
    known = F.transform(F.coalesce("evidence", F.expr("array()")), lambda e: e["evidence_id"])
    marked = _quoted("uncertainty.evidence_ids", "evidence", "evidence_id")
    own = F.transform(F.filter(F.coalesce("evidence", F.expr("array()")), lambda e: F.array_contains(_refs("evidence_ids"), e["evidence_id"])), lambda e: e["evidence_class"])
    return [
        ("status_not_unreviewed", _ok(F.col("verification_status") == "unreviewed")),
        ("unknown_segment", _within("source_segment_ids", "segments")),
        ("unknown_evidence", _ok(F.size(F.array_except("evidence_ids", known)) == 0)),
        ("uncertainty_unknown_segment", _within("uncertainty.source_segment_ids", "segments")),
        ("uncertainty_outside_scope", _within("uncertainty.source_segment_ids", "source_segment_ids")),
        ("uncertainty_unrelated_evidence", _within("uncertainty.evidence_ids", "evidence_ids")),
        ("uncertainty_unsupported_marker", _ok(F.forall(u["markers"], lambda m: has_phrase(normalize(marked), normalize(m))))),
        ("uncertainty_not_in_mode", _ok(u.isNull() | (F.col("assertion_mode") == "uncertain"))),
        ("uncertainty_class", _ok(u.isNull() | p.isNull() | (F.col("evidence_class") == lexicon.EVIDENCE_CLASSES[-1]))),
        ("class_not_weakest", _ok(u.isNotNull() | (F.size(own) == 0) | (F.col("evidence_class") == weakest_class(own)))),
        ("provenance_evidence", _ok(F.size(F.array_except(p["evidence_ids"], known)) == 0)),
        ("provenance_mismatch", _ok(F.array_sort(p["evidence_ids"]) == F.array_sort("evidence_ids"))),
        ("derivation_self", _ok(~F.array_contains("derived_from_claim_ids", F.col("entity_id")))),
        ("derivation_repeated", _ok(F.size(F.array_distinct("derived_from_claim_ids")) == F.size("derived_from_claim_ids"))),
    ]


def _grounded(ids: Column) -> Column:
    """Whether persons are named in the cited segments or are what a resolved link there stands for; not judged without segments."""
    here = F.filter(_array("named"), lambda n: F.array_contains(_refs("source_segment_ids"), n["segment_id"]))
    linked = F.flatten(F.transform(F.filter(_array("resolved"), lambda r: F.arrays_overlap(r["segments"], _refs("source_segment_ids"))), lambda r: r["people"]))
    known = F.concat(F.transform(here, lambda n: n["mention_id"]), linked)
    return F.when(F.size(_refs("source_segment_ids")) > 0, F.size(F.array_except(ids, known)) == 0)


def _array(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("array()"))


def _named_in(text: Column) -> Column:
    """The mentions of the record whose name stands in a text as whole words."""
    return F.transform(F.filter(_array("people"), lambda p: (p["norm"] != "") & has_phrase(normalize(text), p["norm"])), lambda p: p["mention_id"])


def sanitize(tagged: DataFrame, texts: DataFrame) -> DataFrame:
    """(record_id, entity, entity_id, issue_code) of every object; no issue means accepted.

    The rules of a kind are ordered: ids and references first, then uncertainty and provenance, then what the cited text bears
    out. A rule about a field that an object does not have, or about cited text where it cites none, is not judged.
    """
    with_text = lambda entity: _typed(tagged, entity).join(texts, "record_id", "left")
    spans = _judge(
        with_text("evidence_spans"),
        "evidence_spans",
        [
            ("unknown_segment", F.array_contains(_known("segments"), F.col("segment_id"))),
            ("offsets_incomplete", F.col("start_char").isNull() == F.col("end_char").isNull()),
            ("offsets_invalid", F.col("start_char").isNull() | (F.col("end_char") > F.col("start_char"))),
            ("derivation_self", _ok(~F.array_contains("derived_from_evidence_ids", F.col("entity_id")))),
        ],
    )
    spans = materialize(spans.select("record_id", "entity", "entity_id", "issue_code", "text", "evidence_class", "segment_id"))
    claim = lambda entity: _with_context(with_text(entity), spans)
    first_person = F.arrays_overlap(words(F.col("cited")), F.array(*(F.lit(w) for ws in FIRST_PERSON.values() for w in ws)))
    variants = nested.typed(tagged, "name_variants").groupBy("record_id", F.col("parent_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_variants"), F.countDistinct("variant_id").alias("n_variant_ids"), F.flatten(F.collect_set(F.coalesce("source_segment_ids", F.array().cast(_NONE)))).alias("variant_segments"), F.collect_set("surface").alias("surfaces"), F.max(F.coalesce(F.col("verification_status"), F.lit("unreviewed")) != "unreviewed").alias("variant_reviewed"))
    surfaces = F.concat(F.array("name"), _refs("aliases"), _refs("surfaces"))
    by_form = lambda s: F.exists(words(F.col("cited")), lambda w: F.startswith(w, normalize(s)) & (F.length(normalize(s)) >= 3))
    people = _judge(
        claim("people_mentions").join(variants, ["record_id", "entity_id"], "left"),
        "people_mentions",
        [
            ("name_empty", F.length(normalize(F.col("name"))) > 0),
            ("unknown_segment", _all_known("source_segment_ids", "segments")),
            ("confidence_invalid", F.col("confidence").isNull() | F.col("confidence").between(0, 1)),
            *_claim_rules(),
            ("variant_repeated", _ok(F.col("n_variant_ids") == F.col("n_variants"))),
            ("variant_unknown_segment", _within("variant_segments", "segments")),
            ("variant_reviewed", _ok(~F.col("variant_reviewed"))),
            ("name_not_in_evidence", _ok(F.exists(surfaces, lambda s: F.coalesce(has_phrase(normalize(F.col("cited")), normalize(s)) | by_form(s), F.lit(False))) | F.coalesce((normalize(F.col("name")) == normalize(F.col("speaker"))) & first_person, F.lit(False)) | F.col("cited").isNull())),
        ],
    )
    people = materialize(people.select("record_id", "entity", "entity_id", "issue_code", "name", "source_segment_ids"))
    mentions = _ids(people, "mentions")
    accepted = people.where("issue_code is null")
    known = accepted.select("record_id", F.struct(F.col("entity_id").alias("mention_id"), normalize(F.col("name")).alias("norm"), _refs("source_segment_ids").alias("segments")).alias("p")).groupBy("record_id").agg(F.collect_set("p").alias("people"))
    speakers = texts.select(F.col("record_id").alias("record"), "speaker", F.col("segs").alias("segments"))
    joined = with_people(speakers, accepted.select(F.col("record_id").alias("record"), F.col("entity_id").alias("mention_id"), "name", F.lit(None).cast(_NONE).alias("source_segment_ids")))
    named = name_occurrences(joined).groupBy(F.col("record").alias("record_id")).agg(F.collect_set(F.struct("segment_id", "mention_id")).alias("named"))
    named = materialize(named)
    links = _judge(
        with_text("coreference_links").join(mentions, "record_id", "left"),
        "coreference_links",
        [
            ("unknown_segment", _all_known("source_segment_ids", "segments")),
            ("unknown_candidate", _all_known("candidate_mention_ids", "mentions")),
            ("unknown_antecedent", _within("antecedent_mention_ids", "mentions")),
            ("status_not_unreviewed", _ok(F.col("verification_status") == "unreviewed")),
            ("ambiguous_needs_two", (F.coalesce("status", F.lit("")) != "ambiguous") | (F.size(_refs("candidate_mention_ids")) >= 2)),
            ("anaphor_not_in_text", F.coalesce(has_phrase(F.col("full_text"), normalize(F.col("anaphor_text"))), F.lit(False))),
        ],
    )
    links = materialize(links.select("record_id", "entity", "entity_id", "issue_code", "status", "source_segment_ids", "antecedent_mention_ids", "candidate_mention_ids"))
    resolved = links.where("issue_code is null and status = 'resolved'").groupBy("record_id").agg(F.collect_set(F.struct(_refs("source_segment_ids").alias("segments"), F.coalesce("antecedent_mention_ids", "candidate_mention_ids", F.array().cast(_NONE)).alias("people"))).alias("resolved"))
    about = lambda entity: claim(entity).join(mentions, "record_id", "left").join(known, "record_id", "left").join(named, "record_id", "left").join(resolved, "record_id", "left")
    told = relationship_signals(joined).select("record", "relationship_type", "subject", "object").unionByName(named_pairs(joined).select("record", "relationship_type", F.col("first").alias("subject"), F.col("second").alias("object")))
    stated = _typed(tagged, "relationship_claims").select(F.col("record_id").alias("record"), F.col("entity_id").alias("relationship_id"), "relationship_type", F.col("subject_mention_id").alias("subject"), F.col("object_mention_id").alias("object"))
    decided = claim_decisions(stated, told).groupBy(F.col("record").alias("record_id"), F.col("relationship_id").alias("entity_id")).agg(F.min("decision").alias("decision"))
    state = relationship_state(F.col("cited"))
    current = F.coalesce("relationship_state", F.lit("current")) == "current"
    segments_of = lambda c: F.flatten(F.transform(F.filter(_array("people"), lambda p: p["mention_id"] == F.col(c)), lambda p: p["segments"]))
    overlap = lambda c: (F.size(_refs("source_segment_ids")) == 0) | (F.size(segments_of(c)) == 0) | F.arrays_overlap(segments_of(c), _refs("source_segment_ids"))
    speaks = F.exists(_array("people"), lambda p: (p["norm"] == normalize(F.col("speaker"))) & p["mention_id"].isin(F.col("subject_mention_id"), F.col("object_mention_id")))
    claims = _judge(
        about("relationship_claims").join(decided, ["record_id", "entity_id"], "left"),
        "relationship_claims",
        [
            ("unknown_subject", F.array_contains(_known("mentions"), F.col("subject_mention_id"))),
            ("unknown_object", F.array_contains(_known("mentions"), F.col("object_mention_id"))),
            ("endpoints_equal", F.col("subject_mention_id") != F.col("object_mention_id")),
            ("type_missing", F.length("relationship_type") > 0),
            *_claim_rules(),
            ("state_lost", _borne((state == "current") | ~current)),
            ("state_class", _ok(current | F.col("provenance").isNull() | (F.col("evidence_class") == lexicon.EVIDENCE_CLASSES[-1]))),
            ("state_evidence_outside", _ok(current | (F.size(F.array_except("state_evidence_ids", "evidence_ids")) == 0))),
            ("subject_outside_evidence", _ok(overlap("subject_mention_id"))),
            ("object_outside_evidence", _ok(overlap("object_mention_id"))),
            ("endpoint_unsupported", _ok(_grounded(F.array("subject_mention_id", "object_mention_id")) | speaks)),
            ("contradicts_kinship", _ok(~current | (F.col("decision") != "contradicted"))),
            ("speaker_without_kinship", _ok(~current | (F.col("evidence_class") != lexicon.EVIDENCE_CLASSES[2]) | (F.col("decision") == "supported"))),
        ],
    )
    claims = materialize(claims.select("record_id", "entity", "entity_id", "issue_code"))
    date = F.col("date")
    expression = date["original_expression"]
    title_words = F.concat(F.array_compact(F.array("event_type", "location")), F.transform(F.filter(_array("people"), lambda p: F.array_contains(_refs("participant_mention_ids"), p["mention_id"])), lambda p: p["norm"]))
    told_people, participants = _named_in(F.col("description")), _refs("participant_mention_ids")
    iso_day = date["value"].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    vague = F.exists(F.array(*(F.lit(w) for w in (*ABOUT, *BEFORE, *AFTER))), lambda w: has_phrase(normalize(expression), w))
    here = F.filter(_array("named"), lambda n: F.array_contains(_refs("source_segment_ids"), n["segment_id"]))
    events = _judge(
        about("events"),
        "events",
        [
            ("participant_omitted", (F.size(participants) > 0) | (F.size(here) == 0)),
            ("participants_missing", F.size(participants) > 0),
            ("unknown_participant", _all_known("participant_mention_ids", "mentions")),
            *_claim_rules(),
            ("title_unsupported", _borne(title_supported(F.col("title"), F.col("cited"), title_words))),
            ("description_unsupported", _borne(all_supported(F.col("description"), F.col("cited")))),
            ("location_unsupported", _borne((F.trim("location") == "") | is_supported(F.col("location"), F.col("cited")))),
            ("date_status", _ok(date["verification_status"] == "unreviewed")),
            ("date_expression_lost", _ok(F.trim(expression) != "")),
            ("date_unsupported", _borne(occurs_in(expression, F.col("cited")))),
            ("date_evidence_outside", _ok(F.size(F.array_except(date["source_evidence_ids"], F.col("evidence_ids"))) == 0)),
            ("date_exactified", _ok(~vague | (date["kind"] != "exact_date"))),
            ("date_invalid", _ok(~(iso_day | (date["kind"] == "exact_date")) | is_date(date["value"]))),
            ("date_without_anchor", _ok((date["kind"] != "relative") | date["normalized_value"].isNull() | date["anchor_event_id"].isNotNull())),
            ("participants_mismatch", _ok(F.col("cited").isNull() | (F.size(told_people) == 0) | (F.array_sort(told_people) == F.array_sort(participants)))),
            ("participant_ungrounded", _ok(_grounded(participants))),
        ],
    )
    events = materialize(events.select("record_id", "entity", "entity_id", "issue_code", "title", "source_segment_ids"))
    described = _named_in(F.col("description"))
    descriptions = _judge(
        about("descriptions"),
        "descriptions",
        [
            ("unknown_person", F.array_contains(_known("mentions"), F.col("person_mention_id"))),
            ("description_empty", F.length(F.trim("description")) > 0),
            *_claim_rules(),
            ("person_ungrounded", _ok(_grounded(F.array("person_mention_id")))),
            ("description_unsupported", _borne(all_supported(F.col("description"), F.col("cited")))),
            ("names_another_person", _ok(F.col("cited").isNull() | (F.size(described) == 0) | F.array_contains(described, F.col("person_mention_id")))),
            ("negation_dropped", _borne(~drops_negation(F.col("description"), F.col("cited")))),
            ("perspective_unsupported", _borne((normalize(F.col("perspective")) == normalize(F.col("speaker"))) | has_phrase(normalize(F.col("cited")), normalize(F.col("perspective"))))),
        ],
    )
    happened = events.where("issue_code is null").groupBy("record_id").agg(F.collect_set(F.struct(F.col("entity_id").alias("event_id"), "title", _refs("source_segment_ids").alias("segments"))).alias("happened"))
    mine = F.filter(_array("happened"), lambda e: F.array_contains(_refs("event_ids"), e["event_id"]))
    story_words = F.concat(F.transform(mine, lambda e: e["title"]), F.transform(F.filter(_array("people"), lambda p: F.array_contains(_refs("person_mention_ids"), p["mention_id"])), lambda p: p["norm"]))
    rank = lambda c: F.array_position(F.array(*map(F.lit, lexicon.SENSITIVITY_LEVELS)), c)
    stories = _judge(
        about("stories").join(_ids(events, "known_events"), "record_id", "left").join(happened, "record_id", "left"),
        "stories",
        [
            ("unknown_person", _all_known("person_mention_ids", "mentions")),
            ("unknown_event", _all_known("event_ids", "known_events")),
            ("summary_empty", F.length(F.trim("summary")) > 0),
            *_claim_rules(),
            ("title_unsupported", _borne(title_supported(F.col("title"), F.col("cited"), story_words))),
            ("summary_unsupported", _borne(all_supported(F.col("summary"), F.col("cited")))),
            ("sensitivity_understated", _borne(rank(F.col("sensitivity")) >= rank(sensitivity(F.col("cited"))["level"]))),
            ("person_ungrounded", _ok(_grounded(_refs("person_mention_ids")))),
            ("event_outside_story", _ok((F.size(_refs("source_segment_ids")) == 0) | F.forall(mine, lambda e: (F.size(e["segments"]) == 0) | F.arrays_overlap(e["segments"], _refs("source_segment_ids"))))),
        ],
    )
    questions = _judge(
        claim("unresolved_questions").join(mentions, "record_id", "left"),
        "unresolved_questions",
        [
            ("question_empty", F.length(F.trim("question")) > 0),
            ("unknown_person", _all_known("related_mention_ids", "mentions")),
            ("unknown_segment", _within("source_segment_ids", "segments")),
            ("nothing_open", _borne(is_open(F.col("cited")) | (F.size(_refs("related_mention_ids")) >= 2))),
            ("question_adds_facts", _borne(~question_adds_facts(F.col("question"), F.col("cited")))),
        ],
    )
    refs = nested.typed(tagged, "claim_refs").groupBy("record_id", F.col("parent_id").alias("entity_id")).agg(F.array_sort(F.collect_set("object_id")).alias("refs"))
    conflicts = _judge(
        _typed(tagged, "conflict_sets").join(refs, ["record_id", "entity_id"], "left").join(_ids(claims, "claims"), "record_id", "left").join(_ids(spans, "known_evidence"), "record_id", "left"),
        "conflict_sets",
        [
            ("too_few_claims", F.size(_refs("refs")) >= 2),
            ("unknown_claim", _all_known("refs", "claims")),
            ("unknown_evidence", _within("evidence_ids", "known_evidence")),
            ("status_invalid", _ok(F.col("status").isin(*lexicon.CONFLICT_STATES))),
        ],
    )
    parts = [people, spans, claims, events, links, descriptions, stories, questions, conflicts]
    out = parts[0].select("record_id", "entity", "entity_id", "issue_code")
    for p in parts[1:]:
        out = out.unionAll(p.select("record_id", "entity", "entity_id", "issue_code"))
    return out


def cleaner_issues(rows: DataFrame) -> DataFrame:
    """(record, segment_id, issue_code) of cleaned transcripts against what was said.

    ``rows``: record, segment_id, raw, readable, corrections (array of original, corrected) and fragments (array of texts). A
    correction needs a phrase of correction in the raw text, its original there and its outcome in the readable one; a fragment
    must stand in the raw text, not be a correction's original too, and be kept in the readable one.
    """
    raw, readable = normalize(F.col("raw")), normalize(F.col("readable"))
    cued = F.exists(F.array(*map(F.lit, CORRECTIONS)), lambda c: has_phrase(raw, c))
    corrections, fragments = _array("corrections"), _array("fragments")
    rules = [
        ("segment_missing", F.col("raw").isNotNull() & F.col("readable").isNotNull()),
        ("correction_without_cue", (F.size(corrections) == 0) | cued),
        ("correction_original_missing", F.forall(corrections, lambda c: has_phrase(raw, normalize(c["original"])))),
        ("correction_outcome_missing", F.forall(corrections, lambda c: has_phrase(readable, normalize(c["corrected"])))),
        ("fragment_missing", F.forall(fragments, lambda f: has_phrase(raw, normalize(f)))),
        ("fragment_is_correction", ~F.exists(fragments, lambda f: F.exists(corrections, lambda c: normalize(c["original"]) == normalize(f)))),
        ("fragment_not_kept", F.forall(fragments, lambda f: has_phrase(readable, normalize(f)))),
    ]
    return rows.select("record", "segment_id", first_failure(rules).alias("issue_code"))


def issue_table(judged: DataFrame) -> DataFrame:
    """Objects by kind and outcome."""
    return judged.groupBy("entity", F.coalesce("issue_code", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
