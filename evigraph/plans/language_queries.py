"""Queries of the linguistic operators over the transcripts and the people their extractions mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import kinship, lexicon
from evigraph.functions import text as X
from evigraph.functions.text import has_phrase, normalize
from evigraph.operators import evidence, grounding, ledger, linguistics, nested, sanitize
from evigraph.plans.hierarchies import table_sql
from evigraph.plans.text_queries import norm, sig, stmts, words
from evigraph.runtime import materialize, read


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "benchmark_cases").dropDuplicates(["case_id"])
    return c.select(F.col("case_id").alias("record"), F.col("speaker_name").alias("speaker"), F.col("transcript.segments").alias("segments"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = nested.Layout("raw_extraction", nested.ENTITIES, nested.WRAPPERS)
    tagged = nested.flatten_records(read(spark, sf_dir, "benchmark_cases"), "benchmark_cases", "case_id", "raw_extraction", layout)
    return nested.typed(tagged, "people_mentions").select(F.col("record_id").alias("record"), F.col("entity_id").alias("mention_id"), "name", "aliases", "source_segment_ids")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linguistics.with_people(_transcripts(spark, sf_dir), _people(spark, sf_dir))


def lexical_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, kinship, pronouns and anchors of every transcript."""
    return linguistics.annotate(_transcripts(spark, sf_dir))


def name_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where people are named."""
    return linguistics.name_occurrences(_joined(spark, sf_dir))


def relationship_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships that transcripts state."""
    return linguistics.relationship_signals(_joined(spark, sf_dir))


def anaphor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third-person words before kinship with their candidates."""
    return linguistics.coreference_links(_joined(spark, sf_dir))


def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of every mention's name."""
    m = read(spark, sf_dir, "people_mentions").dropDuplicates(["mention_id"]).withColumn("record", F.col("family_id"))
    return linguistics.name_variants(m)


def correction_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts by the phrases of correction in them."""
    c = read(spark, sf_dir, "benchmark_cases").select("case_id", normalize(F.col("transcript.full_text")).alias("t")).distinct()
    cues = c.select("case_id", F.explode(F.filter(F.array(*map(F.lit, kinship.CORRECTIONS)), lambda q: has_phrase(F.col("t"), q))).alias("cue"))
    return cues.groupBy("cue").agg(F.count("*").alias("n"))


def anchor_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered anchors of every transcript."""
    return linguistics.anchor_bundle(_joined(spark, sf_dir))


def description_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether extracted descriptions are supported by their transcript, and whether they drop a negation."""
    texts = sanitize.transcripts(read(spark, sf_dir, "benchmark_cases"))
    d = nested.typed(_tagged(spark, sf_dir), "descriptions").join(texts, "record_id")
    return d.select("record_id", "entity_id", X.all_supported(F.col("description"), F.col("full_text")).alias("supported"), X.drops_negation(F.col("description"), F.col("full_text")).alias("drops_negation"))


def title_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whether their title is supported by the transcript, their type or their place."""
    texts = sanitize.transcripts(read(spark, sf_dir, "benchmark_cases"))
    e = nested.typed(_tagged(spark, sf_dir), "events").join(texts, "record_id")
    ok = X.title_supported(F.coalesce("title", F.lit("")), F.col("full_text"), F.array_compact(F.array("event_type", "location")))
    return e.groupBy(ok.alias("supported")).agg(F.count("*").alias("n"))


def open_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of transcripts that signal something unknown, and those whose words a question could not add."""
    c = read(spark, sf_dir, "e2e_cases").select("case_id", F.col("reference_text").alias("ref"), F.col("request.transcript.full_text").alias("hyp")).distinct().where("ref is not null and hyp is not null")
    s = c.select("case_id", "hyp", F.explode(X.statements(F.col("ref"))).alias("s"))
    return s.groupBy("case_id").agg(F.sum(X.is_open(F.col("s")).cast("long")).alias("n_open"), F.sum(X.question_adds_facts(F.col("s"), F.col("hyp")).cast("long")).alias("n_adding"), F.sum(X.drops_negation(F.col("s"), F.col("hyp")).cast("long")).alias("n_dropping"))


def temporal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weddings and moves of the same people in one record with different dates (births seldom come twice)."""
    e = nested.project_records(lambda t: read(spark, sf_dir, t))
    rows = nested.typed(e, "events").select(F.col("record_id").alias("record"), F.col("entity_id").alias("event_id"), "event_type", F.col("participant_mention_ids").alias("participants"), F.col("date.value").alias("date"))
    return ledger.temporal_conflicts(rows, ("birth", "death", "wedding", "move"))


def ordered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cited segments of every extracted mention in transcript order, and the one that shows who it is."""
    people = materialize(_people(spark, sf_dir))
    segments = evidence.segments_of(read(spark, sf_dir, "benchmark_cases"))
    order = evidence.ordered_segments(people, "mention_id", "source_segment_ids", segments)
    best = evidence.identity_segment(people, "mention_id", "name", "source_segment_ids", segments)
    return order.join(best, ["record", "mention_id"], "left").select("record", "mention_id", F.array_join("segments", ",").alias("segments"), "segment_id")


def named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couples and siblings that transcripts name as pairs."""
    return grounding.named_pairs(_joined(spark, sf_dir))


def mention_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted mentions by evidence class."""
    transcripts, people = _transcripts(spark, sf_dir), materialize(_people(spark, sf_dir))
    joined = linguistics.with_people(transcripts, people)
    anchors = linguistics.annotate(transcripts).where("kind = 'anchor'")
    out = grounding.mention_classes(people, linguistics.name_occurrences(joined), anchors, transcripts.select("record", "speaker"))
    return out.groupBy("evidence_class").agg(F.count("*").alias("n"))


def claim_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the transcripts make of every extracted relationship."""
    claims = nested.typed(_tagged(spark, sf_dir), "relationship_claims").select(F.col("record_id").alias("record"), F.col("entity_id").alias("relationship_id"), "relationship_type", F.col("subject_mention_id").alias("subject"), F.col("object_mention_id").alias("object"))
    joined = _joined(spark, sf_dir)
    told = linguistics.relationship_signals(joined).select("record", "relationship_type", "subject", "object")
    pairs = grounding.named_pairs(joined).select("record", "relationship_type", F.col("first").alias("subject"), F.col("second").alias("object"))
    return grounding.claim_decisions(claims, told.unionByName(pairs))


def provenance_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activities behind every transcript."""
    return grounding.activities(read(spark, sf_dir, "benchmark_cases"))


#: The fields that make two objects of a kind the same, whatever their ids.
SAME = {
    "people_mentions": ["name"], "relationship_claims": ["relationship_type", "subject_mention_id", "object_mention_id"], "events": ["event_type", "description"], "descriptions": ["person_mention_id", "description"],
    "stories": ["summary"], "unresolved_questions": ["question"], "evidence_spans": ["segment_id", "text"], "coreference_links": ["anaphor_text"],
}


def merged_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of every record of both tables once by their content, and how many repetitions that drops.

    Ids count up in the order of the passes that state them, so the first by id stands.
    """
    tagged = nested.stored(nested.project_records(lambda t: read(spark, sf_dir, t))).where(F.col("entity").isin(*SAME)).distinct()
    order = F.coalesce(F.regexp_extract("entity_id", "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    rows = tagged.select("record_id", F.col("entity").alias("kind"), order.alias("pass_order"), "payload").withColumnRenamed("record_id", "record")
    out = grounding.merge_passes(rows, SAME)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_dropped").cast("bigint").alias("n_dropped"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = nested.Layout("raw_extraction", nested.ENTITIES, nested.WRAPPERS)
    return nested.flatten_records(read(spark, sf_dir, "benchmark_cases"), "benchmark_cases", "case_id", "raw_extraction", layout)


def sanitized_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extracted object of both tables, accepted or with its issue."""
    tagged = nested.stored(nested.project_records(lambda t: read(spark, sf_dir, t)))
    texts = sanitize.transcripts(read(spark, sf_dir, "benchmark_cases")).unionByName(sanitize.payload_transcripts(tagged))
    return sanitize.sanitize(tagged, materialize(texts))


def sanitize_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted objects by kind and outcome."""
    return sanitize.issue_table(sanitized_objects(spark, sf_dir))


QUERIES = {f.__name__: f for f in (lexical_annotations, name_occurrences, relationship_signals, anaphor_links, name_variants, correction_cues, anchor_bundle, description_support, title_support, temporal_conflicts, ordered_citations, named_pairs, mention_classes, claim_decisions, provenance_activities, merged_passes, open_statements, sanitized_objects, sanitize_issues)}

_FIELD = lambda f: f"lower(trim(coalesce(json_extract_string(obj, '$.{f}'), '')))"
_MERGED = " UNION ALL ".join(f"SELECT source, record_id, '{k}' AS kind, id, concat_ws(chr(31), {', '.join(map(_FIELD, fs))}) AS key, CAST(obj AS VARCHAR) AS o FROM o_{k}" for k, fs in SAME.items())

ORACLES = {
    "merged_passes": f"WITH {table_sql()}, every AS (SELECT DISTINCT * FROM ({_MERGED})), g AS (SELECT kind, record_id, key, count(*) - 1 AS n_dropped FROM every GROUP BY 1, 2, 3) SELECT kind, count(*) AS n, CAST(sum(n_dropped) AS BIGINT) AS n_dropped FROM g GROUP BY 1",
    "temporal_conflicts": f"""WITH {table_sql()}, v AS (SELECT DISTINCT record_id AS record, id AS event_id, json_extract_string(obj, '$.event_type') AS event_type, array_to_string(list_sort(list_distinct(from_json(json_extract(obj, '$.participant_mention_ids'), '["VARCHAR"]'))), ',') AS people, json_extract_string(obj, '$.date.value') AS date FROM o_events)
SELECT record, event_type, people, count(DISTINCT event_id) AS n_events, array_to_string(list_sort(list(DISTINCT date)), ',') AS dates FROM v WHERE event_type IN ('birth', 'death', 'wedding', 'move') AND date IS NOT NULL AND people <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT date) > 1""",
    "name_variants": f"""WITH m AS (SELECT DISTINCT ON (mention_id) family_id AS record, mention_id, name, aliases FROM people_mentions),
v AS (SELECT record, mention_id, 0 AS pos, 'primary' AS variant_type, name AS surface FROM m UNION ALL SELECT record, mention_id, generate_subscripts(aliases, 1), 'explicit_alias', unnest(aliases) FROM m),
n AS (SELECT *, {norm('surface')} AS norm FROM v WHERE surface IS NOT NULL)
SELECT record, mention_id, variant_type, surface, norm FROM (SELECT *, row_number() OVER (PARTITION BY record, mention_id, norm ORDER BY pos) AS r FROM n WHERE norm <> '') WHERE r = 1""",
    "correction_cues": f"""SELECT cue, count(*) AS n FROM (SELECT DISTINCT case_id, {norm('transcript.full_text')} AS t FROM benchmark_cases) JOIN (VALUES {', '.join(f"('{c}')" for c in kinship.CORRECTIONS)}) v(cue) ON contains(' ' || t || ' ', ' ' || cue || ' ') GROUP BY 1""",
    "open_statements": f"""WITH c AS (SELECT DISTINCT case_id, reference_text AS ref, request.transcript.full_text AS hyp FROM e2e_cases WHERE reference_text IS NOT NULL AND request.transcript.full_text IS NOT NULL),
s AS (SELECT case_id, hyp, unnest({stmts('ref')}) AS s FROM c)
SELECT case_id, CAST(sum(CASE WHEN {' OR '.join(f"contains({norm('s')}, '{x}')" for x in lexicon.OPEN_SIGNALS)} THEN 1 ELSE 0 END) AS BIGINT) AS n_open,
CAST(sum(CASE WHEN len(list_filter({sig('s')}, lambda w: NOT list_contains([{', '.join(repr(x) for x in lexicon.QUESTION_WORDS)}], w) AND NOT list_contains({sig('hyp')}, w))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_adding,
CAST(sum(CASE WHEN list_has_any({words('hyp')}, [{', '.join(repr(x) for x in lexicon.NEGATION)}]) AND NOT list_has_any({words('s')}, [{', '.join(repr(x) for x in lexicon.NEGATION)}]) THEN 1 ELSE 0 END) AS BIGINT) AS n_dropping FROM s GROUP BY 1""",
    "provenance_activities": """WITH c AS (SELECT DISTINCT case_id AS record, transcript.recording_id AS recording_id, transcript.asr_model AS m, transcript.asr_revision AS v FROM benchmark_cases),
a AS (SELECT record, recording_id, 'asr' AS stage, m AS system, v AS version FROM c UNION ALL SELECT record, recording_id, 'extractor', 'recorded', '1' FROM c UNION ALL SELECT record, recording_id, 'sanitizer', 'evigraph', '1' FROM c)
SELECT *, 'activity_' || substr(sha256(coalesce(recording_id, '') || chr(31) || stage || chr(31) || coalesce(system, '') || chr(31) || coalesce(version, '')), 1, 32) AS activity_id FROM a""",
}
