"""Queries of evidence, contract, ledger, resolution, evaluation, traces and speech over the project's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions import lexicon
from evigraph.functions import text as X
from evigraph.operators import contract, evaluation, evidence, ledger, nested, resolution, speech, traces
from evigraph.plans.hierarchies import table_sql
from evigraph.plans.text_queries import low, norm, sig
from evigraph.runtime import read


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.segments_of(read(spark, sf_dir, "benchmark_cases"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "family_graph_edges").dropDuplicates(["edge_id"])


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "people_mentions").dropDuplicates(["mention_id"])


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "known_profiles").withColumn("_p", F.col("person.person_id")).dropDuplicates(["_p"]).drop("_p")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "processing_trace_events")


# evidence


def offset_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracted evidence of every transcript with its offsets, as claimed or recovered."""
    e = nested.typed(nested.stored(nested.project_records(lambda t: read(spark, sf_dir, t))), "evidence_spans").where("source = 'benchmark_cases'")
    c = e.select(F.col("record_id").alias("record"), F.col("entity_id").alias("evidence_id"), "segment_id", "text", "start_char", "end_char")
    return evidence.recover_offsets(c, _segments(spark, sf_dir))


def offset_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence cut from every segment, with right, missing and wrong offsets, and some of a segment that does not exist."""
    s = _segments(spark, sf_dir)
    n = F.col("seg_ord") % 4
    text = F.substring("text", F.lit(6), F.lit(12))
    c = s.where(F.length("text") > 20).select(
        "record",
        F.concat_ws("-", "record", "segment_id").alias("evidence_id"),
        F.when(F.col("seg_ord") % 7 == 6, F.lit("seg_none")).otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(n == 3, F.substring("text", F.lit(1), F.lit(1))).otherwise(text).alias("text"),
        F.when(n == 0, F.lit(5)).when(n == 1, F.lit(None)).otherwise(F.lit(2)).cast("int").alias("start_char"),
        F.when(n == 0, F.lit(17)).when(n == 1, F.lit(None)).otherwise(F.lit(14)).cast("int").alias("end_char"),
    )
    return evidence.recover_offsets(c, s)


def evidence_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and where first, the second word of every segment occurs in it."""
    s = _segments(spark, sf_dir).withColumn("w", F.get(F.split("text", " "), F.lit(1))).where("w is not null and w <> ''")
    o = X.occurrences(F.col("text"), F.col("w"))
    return s.select("record", "segment_id", F.size(o).cast("bigint").alias("n_occurrences"), F.get(o, F.lit(0)).cast("bigint").alias("first_char"))


def sliding_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one or two segments of every transcript."""
    return evidence.context_windows(_segments(spark, sf_dir)).select("record", F.col("seg_ord").cast("bigint").alias("seg_ord"), "n", "norm")


def top_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six windows of every transcript."""
    return evidence.top_contexts(evidence.context_windows(_segments(spark, sf_dir))).select("record", "rank", "n", "text")


def previous_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment and whether the one before it fits beside it."""
    return evidence.previous_context(_segments(spark, sf_dir)).select("record", "segment_id", F.col("joint_chars").cast("bigint").alias("joint_chars"), "has_previous")


def _events_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.once(_events(spark, sf_dir)).select("event_id", "family_id", "stage", "outcome", F.unix_millis("created_at").cast("double").alias("ms"), F.coalesce("duration_ms", F.lit(0)).alias("size"))


def nearest_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every failed event: the nearest event of its family within ten minutes after it."""
    e = _events_ms(spark, sf_dir)
    left = e.where("outcome = 'failed'").select("event_id", "family_id", F.col("ms").alias("at"))
    right = e.select("family_id", F.col("event_id").alias("next_id"), F.col("ms").alias("start"), "size")
    j = evidence.nearest_after(left, right, ["family_id"], "at", "start", 600_000.0, "size").where("event_id <> next_id")
    return j.groupBy("event_id").agg(F.min(F.struct("distance", -F.col("size"), "next_id")).alias("m")).select("event_id", F.col("m.next_id").alias("next_id"), "m.distance")


def unique_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed events with exactly one other stage within ten minutes after them in their family."""
    e = _events_ms(spark, sf_dir)
    left = e.where("outcome = 'failed'").select("event_id", "family_id", F.col("ms").alias("at"), F.col("stage").alias("own"))
    right = e.select("family_id", "stage", F.col("ms").alias("start"), "size")
    j = evidence.nearest_after(left, right, ["family_id"], "at", "start", 600_000.0, "size").where("stage <> own")
    return evidence.unique_near(j, ["event_id"], "stage")


def unknown_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that no profile describes."""
    e = _edges(spark, sf_dir).select("edge_id", F.array_compact(F.array("subject_person_id", "object_person_id")).alias("ends"))
    known = read(spark, sf_dir, "known_profiles").select("person.person_id")
    return evidence.unknown_references(e, "edge_id", "ends", known, "person_id")


def weakest_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest evidence class of each family's mentions, by how they are asserted."""
    cls = F.when(F.col("assertion_mode") == "explicit", "A_explicit").when(F.col("assertion_mode") == "uncertain", "U_uncertain").otherwise("E_inferred")
    m = _mentions(spark, sf_dir).groupBy("family_id").agg(F.collect_set(cls).alias("classes"))
    return m.select("family_id", evidence.weakest_class(F.col("classes")).alias("weakest"))


# contract


def mention_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by the first rule that they violate."""
    return contract.issue_counts(contract.quarantine(_mentions(spark, sf_dir), contract.mention_rules())[1])


def edge_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that violate a rule, with the rule."""
    return contract.quarantine(_edges(spark, sf_dir), contract.edge_rules())[1].select("edge_id", "issue_code")


def segment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments accepted and in quarantine."""
    good, bad = contract.quarantine(_segments(spark, sf_dir), contract.segment_rules())
    return good.select(F.lit("accepted").alias("outcome")).unionAll(bad.select("issue_code")).groupBy("outcome").agg(F.count("*").alias("n"))


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mention of every name of a family."""
    m = _mentions(spark, sf_dir).withColumn("key", X.name_key(F.col("name"))).where("key <> ''")
    return contract.first_wins(m, ["family_id", "key"], [F.col("mention_id")]).select("family_id", "key", "mention_id")


def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a family and category that come more than once, and how many mentions that drops."""
    m = _mentions(spark, sf_dir).withColumn("key", X.name_key(F.col("name")))
    return contract.dropped_by(m, ["family_id", "category", "key"])


def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that were delivered more than once."""
    return contract.dropped_by(_events(spark, sf_dir), ["event_id"])


def result_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings and results by which of the two there is."""
    return contract.coverage(read(spark, sf_dir, "recordings"), read(spark, sf_dir, "pipeline_results"), "recording_id").groupBy("side").agg(F.count("*").alias("n"))


def recordings_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings joined with their results, by family."""
    r = read(spark, sf_dir, "recordings").dropDuplicates(["recording_id"])
    p = read(spark, sf_dir, "pipeline_results").select("recording_id", F.length("payload").alias("size")).dropDuplicates(["recording_id"])
    return r.join(p, "recording_id").groupBy("family_id").agg(F.count("*").alias("n_results"), F.sum(F.coalesce("size", F.lit(0))).cast("bigint").alias("n_chars"))


# ledger


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of every family with the claims that state its edges."""
    return ledger.graph(_edges(spark, sf_dir))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of persons whose relationship is stated in more than one way, in type, parent or roles."""
    return ledger.pair_conflicts(_edges(spark, sf_dir))


def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one person of a family has."""
    return ledger.alias_conflicts(ledger.profile_names(read(spark, sf_dir, "known_profiles")))


def claim_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the later half of a year that the earlier half does not have."""
    c = ledger.claim_ids(_edges(spark, sf_dir))
    cut = F.lit("2026-07-01").cast("timestamp")
    old, new = c.where(F.col("created_at") < cut), c.where(F.col("created_at") >= cut)
    return ledger.insert_absent(old, new, "claim_id").select("claim_id", "relationship_type")


def people_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and mentions of every name of a family: the newest category and the union of their segments."""
    m = _mentions(spark, sf_dir).withColumn("key", X.name_key(F.col("name"))).where("key <> ''")
    out = ledger.upsert(m, ["family_id", "key"], ["category"], ["mention_id"], ["source_segment_ids"])
    return out.select("family_id", "key", "category", F.array_join("source_segment_ids", ",").alias("segments"))


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person with parents, children, spouses and siblings."""
    return ledger.adjacency(read(spark, sf_dir, "known_profiles"), _edges(spark, sf_dir))


def profile_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every person."""
    return ledger.facets(read(spark, sf_dir, "known_profiles"))


def replay_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the graph that does not depend on the order of rows or partitions."""
    return ledger.digest(graph_edges(spark, sf_dir), ["family_id", "relationship_type", "subject", "object", "claims"])


# resolution


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every mention with the rules that made them."""
    s = resolution.name_signals(_mentions(spark, sf_dir), read(spark, sf_dir, "known_profiles"))
    return s.select("mention_id", "person_id", F.array_join("rules", ",").alias("rules"))


def resolver_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules make of every mention."""
    return resolution.resolve(_mentions(spark, sf_dir), _profiles(spark, sf_dir))


def graph_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved people of one recording whom an edge joins."""
    m = _mentions(spark, sf_dir)
    return resolution.graph_signals(resolution.resolve(m, _profiles(spark, sf_dir)), m, _edges(spark, sf_dir))


# evaluation


def _case_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "e2e_cases").select("case_id", F.col("reference_text").alias("ref"), F.col("request.transcript.full_text").alias("hyp")).distinct().where("ref is not null and hyp is not null")
    return c.select("case_id", F.explode(X.significant(F.col("hyp"))).alias("w")), c.select("case_id", F.explode(X.significant(F.col("ref"))).alias("w"))


def prf_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the words of every transcript against its reference."""
    return evaluation.prf(evaluation.multiset_counts(*_case_words(spark, sf_dir), ["case_id"], "w"))


def prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all cases."""
    return evaluation.micro(evaluation.multiset_counts(*_case_words(spark, sf_dir), ["case_id"], "w"))


def word_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of every transcript with their kinds."""
    c = read(spark, sf_dir, "e2e_cases").select("case_id", "language", F.col("reference_text").alias("ref"), F.col("request.transcript.full_text").alias("hyp")).distinct().where("ref is not null and hyp is not null")
    return c.select("case_id", "language", evaluation.word_edits(X.normalize(F.col("ref")), X.normalize(F.col("hyp"))).alias("e")).select("case_id", "language", "e.*")


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate by language and over all."""
    return evaluation.error_rates(word_edits(spark, sf_dir), "language")


def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of references and transcripts by language and over all, by grouping sets."""
    c = read(spark, sf_dir, "e2e_cases").select("case_id", "language", F.col("reference_text").alias("ref"), F.col("request.transcript.full_text").alias("hyp")).distinct()
    n = lambda t: F.coalesce(F.size(X.words(F.col(t))), F.lit(0))
    return c.rollup("language").agg(F.count("*").alias("n_cases"), F.sum(n("ref")).alias("n_ref_words"), F.sum(n("hyp")).alias("n_hyp_words"))


def gate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the word comparison against thresholds."""
    return evaluation.gate(prf_micro(spark, sf_dir), [("precision", 0.9, None), ("recall", 0.9, None), ("fn", None, 100.0), ("tp", 1.0, None)])


def _exact_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, person_id) of mentions whose name is a name of exactly one person of their family."""
    names = ledger.profile_names(read(spark, sf_dir, "known_profiles")).select("family_id", "person_id", X.name_key(F.col("name")).alias("key")).where("key <> ''")
    m = _mentions(spark, sf_dir).select("mention_id", "family_id", X.name_key(F.col("name")).alias("key"))
    return evaluation.unique_keys(m.join(names, ["family_id", "key"]), "mention_id", "person_id")


def unique_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one person of every mention whose name only that person has."""
    return _exact_people(spark, sf_dir)


def person_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the people of every family that its mentions name exactly."""
    mapped = _mentions(spark, sf_dir).select("mention_id", "family_id").join(_exact_people(spark, sf_dir), "mention_id", "left")
    gold = read(spark, sf_dir, "known_profiles").select("family_id", "person.person_id")
    return evaluation.prf(evaluation.person_counts(mapped, gold, "family_id", "person_id"))


def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of every family beyond the first of their name and category."""
    m = _mentions(spark, sf_dir).withColumn("key", X.name_key(F.col("name")))
    return evaluation.duplicates(m, "family_id", ["key", "category"])


def resolution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-based resolver against exact unique names, by family."""
    m = _mentions(spark, sf_dir)
    exact = _exact_people(spark, sf_dir).withColumnRenamed("person_id", "gold_person")
    gold = m.select("mention_id", "family_id").join(exact, "mention_id").withColumn("gold_status", F.lit("resolved"))
    return evaluation.resolution_scores(resolution.resolve(m, _profiles(spark, sf_dir)), gold, "family_id")


def citation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every family whose ends are all known, of all its edges."""
    e = _edges(spark, sf_dir).select("family_id", F.array_compact(F.array("subject_person_id", "object_person_id")).alias("ends"))
    known = read(spark, sf_dir, "known_profiles").select("family_id", F.col("person.person_id").alias("id"))
    return evaluation.closure(e, "ends", known, "family_id")


# traces


def job_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and attempts of every job by stage."""
    return traces.stage_totals(_events(spark, sf_dir))


def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, attempts and outcome of every job."""
    return traces.job_totals(_events(spark, sf_dir))


def trace_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that may leave the system."""
    return traces.safe_attributes(_events(spark, sf_dir))


def trace_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between consecutive events of a trace."""
    return traces.gaps(_events(spark, sf_dir))


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that came after newer ones of their job, by stage."""
    return traces.late(_events(spark, sf_dir))


def retention_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose traces retention would delete."""
    return traces.expired(_events(spark, sf_dir), "2026-06-01")


def runtime_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings over the budget of time."""
    return traces.over_budget(_events(spark, sf_dir), 5_000)


def stage_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of every stage."""
    return traces.stage_quantiles(_events(spark, sf_dir))


def latest_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest recording of every family."""
    r = read(spark, sf_dir, "recordings").select("family_id", "recording_id", "created_at", "speaker_name")
    return traces.latest(r, "family_id", ["created_at", "recording_id"]).select("family_id", "recording_id", "speaker_name")


def newest_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest recordings: the report's own limit."""
    r = read(spark, sf_dir, "recordings").dropDuplicates(["recording_id"])
    return r.orderBy(F.desc("created_at"), "recording_id").limit(20).select("recording_id", "family_id")


# speech


def smart_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments merged to chunks of at most 22 seconds."""
    out = speech.smart_ranges(_segments(spark, sf_dir).select("record", "start", "end"), "record")
    return out.select("record", F.col("chunk").cast("bigint").alias("chunk"), "start", "end")


def edge_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks widened at their edges within the recording."""
    total = read(spark, sf_dir, "benchmark_cases").select(F.col("case_id").alias("record"), F.col("transcript.duration_seconds").alias("total")).dropDuplicates(["record"])
    return speech.padded(_segments(spark, sf_dir).join(total, "record"), "total").select("record", "segment_id", "padded_start", "padded_end")


def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by which a segment ends and the next begins."""
    w = Window.partitionBy("record").orderBy("seg_ord")
    s = _segments(spark, sf_dir).withColumn("next", F.lead("text").over(w)).where("next is not null")
    return s.select("record", "segment_id", speech.shared_words(F.col("text"), F.col("next"), F.lit(lexicon.OVERLAP_WORDS)).cast("bigint").alias("n_shared"))


def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined to one text, words of overlapping audio once."""
    s = _segments(spark, sf_dir).select("record", "start", F.col("seg_ord").alias("index"), "end", "text")
    return speech.merge_parts(s, "record").select("record", F.length("text").cast("bigint").alias("n_chars"), F.col("n_words_removed").cast("bigint").alias("n_words_removed"))


QUERIES = {
    f.__name__: f
    for f in (
        offset_recovery, offset_scenarios, evidence_occurrences, sliding_contexts, top_contexts, previous_context, nearest_after, unique_near, unknown_persons, weakest_assertion,
        mention_issues, edge_issues, segment_issues, first_wins, semantic_dedup, repeated_deliveries, result_coverage, recordings_with_results,
        graph_edges, conflict_pairs, alias_conflicts, claim_insert_absent, people_upsert, neighbour_context, profile_facets, replay_digest,
        name_candidates, resolver_status, graph_signals,
        prf_multiset, prf_micro, word_edits, error_rates, text_sizes, gate_check, unique_people, person_metrics, duplicate_counts, resolution_scores, citation_closure,
        job_trace, job_totals, trace_sanitize, trace_gaps, late_events, retention_preview, runtime_budget, stage_quantiles, latest_recording, newest_recordings,
        smart_ranges, edge_padding, shared_words, merged_parts,
    )
}

_S = "s AS (SELECT record, g.segment_id AS segment_id, g.start AS start, g.\"end\" AS \"end\", g.text AS text, i - 1 AS seg_ord FROM (SELECT case_id AS record, unnest(transcript.segments) AS g, generate_subscripts(transcript.segments, 1) AS i FROM (SELECT case_id, any_value(transcript) AS transcript FROM benchmark_cases GROUP BY case_id)))"
_M = "m AS (SELECT DISTINCT * FROM people_mentions)"
_G = "e AS (SELECT DISTINCT * FROM family_graph_edges)"
_PARENT = "CASE WHEN object_role = 'parent' AND coalesce(subject_role, '') <> 'parent' THEN object_person_id ELSE subject_person_id END"
_EV = "ev AS (SELECT DISTINCT ON (event_id) * FROM processing_trace_events)"
_KEY = rf"regexp_replace({low('name')}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def _key(x: str) -> str:
    return rf"regexp_replace({low(x)}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"


_OCC = "list_filter(range(1, greatest(length(source) - length(text) + 2, 1)), lambda i: substring(source, i, length(text)) = text)"
_WINDOWS = f"""{_S}, nx AS (SELECT *, lead(text) OVER (PARTITION BY record ORDER BY seg_ord) AS nxt FROM s),
w AS (SELECT record, seg_ord, 1 AS n, text FROM nx UNION ALL SELECT record, seg_ord, 2, text || ' ' || nxt FROM nx WHERE nxt IS NOT NULL),
x AS (SELECT *, {norm('text')} AS norm FROM w WHERE length(text) <= {lexicon.CONTEXT_CHARS}),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record, norm ORDER BY seg_ord, n) AS r FROM x) WHERE r = 1)"""
_NEAR = f"{_EV}, t AS (SELECT event_id, family_id, stage, outcome, CAST(epoch_ms(created_at) AS DOUBLE) AS ms, coalesce(duration_ms, 0) AS size FROM ev)"
_NAMES = "nm AS (SELECT DISTINCT family_id, person.person_id AS person_id, person.canonical_name AS name FROM known_profiles UNION SELECT family_id, person.person_id, unnest(person.aliases) FROM known_profiles)"
_MK = f"mk AS (SELECT DISTINCT mention_id, family_id, {_key('surface')} AS key, k FROM (SELECT mention_id, family_id, name AS surface, 'name' AS k FROM people_mentions UNION ALL SELECT mention_id, family_id, unnest(aliases), 'alias' FROM people_mentions) WHERE surface IS NOT NULL)"
_PK = f"pk AS (SELECT DISTINCT family_id, person_id, {_key('surface')} AS key, k FROM (SELECT family_id, person.person_id AS person_id, person.canonical_name AS surface, 'canonical' AS k FROM known_profiles UNION ALL SELECT family_id, person.person_id, unnest(person.aliases), 'alias' FROM known_profiles UNION ALL SELECT family_id, person.person_id, unnest(verified_aliases), 'verified_alias' FROM known_profiles) WHERE surface IS NOT NULL)"
_CAND = f"{_MK}, {_PK}, c AS (SELECT mention_id, person_id, list_sort(list(DISTINCT mk.k || '_matches_' || pk.k)) AS rules FROM mk JOIN pk USING (family_id, key) WHERE key <> '' GROUP BY 1, 2)"
_EXACT = f"{_NAMES}, ek AS (SELECT DISTINCT family_id, person_id, {_KEY} AS key FROM nm WHERE name IS NOT NULL AND {_KEY} <> ''), ex AS (SELECT mention_id, min(person_id) AS person_id FROM (SELECT DISTINCT mention_id, family_id, {_KEY} AS key FROM people_mentions) JOIN ek USING (family_id, key) GROUP BY 1 HAVING count(DISTINCT person_id) = 1)"
_GEN = "CASE " + " ".join(f"WHEN {{r}} IN ({', '.join(repr(w) for w in ws)}) THEN {g}" for g, ws in lexicon.GENERATIONS.items()) + " END"
_RESOLVE = f"""{_CAND},
mm AS (SELECT DISTINCT ON (mention_id) mention_id, recording_id, category AS mc, {norm('relation_to_speaker')} AS mr, assertion_mode AS am FROM people_mentions),
pp AS (SELECT DISTINCT ON (person.person_id) person.person_id AS person_id, person.category AS pc, {norm('person.relation_to_speaker')} AS pr, generation_relative_to_speaker AS pg FROM known_profiles),
j AS (SELECT mention_id, person_id, len(list_filter(rules, lambda r: ends_with(r, 'verified_alias'))) > 0 AS verified,
  coalesce(mc, 'unknown') <> 'unknown' AND coalesce(pc, 'unknown') <> 'unknown' AND ((mc = 'family_member') <> (pc = 'family_member')) AS conflict,
  coalesce(mr = pr, false) AS sr, coalesce({_GEN.format(r='mr')} = pg, false) AS sg, coalesce(am, '') = 'uncertain' AS un FROM c JOIN mm USING (mention_id) JOIN pp USING (person_id)),
k AS (SELECT mention_id, count(*) AS n, sum(CASE WHEN verified THEN 1 ELSE 0 END) AS nv, sum(CASE WHEN NOT conflict THEN 1 ELSE 0 END) AS nc, sum(CASE WHEN NOT un AND NOT conflict AND (verified OR (sr AND sg)) THEN 1 ELSE 0 END) AS ns, min(CASE WHEN NOT un AND NOT conflict AND (verified OR (sr AND sg)) THEN person_id END) AS p FROM j GROUP BY 1),
res AS (SELECT mm.mention_id, CASE WHEN n IS NULL THEN 'new_person' WHEN nv <= 1 AND nc = 1 AND ns = 1 THEN 'resolved' ELSE 'needs_review' END AS status, CASE WHEN nv <= 1 AND nc = 1 AND ns = 1 THEN p END AS person_id, coalesce(n, 0) AS n_candidates FROM mm LEFT JOIN k USING (mention_id))"""
_GRAPH = f"""{_G}, o AS (SELECT *, {{'p': coalesce(subject_person_id, ''), 'r': coalesce(subject_role, '')}} AS a, {{'p': coalesce(object_person_id, ''), 'r': coalesce(object_role, '')}} AS b FROM e),
q AS (SELECT family_id, relationship_type, source_claim_ids, CASE WHEN relationship_type IN ('spouse', 'sibling') AND (b.p < a.p OR (b.p = a.p AND b.r < a.r)) THEN b ELSE a END AS s, CASE WHEN relationship_type IN ('spouse', 'sibling') AND (b.p < a.p OR (b.p = a.p AND b.r < a.r)) THEN a ELSE b END AS t FROM o),
gr AS (SELECT family_id, relationship_type, s.p AS subject, s.r AS subject_role, t.p AS object, t.r AS object_role, unnest(CASE WHEN len(source_claim_ids) > 0 THEN source_claim_ids ELSE [NULL] END) AS claim FROM q WHERE s.p <> '' AND t.p <> ''),
graph AS (SELECT family_id, relationship_type, subject, subject_role, object, object_role, count(DISTINCT claim) AS n_claims, coalesce(array_to_string(list_sort(list(DISTINCT claim) FILTER (claim IS NOT NULL)), ','), '') AS claims FROM gr GROUP BY ALL)"""
_WORDS = f"cs AS (SELECT DISTINCT case_id, reference_text AS ref, request.transcript.full_text AS hyp FROM e2e_cases), a AS (SELECT case_id, w, count(*) AS a FROM (SELECT case_id, unnest({sig('hyp')}) AS w FROM cs WHERE ref IS NOT NULL AND hyp IS NOT NULL) GROUP BY 1, 2), b AS (SELECT case_id, w, count(*) AS b FROM (SELECT case_id, unnest({sig('ref')}) AS w FROM cs WHERE ref IS NOT NULL AND hyp IS NOT NULL) GROUP BY 1, 2), f AS (SELECT case_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (case_id, w)), n AS (SELECT case_id, sum(least(a, b)) AS tp, sum(greatest(a - b, 0)) AS fp, sum(greatest(b - a, 0)) AS fn FROM f GROUP BY 1)"


def _prf(table: str, key: str = "") -> str:
    p, r = "CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END"
    return f"SELECT {key}CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {p} AS precision, {r} AS recall, CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END AS f1 FROM {table}"


_TOTAL = "(SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM n)"

_RECOVERED = f"""j AS (SELECT c.*, s.text AS source, coalesce(substring(s.text, a + 1, length(c.text)) = c.text AND b - a = length(c.text), false) AS valid FROM c LEFT JOIN s USING (record, segment_id)),
k AS (SELECT *, CASE WHEN source IS NULL OR valid THEN [] ELSE {_OCC} END AS f FROM j),
l AS (SELECT *, CASE WHEN source IS NULL THEN 'unknown_segment' WHEN valid THEN 'already_valid' WHEN len(f) = 1 THEN 'recovered' WHEN len(f) > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM k),
z AS (SELECT *, CASE WHEN status = 'already_valid' THEN a WHEN status = 'recovered' THEN f[1] - 1 END AS st FROM l)
SELECT record, evidence_id, segment_id, status, CAST(st AS INTEGER) AS start_char, CAST(st + length(text) AS INTEGER) AS end_char FROM z"""

ORACLES = {
    "offset_recovery": f"""WITH {table_sql()}, {_S}, c AS (SELECT DISTINCT record_id AS record, id AS evidence_id, json_extract_string(obj, '$.segment_id') AS segment_id, json_extract_string(obj, '$.text') AS text, TRY_CAST(json_extract_string(obj, '$.start_char') AS INTEGER) AS a, TRY_CAST(json_extract_string(obj, '$.end_char') AS INTEGER) AS b FROM o_evidence_spans WHERE source = 'benchmark_cases'), {_RECOVERED}""",
    "offset_scenarios": f"""WITH {_S}, c AS (SELECT record, record || '-' || segment_id AS evidence_id, CASE WHEN seg_ord % 7 = 6 THEN 'seg_none' ELSE segment_id END AS segment_id, CASE WHEN seg_ord % 4 = 3 THEN substring(text, 1, 1) ELSE substring(text, 6, 12) END AS text,
CASE WHEN seg_ord % 4 = 0 THEN 5 WHEN seg_ord % 4 = 1 THEN NULL ELSE 2 END AS a, CASE WHEN seg_ord % 4 = 0 THEN 17 WHEN seg_ord % 4 = 1 THEN NULL ELSE 14 END AS b FROM s WHERE length(text) > 20), {_RECOVERED}""",
    "evidence_occurrences": f"WITH {_S}, w AS (SELECT record, segment_id, text AS source, string_split(text, ' ')[2] AS text FROM s), o AS (SELECT *, {_OCC} AS f FROM w WHERE text IS NOT NULL AND text <> '') SELECT record, segment_id, CAST(len(f) AS BIGINT) AS n_occurrences, CAST(f[1] - 1 AS BIGINT) AS first_char FROM o",
    "sliding_contexts": f"WITH {_WINDOWS} SELECT record, CAST(seg_ord AS BIGINT) AS seg_ord, n, norm FROM y",
    "top_contexts": f"WITH {_WINDOWS} SELECT record, CAST(rank AS INTEGER) AS rank, n, text FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY n, length(text), text, seg_ord) AS rank FROM y) WHERE rank <= {lexicon.TOP_CONTEXTS}",
    "previous_context": f"WITH {_S}, p AS (SELECT *, lag(text) OVER (PARTITION BY record ORDER BY seg_ord) AS b FROM s) SELECT record, segment_id, CASE WHEN length(text) + length(b) + 1 <= {lexicon.CONTEXT_CHARS} THEN length(text) + length(b) + 1 ELSE length(text) END AS joint_chars, coalesce(length(text) + length(b) + 1 <= {lexicon.CONTEXT_CHARS}, false) AS has_previous FROM p",
    "nearest_after": f"WITH {_NEAR}, j AS (SELECT a.event_id, b.event_id AS next_id, b.ms - a.ms AS distance, b.size FROM t a JOIN t b ON a.family_id = b.family_id AND b.ms >= a.ms AND b.ms - a.ms <= 600000 AND a.event_id <> b.event_id WHERE a.outcome = 'failed') SELECT event_id, next_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, -size, next_id) AS r FROM j) WHERE r = 1",
    "unique_near": f"WITH {_NEAR}, j AS (SELECT a.event_id, b.stage FROM t a JOIN t b ON a.family_id = b.family_id AND b.ms >= a.ms AND b.ms - a.ms <= 600000 AND b.stage <> a.stage WHERE a.outcome = 'failed') SELECT event_id, min(stage) AS stage FROM j GROUP BY 1 HAVING count(DISTINCT stage) = 1",
    "unknown_persons": f"WITH {_G} SELECT DISTINCT edge_id, reference FROM (SELECT edge_id, subject_person_id AS reference FROM e UNION SELECT edge_id, object_person_id FROM e) WHERE reference IS NOT NULL AND reference NOT IN (SELECT person.person_id FROM known_profiles)",
    "weakest_assertion": "SELECT family_id, CASE max(CASE WHEN assertion_mode = 'explicit' THEN 1 WHEN assertion_mode = 'uncertain' THEN 6 ELSE 5 END) WHEN 1 THEN 'A_explicit' WHEN 6 THEN 'U_uncertain' ELSE 'E_inferred' END AS weakest FROM people_mentions GROUP BY 1",
    "mention_issues": f"WITH {_M}, i AS (SELECT CASE WHEN mention_id IS NULL THEN 'mention_id_missing' WHEN NOT coalesce(length(trim(name)) > 0, false) THEN 'name_empty' WHEN NOT coalesce(len(source_segment_ids) > 0, false) THEN 'source_segments_missing' WHEN confidence IS NOT NULL AND NOT confidence BETWEEN 0 AND 1 THEN 'confidence_invalid' WHEN NOT coalesce(verification_status = 'unreviewed', false) THEN 'status_not_unreviewed' WHEN NOT coalesce(relation_to_speaker IS NOT NULL OR category <> 'family_member', false) THEN 'relation_missing' END AS issue_code FROM m) SELECT issue_code, count(*) AS n_issues FROM i WHERE issue_code IS NOT NULL GROUP BY 1",
    "edge_issues": f"WITH {_G}, i AS (SELECT edge_id, CASE WHEN subject_person_id IS NULL THEN 'subject_missing' WHEN object_person_id IS NULL THEN 'object_missing' WHEN subject_person_id = object_person_id THEN 'endpoints_equal' WHEN NOT coalesce(CASE relationship_type WHEN 'parent_child' THEN (subject_role = 'parent' AND object_role = 'child') OR (subject_role = 'child' AND object_role = 'parent') WHEN 'spouse' THEN subject_role = 'spouse' AND object_role = 'spouse' WHEN 'sibling' THEN contains(subject_role, 'sibling') AND contains(object_role, 'sibling') ELSE false END, false) THEN 'roles_illegal' END AS issue_code FROM e) SELECT edge_id, issue_code FROM i WHERE issue_code IS NOT NULL",
    "segment_issues": f"WITH {_S} SELECT CASE WHEN coalesce(segment_id, '') = '' THEN 'segment_id_missing' WHEN NOT coalesce(start >= 0 AND \"end\" > start, false) THEN 'segment_span_invalid' WHEN NOT coalesce(length(trim(text)) > 0, false) THEN 'segment_text_empty' ELSE 'accepted' END AS outcome, count(*) AS n FROM s GROUP BY 1",
    "first_wins": f"SELECT family_id, key, min(mention_id) AS mention_id FROM (SELECT family_id, mention_id, {_KEY} AS key FROM people_mentions) WHERE key <> '' GROUP BY 1, 2",
    "semantic_dedup": f"WITH {_M} SELECT family_id, category, {_KEY} AS key, count(*) - 1 AS n_dropped FROM m GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "repeated_deliveries": "SELECT event_id, count(*) - 1 AS n_dropped FROM processing_trace_events GROUP BY 1 HAVING count(*) > 1",
    "result_coverage": "SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side, count(*) AS n FROM (SELECT DISTINCT recording_id AS a FROM recordings) FULL JOIN (SELECT DISTINCT recording_id AS b FROM pipeline_results) ON a = b GROUP BY 1",
    "recordings_with_results": "SELECT family_id, count(*) AS n_results, CAST(sum(coalesce(size, 0)) AS BIGINT) AS n_chars FROM (SELECT DISTINCT recording_id, family_id FROM recordings) JOIN (SELECT DISTINCT recording_id, length(payload) AS size FROM pipeline_results) USING (recording_id) GROUP BY 1",
    "graph_edges": f"WITH {_GRAPH} SELECT * FROM graph",
    "conflict_pairs": f"""WITH {_G}, r AS (SELECT *, {{'p': subject_person_id, 'r': coalesce(subject_role, relationship_type)}} AS a, {{'p': object_person_id, 'r': coalesce(object_role, relationship_type)}} AS b FROM e WHERE subject_person_id IS NOT NULL AND object_person_id IS NOT NULL),
g AS (SELECT *, relationship_type || '|' || CASE WHEN relationship_type = 'parent_child' THEN {_PARENT} ELSE array_to_string(list_sort([a.p || chr(31) || a.r, b.p || chr(31) || b.r]), '|') END AS signature FROM r)
SELECT family_id, least(subject_person_id, object_person_id) AS first_id, greatest(subject_person_id, object_person_id) AS second_id, count(DISTINCT relationship_type) AS n_types, array_to_string(list_sort(list(DISTINCT relationship_type)), ',') AS types, count(DISTINCT edge_id) AS n_edges FROM g GROUP BY 1, 2, 3 HAVING count(DISTINCT signature) > 1""",
    "alias_conflicts": f"WITH {_NAMES} SELECT family_id, {_KEY} AS key, count(DISTINCT person_id) AS n_people, array_to_string(list_sort(list(DISTINCT person_id)), ',') AS people FROM nm WHERE name IS NOT NULL AND {_KEY} <> '' GROUP BY 1, 2 HAVING count(DISTINCT person_id) > 1",
    "claim_insert_absent": f"WITH {_G}, c AS (SELECT *, 'claim_' || substr(sha256(concat_ws(chr(31), coalesce(family_id, ''), coalesce(relationship_type, ''), coalesce(subject_person_id, ''), coalesce(subject_role, ''), coalesce(object_person_id, ''), coalesce(object_role, ''))), 1, 32) AS claim_id FROM e) SELECT DISTINCT claim_id, relationship_type FROM c WHERE created_at >= TIMESTAMPTZ '2026-07-01 00:00:00+00' AND claim_id NOT IN (SELECT claim_id FROM c WHERE created_at < TIMESTAMPTZ '2026-07-01 00:00:00+00')",
    "people_upsert": f"WITH {_M}, k AS (SELECT *, {_KEY} AS key FROM m) SELECT family_id, key, arg_max(category, mention_id) AS category, array_to_string(list_sort(list_distinct(flatten(list(source_segment_ids)))), ',') AS segments FROM k WHERE key <> '' GROUP BY 1, 2",
    "neighbour_context": f"""WITH {_G}, two AS (SELECT *, {_PARENT} AS parent FROM e WHERE subject_person_id IS NOT NULL AND object_person_id IS NOT NULL),
b AS (SELECT subject_person_id AS p, object_person_id AS o, relationship_type AS t, parent FROM two UNION ALL SELECT object_person_id, subject_person_id, relationship_type, parent FROM two),
a AS (SELECT p, list_sort(list(DISTINCT o) FILTER (t = 'parent_child' AND (parent = o))) AS parents, list_sort(list(DISTINCT o) FILTER (t = 'parent_child' AND (parent = p))) AS children, list_sort(list(DISTINCT o) FILTER (t = 'spouse')) AS spouses, list_sort(list(DISTINCT o) FILTER (t = 'sibling')) AS siblings FROM b GROUP BY 1)
SELECT DISTINCT family_id, person.person_id AS person_id, coalesce(array_to_string(parents, ','), '') AS parents, coalesce(array_to_string(children, ','), '') AS children, coalesce(array_to_string(spouses, ','), '') AS spouses, coalesce(array_to_string(siblings, ','), '') AS siblings FROM known_profiles LEFT JOIN a ON p = person.person_id""",
    "profile_facets": f"WITH f AS (SELECT family_id, person.person_id AS person_id, 'canonical_name' AS predicate, person.canonical_name AS value FROM known_profiles UNION ALL SELECT family_id, person.person_id, 'category', person.category FROM known_profiles UNION ALL SELECT family_id, person.person_id, 'relation', person.relation_to_speaker FROM known_profiles UNION ALL SELECT family_id, person.person_id, 'generation', CAST(generation_relative_to_speaker AS VARCHAR) FROM known_profiles UNION ALL SELECT family_id, person.person_id, 'alias', unnest(person.aliases) FROM known_profiles) SELECT family_id, person_id, predicate, {norm('value')} AS value_key, min(value) AS value FROM f WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY 1, 2, 3, 4",
    "replay_digest": f"WITH {_GRAPH}, h AS (SELECT md5(concat_ws(chr(31), family_id, relationship_type, subject, object, claims)) AS h FROM graph) SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS VARCHAR) AS digest FROM h",
    "name_candidates": f"WITH {_CAND} SELECT mention_id, person_id, array_to_string(rules, ',') AS rules FROM c",
    "resolver_status": f"WITH {_RESOLVE} SELECT * FROM res",
    "graph_signals": f"WITH {_RESOLVE}, {_G}, seen AS (SELECT DISTINCT recording_id, person_id FROM res JOIN mm USING (mention_id) WHERE status = 'resolved' AND recording_id IS NOT NULL), ee AS (SELECT DISTINCT relationship_type, least(subject_person_id, object_person_id) AS a, greatest(subject_person_id, object_person_id) AS b FROM e WHERE subject_person_id IS NOT NULL AND object_person_id IS NOT NULL) SELECT s.recording_id, s.person_id, o.person_id AS neighbour_id, relationship_type FROM seen s JOIN ee ON a = s.person_id JOIN seen o ON o.recording_id = s.recording_id AND o.person_id = b",
    "prf_multiset": f"WITH {_WORDS} {_prf('n', 'case_id, ')}",
    "prf_micro": f"WITH {_WORDS} {_prf(_TOTAL)}",
    "text_sizes": f"WITH cs AS (SELECT DISTINCT case_id, language, reference_text AS ref, request.transcript.full_text AS hyp FROM e2e_cases), n AS (SELECT language, coalesce(len(list_filter(string_split({norm('ref')}, ' '), lambda t: t <> '')), 0) AS a, coalesce(len(list_filter(string_split({norm('hyp')}, ' '), lambda t: t <> '')), 0) AS b FROM cs) SELECT language, count(*) AS n_cases, CAST(sum(a) AS BIGINT) AS n_ref_words, CAST(sum(b) AS BIGINT) AS n_hyp_words FROM n GROUP BY ROLLUP (language)",
    "gate_check": f"WITH {_WORDS}, r AS ({_prf(_TOTAL)}) SELECT measure, value, CASE measure WHEN 'fn' THEN value <= 100 WHEN 'tp' THEN value >= 1 ELSE value >= 0.9 END AS passed FROM (SELECT 'precision' AS measure, precision AS value FROM r UNION ALL SELECT 'recall', recall FROM r UNION ALL SELECT 'fn', CAST(fn AS DOUBLE) FROM r UNION ALL SELECT 'tp', CAST(tp AS DOUBLE) FROM r)",
    "job_trace": f"WITH {_EV} SELECT job_id, stage, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms, count(DISTINCT attempt) AS n_attempts, count(*) AS n_events FROM ev GROUP BY 1, 2",
    "job_totals": f"WITH {_EV} SELECT job_id, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms, CAST(max(attempt) AS BIGINT) AS attempts, arg_max(outcome, {{'a': attempt, 's': sequence, 'e': event_id}}) AS outcome FROM ev GROUP BY 1",
    "trace_sanitize": f"WITH {_EV}, a AS (SELECT event_id, unnest(map_keys(attributes)) AS k, unnest(map_values(attributes)) AS v FROM ev) SELECT event_id, substring(lower(k), 1, 64) AS key, substring(v, 1, 256) AS value FROM a WHERE NOT ({' OR '.join(f'''contains(lower(k), '{p}')''' for p in lexicon.SENSITIVE_KEYS)})",
    "trace_gaps": f"WITH {_EV}, g AS (SELECT trace_id, event_id, created_at, lag(created_at) OVER (PARTITION BY trace_id ORDER BY attempt, sequence, event_id) AS p FROM ev) SELECT trace_id, event_id, CAST(trunc((epoch_us(created_at) - epoch_us(p)) / 1000.0) AS BIGINT) AS gap_ms FROM g WHERE p IS NOT NULL",
    "late_events": f"WITH {_EV}, g AS (SELECT stage, created_at, max(created_at) OVER (PARTITION BY job_id ORDER BY attempt, sequence, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ev) SELECT stage, count(*) AS n_events, CAST(sum(CASE WHEN newest IS NULL THEN NULL WHEN created_at < newest THEN 1 ELSE 0 END) AS BIGINT) AS n_late FROM g GROUP BY 1",
    "retention_preview": f"WITH {_EV}, j AS (SELECT job_id, max(created_at) AS l, arg_max(outcome, {{'a': attempt, 's': sequence, 'e': event_id}}) AS o, count(*) AS n FROM ev GROUP BY 1) SELECT job_id, n AS n_events FROM j WHERE l < TIMESTAMPTZ '2026-06-01 00:00:00+00' AND o IN ('succeeded', 'failed')",
    "runtime_budget": f"WITH {_EV} SELECT recording_id, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms FROM ev GROUP BY 1 HAVING sum(coalesce(duration_ms, 0)) > 5000",
    "stage_quantiles": f"WITH {_EV} SELECT stage, count(*) AS n, CAST(min(duration_ms) AS BIGINT) AS least_ms, avg(duration_ms) AS mean_ms, CAST(max(duration_ms) AS BIGINT) AS most_ms, CAST(quantile_cont(duration_ms, 0.5) AS DOUBLE) AS median_ms FROM ev WHERE duration_ms IS NOT NULL GROUP BY 1",
    "latest_recording": "SELECT family_id, recording_id, speaker_name FROM (SELECT DISTINCT family_id, recording_id, speaker_name, row_number() OVER (PARTITION BY family_id ORDER BY created_at DESC, recording_id DESC) AS r FROM recordings) WHERE r = 1",
    "newest_recordings": "SELECT recording_id, family_id FROM (SELECT DISTINCT recording_id, family_id, created_at FROM recordings) ORDER BY created_at DESC, recording_id LIMIT 20",
    "smart_ranges": f"""WITH RECURSIVE {_S}, n AS (SELECT record, start, "end", row_number() OVER (PARTITION BY record ORDER BY start, "end") AS i FROM s),
w AS (SELECT record, i, start AS a, "end" AS b, 0 AS chunk FROM n WHERE i = 1 UNION ALL
 SELECT n.record, n.i, CASE WHEN n."end" - w.a <= {lexicon.CHUNK_SECONDS} AND n.start - w.b <= {lexicon.GAP_SECONDS} THEN w.a ELSE n.start END, CASE WHEN n."end" - w.a <= {lexicon.CHUNK_SECONDS} AND n.start - w.b <= {lexicon.GAP_SECONDS} THEN greatest(w.b, n."end") ELSE n."end" END, CASE WHEN n."end" - w.a <= {lexicon.CHUNK_SECONDS} AND n.start - w.b <= {lexicon.GAP_SECONDS} THEN w.chunk ELSE w.chunk + 1 END FROM w JOIN n ON n.record = w.record AND n.i = w.i + 1)
SELECT record, CAST(chunk AS BIGINT) AS chunk, min(a) AS start, max(b) AS "end" FROM w GROUP BY 1, 2""",
    "edge_padding": f"WITH {_S}, t AS (SELECT DISTINCT case_id AS record, transcript.duration_seconds AS total FROM benchmark_cases), p AS (SELECT record, segment_id, greatest(start - {lexicon.PADDING_SECONDS}, 0.0) AS a, least(\"end\" + {lexicon.PADDING_SECONDS}, total) AS b FROM s JOIN t USING (record)), o AS (SELECT *, greatest(b - a - {lexicon.FINAL_SECONDS}, 0.0) AS over FROM p) SELECT record, segment_id, a + over / 2 AS padded_start, b - (over - over / 2) AS padded_end FROM o",
    "shared_words": f"""WITH {_S}, n AS (SELECT record, segment_id, text, lead(text) OVER (PARTITION BY record ORDER BY seg_ord) AS nxt FROM s),
w AS (SELECT record, segment_id, list_transform(string_split_regex(trim(text), '[ \t\n\v\f\r]+'), lambda x: {_key("x")}) AS a, list_transform(string_split_regex(trim(nxt), '[ \t\n\v\f\r]+'), lambda x: {_key("x")}) AS b FROM n WHERE nxt IS NOT NULL)
SELECT record, segment_id, CAST(coalesce(list_max(list_filter(range(2, {lexicon.OVERLAP_WORDS} + 1), lambda k: k <= len(a) AND k <= len(b) AND list_slice(a, len(a) - k + 1, len(a)) = list_slice(b, 1, k) AND NOT list_contains(list_slice(b, 1, k), ''))), 0) AS BIGINT) AS n_shared FROM w""",
    "unique_people": f"WITH {_EXACT} SELECT mention_id, person_id FROM ex",
    "person_metrics": f"WITH {_EXACT}, {_M}, a AS (SELECT family_id, count(DISTINCT person_id) AS tp, count(*) AS n FROM m LEFT JOIN ex USING (mention_id) GROUP BY 1), g AS (SELECT family_id, count(DISTINCT person.person_id) AS g FROM known_profiles GROUP BY 1), c AS (SELECT family_id, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, coalesce(g, 0) - coalesce(tp, 0) AS fn FROM a FULL JOIN g USING (family_id)) {_prf('c', 'family_id, ')}",
    "duplicate_counts": f"WITH {_M} SELECT family_id, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT family_id, {_KEY} AS key, category, count(*) AS n FROM m GROUP BY 1, 2, 3) GROUP BY 1",
    "resolution_scores": f"WITH {_RESOLVE}, {_EXACT}, jg AS (SELECT DISTINCT ON (mention_id) m.mention_id, m.family_id, ex.person_id AS gold FROM people_mentions m JOIN ex USING (mention_id)) SELECT family_id, count(*) AS n_mentions, CAST(sum(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) AS BIGINT) AS n_right, CAST(sum(CASE WHEN status = 'resolved' AND person_id IS DISTINCT FROM gold THEN 1 ELSE 0 END) AS BIGINT) AS n_merged, CAST(sum(CASE WHEN status = 'new_person' THEN 1 ELSE 0 END) AS BIGINT) AS n_split, CAST(sum(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy FROM jg LEFT JOIN res USING (mention_id) GROUP BY 1",
    "citation_closure": f"WITH {_G}, k AS (SELECT DISTINCT family_id, person.person_id AS id FROM known_profiles) SELECT family_id, count(*) AS n_objects, CAST(sum(CASE WHEN (subject_person_id IS NOT NULL OR object_person_id IS NOT NULL) AND (subject_person_id IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.family_id = e.family_id AND k.id = subject_person_id)) AND (object_person_id IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.family_id = e.family_id AND k.id = object_person_id)) THEN 1 ELSE 0 END) AS BIGINT) AS n_closed FROM e GROUP BY 1",
}
