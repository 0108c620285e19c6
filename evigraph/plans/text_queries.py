"""Queries of the text and time functions over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import lexicon, temporal
from evigraph.functions import text as X
from evigraph.operators import nested
from evigraph.plans.hierarchies import table_sql
from evigraph.runtime import read


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "people_mentions").select("mention_id", "name", "relation_to_speaker").distinct()


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "e2e_cases").select("case_id", "language", F.col("reference_text").alias("ref"), F.col("request.transcript.full_text").alias("hyp"))
    return c.distinct()


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three normal forms of every mention's name."""
    n = F.col("name")
    return _mentions(spark, sf_dir).select("mention_id", X.normalize(n).alias("norm"), X.name_key(n).alias("name_key"), X.collapse(n).alias("collapsed")).distinct()


def script_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by the script of their name."""
    return _mentions(spark, sf_dir).groupBy(X.script(F.col("name")).alias("script")).agg(F.count("*").alias("n"))


def kazakh_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have letters or words of Kazakh, by source."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(X.prefers_kazakh(F.col("text")).cast("bigint")).alias("n_kazakh"))


def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose transcript has the speaker's name as whole words."""
    c = read(spark, sf_dir, "benchmark_cases").select("case_id", X.normalize(F.col("speaker_name")).alias("p"), X.normalize(F.col("transcript.full_text")).alias("t")).distinct()
    return c.select("case_id", X.has_phrase(F.col("t"), F.col("p")).alias("named"))


def statement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of every document: how many, and the longest."""
    d = _docs(spark, sf_dir).withColumn("s", X.statements(F.col("text")))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_statements"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("bigint").alias("longest"))


def significant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant words of every document."""
    d = _docs(spark, sf_dir).withColumn("t", X.significant(F.col("text")))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def sensitivity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity of every document."""
    d = _docs(spark, sf_dir).withColumn("s", X.sensitivity(F.col("text")))
    return d.select("doc_id", "s.level", F.array_join("s.categories", ",").alias("categories"))


def factual_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every statement of a reference is supported by its transcript."""
    c = _cases(spark, sf_dir).where("ref is not null and hyp is not null")
    s = c.select("case_id", "hyp", F.posexplode(X.statements(F.col("ref"))).alias("pos", "statement"))
    return s.select("case_id", F.col("pos").cast("bigint").alias("pos"), X.support(F.col("statement"), F.col("hyp")).alias("status"))


def unsupported_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by status."""
    return factual_support(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def ordered_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the words of a reference come in the transcript in their order."""
    c = _cases(spark, sf_dir).where("ref is not null and hyp is not null")
    return c.select("case_id", X.is_subsequence(X.significant(F.col("ref")), X.significant(F.col("hyp"))).alias("in_order"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed ids of recordings."""
    r = read(spark, sf_dir, "recordings").dropDuplicates(["recording_id"])
    return r.select("recording_id", X.stable_id("rec", F.col("family_id"), F.col("speaker_name"), F.col("content_type")).alias("stable_id"))


def relation_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by the generation of their relation."""
    from evigraph.operators.resolution import generation

    return _mentions(spark, sf_dir).groupBy(generation(F.col("relation_to_speaker")).alias("generation")).agg(F.count("*").alias("n"))


def uncertainty_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the status of the phrases of uncertainty in them."""
    d = _docs(spark, sf_dir).withColumn("n", X.normalize(F.col("text")))
    rows = []
    for status, phrases in lexicon.UNCERTAINTY.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | X.has_phrase(F.col("n"), F.lit(p.replace("-", " ")))
        rows.append(F.sum(hit.cast("bigint")).alias(status))
    return d.agg(*rows)


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.statements(F.col("text"))).alias("pos", "s"))
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "s")


def temporal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date in every statement of the documents, of whatever length; one without a date is unresolved."""
    return temporal.with_dates(_statements(spark, sf_dir), "s").select("doc_id", "pos", *temporal.FIELDS)


#: Expressions of every kind of reading, for documents never use some of them.
EXPRESSIONS = (
    "12/05/1943", "1943-05-12", "1943-02-30", "9 мая 1945", "9 мая", "31 апреля 1950", "март 1953", "примерно март 1953", "около февраля 1960", "1941-1945", "между 1950 и 1940",
    "1950 мен 1955", "начало шестидесятых", "в конце восьмидесятых", "середина семидесятых годов", "тоқсаныншы жылдардың басында", "екі мыңыншы жылдардың", "двухтысячные",
    "когда ему было 7", "12 жасында", "до 1950", "1950 жылдан кейін", "около 1937", "шамамен 1937", "1937 год", "после войны", "соғысқа дейін", "давно", "", "  ",
)


def temporal_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of reading of a date, on fixed expressions."""
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(EXPRESSIONS)], "id int, e string")
    return temporal.with_dates(rows, "e").select("id", *temporal.FIELDS)


STATES = (
    "мой бывший муж", "они развелись", "вдова Анна", "ажырасты", "бұрынғы күйеуі", "не мой брат", "туыс емес", "как родной брат", "ағамдай болды", "не не брат",
    "никогда не были женаты", "раньше были женаты", "моя сестра", "әкесі емес", "қазір бірге емес", "жесір қалды", "брат",
)


def relationship_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a relationship, on fixed phrases."""
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(STATES)], "id int, e string")
    return rows.select("id", temporal.relationship_state(F.col("e")).alias("state"))


def segment_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every segment of a transcript says of the state of a relationship."""
    c = read(spark, sf_dir, "benchmark_cases").select("case_id", F.explode("transcript.segments").alias("g")).where("g.text is not null")
    return c.select("case_id", "g.segment_id", temporal.relationship_state(F.col("g.text")).alias("state")).distinct()


def calendar_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of all extracted events, and whether they are days of the calendar."""
    e = nested.typed(nested.stored(nested.project_records(lambda t: read(spark, sf_dir, t))), "events").where("date.value is not null")
    return e.select("source", "record_id", "entity_id", F.col("date.value").alias("iso"), temporal.is_date(F.col("date.value")).alias("valid")).distinct()


def calendar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO dates built of each trace event's numbers, most of them no days of the calendar."""
    e = read(spark, sf_dir, "processing_trace_events").dropDuplicates(["event_id"])
    iso = F.concat(F.lit("19"), F.lpad((F.coalesce("duration_ms", F.lit(0)) % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("sequence") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.coalesce("duration_ms", F.lit(0)) % 35).cast("string"), 2, "0"))
    return e.select("event_id", iso.alias("iso")).select("event_id", "iso", temporal.is_date(F.col("iso")).alias("valid"))


QUERIES = {f.__name__: f for f in (text_normalize, script_buckets, kazakh_preference, phrase_containment, statement_split, significant_tokens, sensitivity_levels, factual_support, unsupported_statements, ordered_subsequence, stable_ids, relation_generations, uncertainty_markers, temporal_parse, temporal_expressions, relationship_states, segment_states, calendar_check, calendar_numbers)}


def _values(items: tuple[str, ...]) -> str:
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(items))


def low(x: str) -> str:
    return f"lower(replace({x}, 'İ', 'i'))"


def norm(x: str) -> str:
    return rf"trim(regexp_replace({low(x)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def sig(x: str) -> str:
    return f"list_filter({words(x)}, lambda t: length(t) >= 2 OR regexp_full_match(t, '[0-9]+'))"


#: White space of Unicode as a class that RE2 reads.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stmts(x: str) -> str:
    """Without lookbehind in RE2: a line feed is put after end marks before white space, then lines are split."""
    return rf"list_filter(list_transform(string_split_regex(regexp_replace({x}, '([.!?…]){SPACE}+', '\1' || chr(10), 'g'), '[\n\r]+'), lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> '')"


def _list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _cats(tokens: str, lists: dict[str, tuple[str, ...]]) -> str:
    out = []
    for name in sorted(lists):
        whole = [m for m in lists[name] if not m.endswith("*")]
        stems = [m[:-1] for m in lists[name] if m.endswith("*")]
        hit = f"list_has_any({tokens}, {_list(tuple(whole))})" + "".join(f" OR len(list_filter({tokens}, lambda t: starts_with(t, '{m}'))) > 0" for m in stems)
        out.append(f"CASE WHEN {hit} THEN '{name}' END")
    return f"list_filter([{', '.join(out)}], lambda c: c IS NOT NULL)"


_E, _Z = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _rx(body: str) -> str:
    return f"{_E}{body}{_Z}"


def _state_sql(e: str = "e") -> str:
    rules = [(name, "|".join(patterns)) for name, patterns in lexicon.RELATIONSHIP_STATES]
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({e}), '{_rx(f'(?:{p})')}') THEN '{n}'" for n, p in rules) + " ELSE 'current' END"


def _parse_sql(x: str) -> dict[str, str]:
    """The cascade in SQL, as one expression a column."""
    month = "|".join(sorted((w for ws in lexicon.MONTHS.values() for w in ws), key=lambda w: (-len(w), w)))
    iso_r, dm, my = _rx("([0-9]{4})-([0-9]{2})-([0-9]{2})"), _rx(rf"([0-9]{{1,2}})\s+({month})(?:\s+([0-9]{{4}}))?"), _rx(rf"({month})\s+([0-9]{{4}})")
    rng = _rx(r"(1[5-9][0-9]{2}|20[0-9]{2})\s*(?:-|–|—|и|мен)\s*(1[5-9][0-9]{2}|20[0-9]{2})")
    about, before, after = (_rx(f"(?:{w})") for w in ("примерно|около|приблизительно|шамамен|шамасы|сияқты", "до|дейін|бұрын", "после|кейін|соң"))
    age = _rx(r"(?:когда\s+(?:ему|ей)\s+было\s+(?:лет\s+)?[0-9]{1,3}|[0-9]{1,3}\s+жасында)")
    year = _rx("(1[5-9][0-9]{2}|20[0-9]{2}|21[0-9]{2})")
    m = lambda p: f"regexp_matches({x}, '{p}')"
    g = lambda p, i: f"regexp_extract({x}, '{p}', {i + 1})"
    mon = lambda w: "CASE " + " ".join(f"WHEN {w} IN ({', '.join(repr(v) for v in ws)}) THEN '{n:02d}'" for n, ws in lexicon.MONTHS.items()) + " END"
    isod = f"{g(iso_r, 1)} || '-' || {g(iso_r, 2)} || '-' || {g(iso_r, 3)}"
    fulld = f"{g(dm, 3)} || '-' || ({mon(g(dm, 2))}) || '-' || lpad({g(dm, 1)}, 2, '0')"
    ok = lambda d: f"try_strptime({d}, '%Y-%m-%d') IS NOT NULL"
    mv = f"{g(my, 2)} || '-' || ({mon(g(my, 1))})"
    base = "CASE " + " ".join(f"WHEN regexp_matches({x}, '{_E}(?:{'|'.join(w.replace(' ', chr(92) + 's+') for w in ws)})') THEN {b}" for b, ws in lexicon.DECADES.items()) + " END"
    part = lambda i, d: "CASE " + " ".join(f"WHEN {m(_rx(f'(?:{chr(124).join(v[2])})'))} THEN {v[i]}" for v in reversed(lexicon.DECADE_PARTS.values())) + f" ELSE {d} END"
    y = f"CAST(NULLIF({g(year, 1)}, '') AS INTEGER)"
    conds = [
        ("x_empty", f"{x} = ''", {"kind": "'invalid'", "issue": "'temporal_value_invalid'"}),
        ("amb", m(_rx("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}")), {"kind": "'unknown'", "issue": "'temporal_format_ambiguous'"}),
        ("iso", f"{m(iso_r)} AND {ok(isod)}", {"kind": "'exact_date'", "value": isod}),
        ("isobad", m(iso_r), {"kind": "'invalid'", "issue": "'temporal_value_invalid'"}),
        ("dmny", f"{m(dm)} AND {g(dm, 3)} = ''", {"kind": "'relative'", "issue": "'temporal_anchor_missing'"}),
        ("dm", f"{m(dm)} AND {ok(fulld)}", {"kind": "'exact_date'", "value": fulld}),
        ("dmbad", m(dm), {"kind": "'invalid'", "issue": "'temporal_value_invalid'"}),
        ("mya", f"{m(my)} AND {m(about)}", {"kind": "'approximate'", "value": mv, "lower_bound": f"{mv} || '-01'", "upper_bound": f"strftime(last_day(try_strptime({mv} || '-01', '%Y-%m-%d')), '%Y-%m-%d')", "approximate": "true"}),
        ("my", m(my), {"kind": "'month_year'", "value": mv}),
        ("rbad", f"{m(rng)} AND {g(rng, 1)} > {g(rng, 2)}", {"kind": "'invalid'", "issue": "'temporal_range_invalid'"}),
        ("r", m(rng), {"kind": "'range'", "lower_bound": g(rng, 1), "upper_bound": f"{g(rng, 2)} || '-12-31'"}),
        ("dec", f"({base}) IS NOT NULL", {"kind": "'decade'", "lower_bound": f"CAST(({base}) + ({part(0, 0)}) AS VARCHAR)", "upper_bound": f"CAST(({base}) + ({part(1, 9)}) AS VARCHAR) || '-12-31'", "approximate": "true"}),
        ("age", m(age), {"kind": "'relative'", "issue": "'temporal_anchor_missing'"}),
        ("yb", f"{m(year)} AND {m(before)}", {"kind": "'relative'", "upper_bound": f"CAST({y} - 1 AS VARCHAR) || '-12-31'", "issue": "'temporal_anchor_missing'"}),
        ("ya", f"{m(year)} AND {m(after)}", {"kind": "'relative'", "lower_bound": f"CAST({y} + 1 AS VARCHAR)", "issue": "'temporal_anchor_missing'"}),
        ("yc", f"{m(year)} AND {m(about)}", {"kind": "'approximate'", "value": f"CAST({y} AS VARCHAR)", "lower_bound": f"CAST({y} - 1 AS VARCHAR)", "upper_bound": f"CAST({y} + 1 AS VARCHAR) || '-12-31'", "approximate": "true"}),
        ("y", m(year), {"kind": "'year'", "value": f"CAST({y} AS VARCHAR)"}),
        ("ba", f"{m(before)} OR {m(after)}", {"kind": "'relative'", "issue": "'temporal_anchor_missing'"}),
    ]
    last = {"kind": "'unknown'", "issue": "'temporal_expression_unresolved'"}
    out = {}
    for column, default in (("kind", "NULL"), ("value", "NULL"), ("lower_bound", "NULL"), ("upper_bound", "NULL"), ("approximate", "false"), ("issue", "NULL")):
        out[column] = "CASE " + " ".join(f"WHEN {c} THEN {v.get(column, default)}" for _, c, v in conds) + f" ELSE {last.get(column, default)} END"
    return out


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


_DOCS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"
_CASES = "SELECT DISTINCT case_id, language, reference_text AS ref, request.transcript.full_text AS hyp FROM e2e_cases"
_NUMBERED = f"SELECT doc_id, unnest({stmts('text')}) AS s, generate_subscripts({stmts('text')}, 1) - 1 AS pos FROM ({_DOCS})"

ORACLES = {
    "text_normalize": rf"SELECT DISTINCT mention_id, {norm('name')} AS norm, regexp_replace({low('name')}, '[^\p{{L}}\p{{N}}_]+', '', 'g') AS name_key, trim(regexp_replace(replace({low('name')}, 'ё', 'е'), '{SPACE}+', ' ', 'g')) AS collapsed FROM people_mentions",
    "script_buckets": r"SELECT CASE WHEN c AND l THEN 'mixed' WHEN c THEN 'cyrillic' WHEN l THEN 'latin' ELSE 'other' END AS script, count(*) AS n FROM (SELECT regexp_matches(name, '[\x{0400}-\x{04FF}]') AS c, regexp_matches(name, '[A-Za-z\x{00C0}-\x{024F}]') AS l FROM (SELECT DISTINCT mention_id, name, relation_to_speaker FROM people_mentions)) GROUP BY 1",
    "kazakh_preference": f"SELECT source, count(*) AS n_documents, CAST(sum(CASE WHEN regexp_matches({low('text')}, '[{lexicon.KAZAKH_LETTERS}]') OR list_has_any({words('text')}, {_list(lexicon.FIRST_PERSON['kk'])}) THEN 1 ELSE 0 END) AS BIGINT) AS n_kazakh FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "phrase_containment": f"SELECT case_id, contains(' ' || t || ' ', ' ' || p || ' ') AS named FROM (SELECT DISTINCT case_id, {norm('speaker_name')} AS p, {norm('transcript.full_text')} AS t FROM benchmark_cases)",
    "statement_split": f"SELECT doc_id, len(s) AS n_statements, coalesce(list_max(list_transform(s, lambda t: length(t))), 0) AS longest FROM (SELECT doc_id, {stmts('text')} AS s FROM ({_DOCS}))",
    "significant_tokens": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {sig('text')} AS t FROM ({_DOCS}))",
    "sensitivity_levels": f"SELECT doc_id, CASE WHEN len(h) > 0 THEN 'highly_sensitive' WHEN len(s) > 0 THEN 'sensitive' ELSE 'normal' END AS level, array_to_string(CASE WHEN len(h) > 0 THEN h ELSE s END, ',') AS categories FROM (SELECT doc_id, {_cats('w', lexicon.HIGHLY_SENSITIVE)} AS h, {_cats('w', lexicon.SENSITIVE)} AS s FROM (SELECT doc_id, string_split({norm('text')}, ' ') AS w FROM ({_DOCS})))",
    "stable_ids": "SELECT DISTINCT recording_id, 'rec_' || substr(sha256(coalesce(family_id, '') || chr(31) || coalesce(speaker_name, '') || chr(31) || coalesce(content_type, '')), 1, 32) AS stable_id FROM recordings",
    "relation_generations": f"SELECT {'CASE ' + ' '.join(f'WHEN r IN ({chr(44).join(repr(w) for w in ws)}) THEN {g}' for g, ws in lexicon.GENERATIONS.items()) + ' END'} AS generation, count(*) AS n FROM (SELECT {norm('relation_to_speaker')} AS r FROM (SELECT DISTINCT mention_id, name, relation_to_speaker FROM people_mentions)) GROUP BY 1",
    "uncertainty_markers": "SELECT " + ", ".join(f"CAST(sum(CASE WHEN {' OR '.join(f'''contains(n, ' {p.replace('-', ' ')} ')''' for p in ps)} THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s, ps in lexicon.UNCERTAINTY.items()) + f" FROM (SELECT ' ' || {norm('text')} || ' ' AS n FROM ({_DOCS}))",
    "temporal_parse": f"SELECT doc_id, pos, {_select(_parse_sql('s'))} FROM (SELECT doc_id, pos, {low('trim(s)')} AS s FROM ({_NUMBERED}))",
    "temporal_expressions": f"SELECT id, {_select(_parse_sql('s'))} FROM (SELECT id, lower(trim(e)) AS s FROM (VALUES {_values(EXPRESSIONS)}) v(id, e))",
    "relationship_states": f"SELECT id, {_state_sql()} AS state FROM (VALUES {_values(STATES)}) v(id, e)",
    "segment_states": f"SELECT DISTINCT case_id, g.segment_id AS segment_id, {_state_sql('g.text')} AS state FROM (SELECT case_id, unnest(transcript.segments) AS g FROM benchmark_cases) WHERE g.text IS NOT NULL",
    "calendar_numbers": "SELECT event_id, iso, try_strptime(iso, '%Y-%m-%d') IS NOT NULL AS valid FROM (SELECT DISTINCT event_id, '19' || lpad(CAST(coalesce(duration_ms, 0) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(sequence % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(coalesce(duration_ms, 0) % 35 AS VARCHAR), 2, '0') AS iso FROM processing_trace_events)",
}

ORACLES["calendar_check"] = f"""WITH {table_sql()}, dates AS (SELECT DISTINCT source, record_id, id AS entity_id, json_extract_string(obj, '$.date.value') AS iso FROM o_events)
SELECT *, coalesce(regexp_full_match(iso, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(iso, '%Y-%m-%d') IS NOT NULL, false) AS valid FROM dates WHERE iso IS NOT NULL"""
_PAIRS = f"SELECT case_id, {stmts('ref')} AS ss, hyp FROM ({_CASES}) WHERE ref IS NOT NULL AND hyp IS NOT NULL"
_NEG, _CAUSE = _list(lexicon.NEGATION), _list(lexicon.CAUSALITY)
# the place reached in the needle after each word of the text, as a recursive query
_SUPPORT = f"""
p AS (SELECT case_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos, hyp FROM ({_PAIRS})),
q AS (SELECT case_id, pos, {norm('s')} AS sn, {norm('hyp')} AS en, {sig('s')} AS st, {sig('hyp')} AS et FROM p),
walk AS (SELECT case_id, pos, st, et, 1 AS i, 1 AS j FROM q UNION ALL
         SELECT case_id, pos, st, et, CASE WHEN st[i] = et[j] THEN i + 1 ELSE i END, j + 1 FROM walk WHERE j <= len(et) AND i <= len(st)),
reach AS (SELECT case_id, pos, max(i) AS i FROM walk GROUP BY 1, 2),
judged AS (SELECT q.case_id, q.pos, CASE WHEN len(st) = 0 OR sn = '' THEN 'unsupported' WHEN contains(en, sn) THEN 'exact'
  WHEN list_has_any(st, {_CAUSE}) AND NOT list_has_any(et, {_CAUSE}) THEN 'adds_causality'
  WHEN list_has_any(et, {_NEG}) AND NOT list_has_any(st, {_NEG}) THEN 'drops_negation'
  WHEN len(list_filter(st, lambda t: NOT list_contains(et, t))) > 0 THEN 'unsupported'
  WHEN reach.i > len(st) THEN 'ordered'
  WHEN list_filter(et, lambda t: list_contains(st, t)) <> st THEN 'role_order_changed' ELSE 'unsupported' END AS status
  FROM q JOIN reach USING (case_id, pos))
"""
ORACLES["factual_support"] = f"WITH RECURSIVE {_SUPPORT} SELECT case_id, pos, status FROM judged"
ORACLES["unsupported_statements"] = f"WITH RECURSIVE {_SUPPORT} SELECT status, count(*) AS n FROM judged GROUP BY 1"
ORACLES["ordered_subsequence"] = f"""WITH RECURSIVE q AS (SELECT case_id, {sig('ref')} AS st, {sig('hyp')} AS et FROM ({_CASES}) WHERE ref IS NOT NULL AND hyp IS NOT NULL),
walk AS (SELECT case_id, st, et, 1 AS i, 1 AS j FROM q UNION ALL SELECT case_id, st, et, CASE WHEN st[i] = et[j] THEN i + 1 ELSE i END, j + 1 FROM walk WHERE j <= len(et) AND i <= len(st))
SELECT case_id, len(any_value(st)) > 0 AND max(i) > len(any_value(st)) AS in_order FROM walk GROUP BY case_id"""
