"""The queries of the training-text operators over the project's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import encode, language, lookalike, names, packing, sentences, splitting
from evigraph.runtime import read

#: Rows and bytes of an Arrow batch; texts may be long, so fewer than Spark's default.
ARROW_ROWS, ARROW_BYTES = "2000", str(64 << 20)


def _reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return lambda table: read(spark, sf_dir, table)


def _codes(table: Callable[[str], DataFrame]) -> list[str]:
    """The codes of the small table of languages; more than 500 is an error."""
    codes = [r["lang"] for r in table("language_codes").select("lang").distinct().orderBy("lang").limit(501).collect()]
    if len(codes) > 500:
        raise ValueError("more than 500 language codes")
    return codes


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces whose language their record's label does not name."""
    table = _reader(spark, sf_dir)
    codes = _codes(table)
    return language.mislabelled(language.project_pieces(table, codes), language.record_labels(table, codes))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment and paragraph."""
    table = _reader(spark, sf_dir)
    return language.project_pieces(table, _codes(table))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of a segment or paragraph that is in one language, with a confidence."""
    table = _reader(spark, sf_dir)
    return language.project_segments(table, _codes(table))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every transcript and document, and how many languages it holds."""
    table = _reader(spark, sf_dir)
    return language.by_record(language.project_pieces(table, _codes(table)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mentions and of transcripts that look the same but are not equal."""
    table = _reader(spark, sf_dir)
    cases = table("benchmark_cases").select("case_id", "speaker_id", "transcript.full_text")
    a = lookalike.equal_looking(table("people_mentions"), "mention_id", "family_id", "name")
    b = lookalike.equal_looking(cases, "case_id", "speaker_id", "full_text")
    return a.select(F.lit("people_mentions").alias("source"), "key_a", "key_b").unionByName(b.select(F.lit("benchmark_cases").alias("source"), "key_a", "key_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions that look like others of their family but are written differently, by class."""
    return lookalike.form_classes(_reader(spark, sf_dir)("people_mentions"), "mention_id", "family_id", "name")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every mention's name."""
    mentions = _reader(spark, sf_dir)("people_mentions").select("mention_id", "name").distinct()
    return lookalike.unified(mentions, "name")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _reader(spark, sf_dir)
    return names.link_mentions(table("people_mentions"), table("known_profiles"), table("name_forms"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile that each mention names."""
    return _links(spark, sf_dir).select("mention_id", "person_id").distinct()


def p4_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each profile that is named: its mentions and the worst fit among them."""
    return _links(spark, sf_dir).groupBy("person_id").agg(F.count("*").alias("n_mentions"), F.max("cost").alias("worst"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of both texts of every end-to-end case."""
    return sentences.project_sentences(_reader(spark, sf_dir))


def p6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their mean length by field."""
    found = p6_found(spark, sf_dir)
    return found.groupBy("field").agg(F.count("*").alias("n_sentences"), F.avg(F.col("end_char") - F.col("start_char")).alias("mean_chars"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode.encode_ids(_reader(spark, sf_dir)("documents"))


def p7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and empty documents by source."""
    documents = _reader(spark, sf_dir)("documents")
    sizes = encode.token_sizes(documents)
    by = sizes.join(documents.select("doc_id", "source"), "doc_id").groupBy("source")
    return by.agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum((F.col("n_tokens") == 0).cast("long")).alias("n_empty"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, for each budget."""
    table = _reader(spark, sf_dir)
    return packing.pack_documents(encode.token_sizes(table("documents")), packing.budget_rows(table("token_budgets")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each budget are."""
    return packing.fill(p8_containers(spark, sf_dir))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document that exceeds a budget."""
    table = _reader(spark, sf_dir)
    return splitting.split_documents(table("documents").select("doc_id", "text"), packing.budget_rows(table("token_budgets")))


def p9_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By budget and class of the boundary before them: pieces and their mean size."""
    return p9_pieces(spark, sf_dir).groupBy("budget_id", "boundary").agg(F.count("*").alias("n_pieces"), F.avg("n_tokens").alias("mean_tokens"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_segments, p1_records, p3_found, p3_classes, p3_forms, p4_found, p4_profiles, p6_found, p6_lengths, p7_ids, p7_sizes, p8_containers, p8_fill, p9_pieces, p9_boundaries)}

def _form_sql(text: str) -> str:
    """The one form in SQL: invisible characters out, single characters mapped between two compositions, white space as one space."""
    single = sorted((k, v) for k, v in lookalike.build_table().items() if len(k) == len(v) == 1)
    quote = lambda x: x.replace("'", "''")
    sources, targets = quote("".join(k for k, _ in single)), quote("".join(v for _, v in single))
    spaces = "".join(f"\\x{{{c:04X}}}" for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
    hidden = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in lookalike.INVISIBLE_RANGES)
    bare = f"regexp_replace({text}, '[{hidden}]', '', 'g')"
    mapped = f"translate(nfc_normalize(translate(nfc_normalize({bare}), '{sources}', '{targets}')), '{sources}', '{targets}')"
    return f"trim(regexp_replace({mapped}, '[{spaces}]+', ' ', 'g'))"


def _pairs_sql(source: str, table: str, key: str, group: str, text: str) -> str:
    rows = f"SELECT DISTINCT {key} AS k, {group} AS g, {text} AS t FROM {table} WHERE {key} IS NOT NULL AND {group} IS NOT NULL AND {text} IS NOT NULL"
    formed = f"SELECT k, g, t, {_form_sql('t')} AS f FROM ({rows})"
    return f"SELECT DISTINCT '{source}' AS source, a.k AS key_a, b.k AS key_b FROM ({formed}) a JOIN ({formed}) b ON a.g = b.g AND a.f = b.f AND a.k < b.k AND a.t <> b.t"


#: Queries of this package that SQL can express.
ORACLES = {
    "p3_found": _pairs_sql("people_mentions", "people_mentions", "mention_id", "family_id", "name") + " UNION ALL " + _pairs_sql("benchmark_cases", "benchmark_cases", "case_id", "speaker_id", "transcript.full_text"),
    "p3_classes": f"""WITH r AS (SELECT DISTINCT mention_id AS k, family_id AS g, name AS t, {_form_sql("name")} AS f FROM people_mentions WHERE mention_id IS NOT NULL AND family_id IS NOT NULL AND name IS NOT NULL),
c AS (SELECT g, f, min(k) AS class_id, count(DISTINCT t) AS n_texts, count(DISTINCT k) AS n_members FROM r GROUP BY 1, 2 HAVING count(DISTINCT t) > 1)
SELECT DISTINCT k AS key, class_id, n_texts, CAST(n_members AS BIGINT) AS n_members FROM r JOIN c USING (g, f)""",
    "p3_forms": f"SELECT mention_id, name, {_form_sql('name')} AS form FROM (SELECT DISTINCT mention_id, name FROM people_mentions)",
}
