"""Rule-based resolution of mentions to the known people of a family, with its evidence kept.

One pass without the graph: names give candidates, an alias shared by several candidates marks them as in conflict, a single
candidate that a verified alias or relation and generation support resolves its mention, and any other mention is needs_review
or new_person. Resolved neighbours do not support a mention, and ends of a relationship may resolve to one person. This is the exact, safe counterpart of the fuzzy linking operator.

Defined results: a mention without a usable name is new_person; keys are compared in their normal form; null arrays are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import lexicon
from evigraph.functions.text import name_key, normalize

_EMPTY = F.array


def generation(relation: Column) -> Column:
    """Generation of a relation word relative to the speaker, or null."""
    n = normalize(relation)
    return F.coalesce(*(F.when(n.isin(*ws), F.lit(g)) for g, ws in lexicon.GENERATIONS.items()))


def mention_keys(mentions: DataFrame) -> DataFrame:
    """(mention_id, family_id, key, surface_kind) of names and aliases, each mention once."""
    m = mentions.select("mention_id", "family_id", "name", "aliases").dropDuplicates(["mention_id"])
    surfaces = F.concat(F.array(F.struct(F.col("name").alias("s"), F.lit("name").alias("k"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("s"), F.lit("alias").alias("k"))))
    return m.select("mention_id", "family_id", F.explode(surfaces).alias("x")).select("mention_id", "family_id", name_key(F.col("x.s")).alias("key"), F.col("x.k").alias("surface_kind")).where("key <> ''").distinct()


def profile_keys(profiles: DataFrame) -> DataFrame:
    """(family_id, person_id, key, name_kind): canonical, verified_alias or alias."""
    p = profiles.select("family_id", "person.person_id", "person.canonical_name", "person.aliases", "verified_aliases")
    verified = F.transform(F.coalesce("verified_aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("s"), F.lit("verified_alias").alias("k")))
    plain = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("s"), F.lit("alias").alias("k")))
    canonical = F.array(F.struct(F.col("canonical_name").alias("s"), F.lit("canonical").alias("k")))
    rows = p.select("family_id", "person_id", F.explode(F.concat(canonical, verified, plain)).alias("x")).select("family_id", "person_id", name_key(F.col("x.s")).alias("key"), F.col("x.k").alias("name_kind"))
    return rows.where("key <> ''").distinct()


def name_signals(mentions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(mention_id, person_id, rules): the sorted name rules by which a pair is a candidate."""
    m, p = mention_keys(mentions), profile_keys(profiles)
    rule = F.concat_ws("_", "surface_kind", F.lit("matches"), "name_kind")
    return m.join(p, ["family_id", "key"]).groupBy("mention_id", "person_id").agg(F.array_sort(F.collect_set(rule)).alias("rules"))


def candidates(mentions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Name candidates with their context: categories in conflict, equal relation, equal generation."""
    signals = name_signals(mentions, profiles)
    m = mentions.select("mention_id", F.col("category").alias("m_category"), F.col("relation_to_speaker").alias("m_relation"), "assertion_mode").dropDuplicates(["mention_id"])
    p = profiles.select("person.person_id", F.col("person.category").alias("p_category"), F.col("person.relation_to_speaker").alias("p_relation"), "generation_relative_to_speaker").dropDuplicates(["person_id"])
    j = signals.join(m, "mention_id").join(p, "person_id")
    family = lambda c: F.col(c) == "family_member"
    known = (F.coalesce("m_category", F.lit("unknown")) != "unknown") & (F.coalesce("p_category", F.lit("unknown")) != "unknown")
    return j.select(
        "mention_id",
        "person_id",
        "rules",
        F.exists("rules", lambda r: r.endswith("verified_alias")).alias("verified"),
        (known & (family("m_category") != family("p_category"))).alias("conflict"),
        F.coalesce(normalize(F.col("m_relation")) == normalize(F.col("p_relation")), F.lit(False)).alias("same_relation"),
        F.coalesce(generation(F.col("m_relation")) == F.col("generation_relative_to_speaker"), F.lit(False)).alias("same_generation"),
        (F.coalesce("assertion_mode", F.lit("")) == "uncertain").alias("uncertain"),
    )


def resolve(mentions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(mention_id, status, person_id, n_candidates) of every mention, each once."""
    c = candidates(mentions, profiles)
    strong = ~F.col("uncertain") & ~F.col("conflict") & (F.col("verified") | (F.col("same_relation") & F.col("same_generation")))
    per = c.withColumn("strong", strong).groupBy("mention_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("verified").cast("int")).alias("n_verified"),
        F.sum((~F.col("conflict")).cast("int")).alias("n_clear"),
        F.sum(F.col("strong").cast("int")).alias("n_strong"),
        F.min(F.when(F.col("strong"), F.col("person_id"))).alias("person"),
    )
    resolved = (F.col("n_verified") <= 1) & (F.col("n_clear") == 1) & (F.col("n_strong") == 1)
    all_ = mentions.select("mention_id").where("mention_id is not null").distinct().join(per, "mention_id", "left")
    status = F.when(F.col("n").isNull(), "new_person").when(resolved, "resolved").otherwise("needs_review")
    return all_.select("mention_id", status.alias("status"), F.when(status == "resolved", F.col("person")).alias("person_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


def graph_signals(resolved: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(recording_id, person_id, neighbour_id, relationship_type): resolved people of one recording whom an edge joins."""
    seen = resolved.where("status = 'resolved'").join(mentions.select("mention_id", "recording_id").dropDuplicates(["mention_id"]), "mention_id").where("recording_id is not null").select("recording_id", "person_id").distinct()
    e = edges.where("subject_person_id is not null and object_person_id is not null").select("relationship_type", F.least("subject_person_id", "object_person_id").alias("person_id"), F.greatest("subject_person_id", "object_person_id").alias("neighbour_id")).distinct()
    other = seen.select("recording_id", F.col("person_id").alias("neighbour_id"))
    return seen.join(e, "person_id").join(other, ["recording_id", "neighbour_id"]).select("recording_id", "person_id", "neighbour_id", "relationship_type")
