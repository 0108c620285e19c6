"""The claim ledger: content-addressed claims, conflicts among them, the graph and the profiles they make.

Everything is recomputed from rows; ids depend on content only, so a retried batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import name_key, normalize, stable_id
from evigraph.operators.hierarchy import parent_edges, parent_of


def claim_ids(edges: DataFrame) -> DataFrame:
    """Edges with a content-addressed claim id; null parts count as empty."""
    parts = ("family_id", "relationship_type", "subject_person_id", "subject_role", "object_person_id", "object_role")
    return edges.withColumn("claim_id", stable_id("claim", *map(F.col, parts)))


def canonical_edge(edges: DataFrame) -> DataFrame:
    """Edges whose symmetric ends (spouses and siblings) stand in order of person and role."""
    a = F.struct(F.coalesce("subject_person_id", F.lit("")).alias("p"), F.coalesce("subject_role", F.lit("")).alias("r"))
    b = F.struct(F.coalesce("object_person_id", F.lit("")).alias("p"), F.coalesce("object_role", F.lit("")).alias("r"))
    swap = F.col("relationship_type").isin("spouse", "sibling") & (b < a)
    return edges.withColumn("_s", F.when(swap, b).otherwise(a)).withColumn("_o", F.when(swap, a).otherwise(b)).select("family_id", "relationship_type", F.col("_s.p").alias("subject"), F.col("_s.r").alias("subject_role"), F.col("_o.p").alias("object"), F.col("_o.r").alias("object_role"), "edge_id", "source_claim_ids", "created_at")


def graph(edges: DataFrame) -> DataFrame:
    """One row an edge of the graph, with the claims that state it; an edge without claims has none."""
    rows = canonical_edge(edges).where("subject <> '' and object <> ''")
    each = rows.select("family_id", "relationship_type", "subject", "subject_role", "object", "object_role", F.explode_outer("source_claim_ids").alias("claim"))
    return each.groupBy("family_id", "relationship_type", "subject", "subject_role", "object", "object_role").agg(F.array_sort(F.collect_set("claim")).alias("c")).withColumn("n_claims", F.size("c").cast("long")).withColumn("claims", F.array_join("c", ",")).drop("c")


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair in order; null counts as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.least(a, b), F.greatest(a, b)


def pair_conflicts(edges: DataFrame) -> DataFrame:
    """Pairs of persons whose statements differ in their signature: type and parent of ``parent_child``, type and the roles of
    both persons of any other. A missing role is the plain one of its type."""
    first, second = pair(F.col("subject_person_id"), F.col("object_person_id"))
    role = lambda c: F.coalesce(F.col(c), F.col("relationship_type"))
    ends = F.array_sort(F.array(F.struct(F.col("subject_person_id").alias("p"), role("subject_role").alias("r")), F.struct(F.col("object_person_id").alias("p"), role("object_role").alias("r"))))
    parent = F.array(F.struct(parent_of().alias("p"), F.lit("parent").alias("r")))
    signature = F.struct("relationship_type", F.when(F.col("relationship_type") == "parent_child", parent).otherwise(ends).alias("ends"))
    rows = edges.where("subject_person_id is not null and object_person_id is not null").select("family_id", first.alias("first_id"), second.alias("second_id"), "relationship_type", "edge_id", signature.alias("s"))
    out = rows.groupBy("family_id", "first_id", "second_id").agg(F.array_sort(F.collect_set("relationship_type")).alias("t"), F.size(F.collect_set("s")).alias("n"), F.size(F.collect_set("edge_id")).cast("long").alias("n_edges"))
    return out.where("n > 1").select("family_id", "first_id", "second_id", F.size("t").cast("long").alias("n_types"), F.array_join("t", ",").alias("types"), "n_edges")


def alias_conflicts(names: DataFrame) -> DataFrame:
    """Names of one family that more than one person has. ``names``: family_id, person_id, name."""
    rows = names.withColumn("key", name_key(F.col("name"))).where("key <> ''")
    out = rows.groupBy("family_id", "key").agg(F.array_sort(F.collect_set("person_id")).alias("p")).where(F.size("p") > 1)
    return out.select("family_id", "key", F.size("p").cast("long").alias("n_people"), F.array_join("p", ",").alias("people"))


def temporal_conflicts(events: DataFrame, types: tuple[str, ...] = ("birth", "death")) -> DataFrame:
    """Events of one type and the same participants in a record that give more than one date. ``events``: record, event_id,
    event_type, participants (array), date (text); events without participants or date do not conflict."""
    rows = events.where(F.col("event_type").isin(*types) & F.col("date").isNotNull() & (F.size("participants") > 0)).select("record", "event_id", "event_type", F.array_join(F.array_sort(F.array_distinct("participants")), ",").alias("people"), "date").distinct()
    out = rows.groupBy("record", "event_type", "people").agg(F.array_sort(F.collect_set("date")).alias("d"), F.size(F.collect_set("event_id")).cast("long").alias("n_events"))
    return out.where(F.size("d") > 1).select("record", "event_type", "people", "n_events", F.array_join("d", ",").alias("dates"))


def profile_names(profiles: DataFrame) -> DataFrame:
    """(family_id, person_id, name, source) of canonical names and aliases, each once."""
    p = profiles.select("family_id", "person.*")
    canonical = p.select("family_id", "person_id", F.col("canonical_name").alias("name"), F.lit("canonical").alias("source"))
    alias = p.select("family_id", "person_id", F.explode("aliases").alias("name"), F.lit("alias").alias("source"))
    return canonical.unionByName(alias).where("name is not null").distinct()


def insert_absent(ledger: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The rows of a batch that the ledger does not have, each once."""
    return batch.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def upsert(history: DataFrame, key: list[str], latest: list[str], order: list[str], union: list[str]) -> DataFrame:
    """Merge rows of a key: last known values of ``latest`` by ``order``, and the union of the arrays ``union``."""
    aggs = [F.max_by(F.col(c), F.struct(*(F.struct(F.col(c).isNotNull().alias("k"), *(F.col(o) for o in order)),))).alias(c) for c in latest]
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast("array<string>")))))).alias(c) for c in union]
    return history.groupBy(*key).agg(*aggs, *sets)


def adjacency(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """People with their neighbours in four directions, from the edges; people without edges keep empty arrays.

    Who is the parent is read as in ``hierarchy.parent_edges``: the subject where roles are null."""
    two = lambda e, a, b, other, own: e.select(F.explode(F.array(F.struct(F.col(a).alias("person_id"), F.col(b).alias("other"), other.alias("t")), F.struct(F.col(b).alias("person_id"), F.col(a).alias("other"), own.alias("t")))).alias("n")).select("n.*")
    kin = two(parent_edges(edges), "parent", "child", F.lit("child"), F.lit("parent"))
    level = edges.where(F.col("relationship_type").isin("spouse", "sibling") & F.col("subject_person_id").isNotNull() & F.col("object_person_id").isNotNull())
    both = kin.unionByName(two(level, "subject_person_id", "object_person_id", F.col("relationship_type"), F.col("relationship_type")))
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("t") == kind, F.col("other"))))
    near = both.groupBy("person_id").agg(pick("parent").alias("parents"), pick("child").alias("children"), pick("spouse").alias("spouses"), pick("sibling").alias("siblings"))
    people = profiles.select("family_id", "person.person_id").distinct()
    joined = people.join(near, "person_id", "left")
    return joined.select("family_id", "person_id", *(F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c) for c in ("parents", "children", "spouses", "siblings")))


def facets(profiles: DataFrame) -> DataFrame:
    """One row a fact of each person: names, category, relation, generation; the earliest value in order stands for its key."""
    p = profiles.select("family_id", "person.*", "generation_relative_to_speaker")
    fact = lambda predicate, value: F.struct(F.lit(predicate).alias("predicate"), value.cast("string").alias("value"))
    single = F.array(fact("canonical_name", F.col("canonical_name")), fact("category", F.col("category")), fact("relation", F.col("relation_to_speaker")), fact("generation", F.col("generation_relative_to_speaker")))
    alias = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("alias").alias("predicate"), a.alias("value")))
    rows = p.select("family_id", "person_id", F.explode(F.concat(single, alias)).alias("f")).select("family_id", "person_id", "f.*").where("value is not null and trim(value) <> ''")
    return rows.groupBy("family_id", "person_id", "predicate", normalize(F.col("value")).alias("value_key")).agg(F.min("value").alias("value"))


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One order-insensitive digest of a table: the number of rows and the sums of both halves of their 128-bit hashes."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    half = lambda at: F.sum(F.conv(F.substring("h", at, 16), 16, 10).cast("decimal(20,0)"))
    sums = rows.select(F.md5(text).alias("h")).agg(F.count("*").alias("n_rows"), half(1).alias("a"), half(17).alias("b"))
    return sums.select("n_rows", F.concat_ws(":", F.coalesce(F.col("a").cast("string"), F.lit("0")), F.coalesce(F.col("b").cast("string"), F.lit("0"))).alias("digest"))
