"""Queries of the hierarchy and nested-record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import hierarchy, nested
from evigraph.runtime import read


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.parent_edges(read(spark, sf_dir, "family_graph_edges")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain from an earliest known ancestor, with rings and what is below them reported."""
    return hierarchy.chains(_walked(spark, sf_dir))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every person, of those on rings as well."""
    return hierarchy.all_descendants(hierarchy.parent_edges(read(spark, sf_dir, "family_graph_edges")))


def p2_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rings among the edges."""
    return hierarchy.rings(_walked(spark, sf_dir)).select("first_person_id", "n_members", "members")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.stored(nested.project_records(lambda table: read(spark, sf_dir, table)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object with an id, its parent and its record."""
    return _tagged(spark, sf_dir).where(F.col("entity") != nested.REST).select("source", "record_id", "entity", "entity_id", "parent_entity", "parent_id").distinct()


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each flat table."""
    return p5_found(spark, sf_dir).groupBy("source", "entity", "parent_entity").agg(F.count("*").alias("n_rows"))


def p5_people_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of mentions with typed columns."""
    rows = nested.typed(_tagged(spark, sf_dir), "people_mentions")
    return rows.select("source", "record_id", "entity_id", "name", "category", "confidence", F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("n_aliases"))


def p5_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records hold outside their tables: how many of each source have anything."""
    return _tagged(spark, sf_dir).where(F.col("entity") == nested.REST).groupBy("source").agg(F.countDistinct("record_id").alias("n_records"))


QUERIES = {f.__name__: f for f in (p2_found, p2_descendants, p2_rings, p5_found, p5_tables, p5_people_mentions, p5_rest)}

_EDGES = """
edges AS (SELECT DISTINCT CASE WHEN object_role = 'parent' AND coalesce(subject_role, '') <> 'parent' THEN object_person_id ELSE subject_person_id END AS p,
                 CASE WHEN object_role = 'parent' AND coalesce(subject_role, '') <> 'parent' THEN subject_person_id ELSE object_person_id END AS c
          FROM family_graph_edges WHERE relationship_type = 'parent_child' AND subject_person_id IS NOT NULL AND object_person_id IS NOT NULL),
nodes AS (SELECT p AS n FROM edges UNION SELECT c FROM edges),
reach AS (SELECT p AS a, c AS d FROM edges UNION SELECT r.a, e.c FROM reach r JOIN edges e ON r.d = e.p),
ring AS (SELECT DISTINCT a AS n FROM reach WHERE a = d),
below AS (SELECT DISTINCT d AS n FROM reach WHERE a IN (SELECT n FROM ring) AND d NOT IN (SELECT n FROM ring)),
tree AS (SELECT n, n AS root, 0 AS depth, n AS path FROM nodes WHERE n NOT IN (SELECT c FROM edges)
         UNION ALL SELECT e.c, t.root, t.depth + 1, t.path || '/' || e.c FROM tree t JOIN edges e ON e.p = t.n
         WHERE e.c NOT IN (SELECT n FROM ring) AND e.c NOT IN (SELECT n FROM below))
"""

ORACLES = {
    "p2_found": f"WITH RECURSIVE {_EDGES} SELECT n AS person_id, root AS root_person_id, depth, path FROM tree UNION ALL SELECT n, '', -1, '' FROM ring UNION ALL SELECT n, '', -2, '' FROM below",
    "p2_descendants": f"""WITH RECURSIVE {_EDGES}, steps AS (SELECT p AS a, c AS d, 1 AS n FROM edges WHERE p <> c
 UNION SELECT s.a, e.c, s.n + 1 FROM steps s JOIN edges e ON e.p = s.d WHERE e.c <> s.a AND s.n < (SELECT count(*) FROM nodes) AND NOT (s.n > 40 AND s.d IN (SELECT n FROM ring)))
SELECT a AS ancestor_id, d AS descendant_id, CAST(min(n) AS INTEGER) AS distance FROM steps GROUP BY 1, 2""",
    "p2_rings": f"""WITH RECURSIVE {_EDGES}, mates AS (SELECT DISTINCT x.a AS n, x.d AS m FROM reach x JOIN reach y ON x.a = y.d AND x.d = y.a),
first AS (SELECT n, min(m) AS f FROM mates GROUP BY 1)
SELECT f AS first_person_id, count(*) AS n_members, array_to_string(list_sort(list(n)), ',') AS members FROM first GROUP BY 1""",
}


def _members(value: str, id_field: str) -> str:
    """The objects of a collection in SQL: a list, one object, a map of objects, or any of these as a JSON string."""
    inner = f"(CASE WHEN json_type({value}) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({value}, '$')) THEN CAST(json_extract_string({value}, '$') AS JSON) END ELSE {value} END)"
    return f"""CASE json_type({inner}) WHEN 'ARRAY' THEN json_extract({inner}, '$[*]') WHEN 'OBJECT' THEN
 CASE WHEN list_contains(json_keys({inner}), '{id_field}') THEN [{inner}] ELSE list_transform(json_keys({inner}), lambda k: json_extract({inner}, '$."' || k || '"')) END END"""


def _tables_sql() -> str:
    """Every object with an id, its parent and its record."""
    text = lambda v: f"CASE WHEN json_type({v}) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({v}, '$')) THEN CAST(json_extract_string({v}, '$') AS JSON) END ELSE {v} END"
    places = {"resolutions": "w.doc", "passes": "json_extract(w.doc, '$.processing')"}
    parents = {"name_variants": "obj", "claim_refs": "obj", "supporting_signals": "json_extract(obj, '$.trace')", "calls": "obj"}
    ctes = [
        "d AS (SELECT DISTINCT 'benchmark_cases' AS source, case_id AS record_id, 'raw_extraction' AS root, CAST(raw_extraction AS JSON) AS doc FROM benchmark_cases WHERE json_valid(raw_extraction) UNION SELECT DISTINCT 'pipeline_results', recording_id, 'payload', CAST(payload AS JSON) FROM pipeline_results WHERE json_valid(payload))",
        f"w AS (SELECT source, record_id, root, CASE WHEN list_contains(json_keys(doc), 'result') THEN {text("json_extract(doc, '$.result')")} ELSE doc END AS doc FROM d WHERE json_type(doc) = 'OBJECT')",
        f"x AS (SELECT source, record_id, root, doc, CASE WHEN list_contains(json_keys(doc), 'extraction') THEN {text("json_extract(doc, '$.extraction')")} ELSE doc END AS ext FROM w)",
    ]
    tops, selects = [], []
    for e in nested.ENTITIES:
        if e.parent:
            continue
        holder = places.get(e.name, "w.ext")
        value = f"json_extract({holder}, '$.{e.name}')"
        ctes.append(f"t_{e.name} AS (SELECT source, record_id, root, unnest({_members(value, e.id_field)}) AS obj FROM x AS w)")
        ctes.append(f"o_{e.name} AS (SELECT *, json_extract_string(obj, '$.{e.id_field}') AS id FROM t_{e.name} WHERE json_type(obj) = 'OBJECT' AND coalesce(json_extract_string(obj, '$.{e.id_field}'), '') <> '')")
        tops.append(e.name)
        selects.append(f"SELECT source, record_id, '{e.name}' AS entity, id AS entity_id, root AS parent_entity, record_id AS parent_id FROM o_{e.name}")
    for e in nested.ENTITIES:
        if not e.parent:
            continue
        value = f"json_extract({parents[e.name]}, '$.{e.name}')"
        ctes.append(f"t_{e.name} AS (SELECT source, record_id, id AS pid, unnest({_members(value, e.id_field)}) AS sub FROM o_{e.parent})")
        selects.append(f"SELECT source, record_id, '{e.name}', json_extract_string(sub, '$.{e.id_field}'), '{e.parent}', pid FROM t_{e.name} WHERE json_type(sub) = 'OBJECT' AND coalesce(json_extract_string(sub, '$.{e.id_field}'), '') <> ''")
    return f"WITH {', '.join(ctes)}, found AS ({' UNION '.join(selects)})"


def table_sql(*names: str) -> str:
    """``_tables_sql`` as a list of common tables: w is each record, o_<table> has source, record_id, id and obj of each object."""
    return _tables_sql().removeprefix("WITH ")


_TEXTS = "CASE json_type(json_extract(obj, '$.aliases')) WHEN 'ARRAY' THEN len(json_extract(obj, '$.aliases[*]')) ELSE 0 END"
ORACLES["p5_people_mentions"] = f"""{_tables_sql()} SELECT DISTINCT source, record_id, id AS entity_id, json_extract_string(obj, '$.name') AS name, json_extract_string(obj, '$.category') AS category,
TRY_CAST(json_extract_string(obj, '$.confidence') AS DOUBLE) AS confidence, CAST({_TEXTS} AS INTEGER) AS n_aliases FROM o_people_mentions"""
ORACLES["p5_found"] = f"{_tables_sql()} SELECT * FROM found"
ORACLES["p5_tables"] = f"{_tables_sql()} SELECT source, entity, parent_entity, count(*) AS n_rows FROM found GROUP BY ALL"
