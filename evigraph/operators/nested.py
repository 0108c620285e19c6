"""Deeply nested records to flat related tables.

One pass: a depth-first visitor with an explicit stack goes through each document once and emits rows tagged with their
table, primary key, parent key and payload. ``write_tables`` stores them partitioned by tag, ``read_table`` applies a
schema to one tag.

Defined results: a null, blank or invalid document gives no row; an object without an id gives no row and neither does
anything below it; a collection may be a list, a single object, a map from id to object, or any of these as a JSON
string; null collections and null members are skipped; ids that are not strings are written as JSON; a document that
came twice gives each of its rows once. Nothing is lost: a collection that is no table where it stands stays in the payload of the
object that holds it, objects of unknown wrappers are searched for tables like the known ones, and what else a record holds beside
its tables is the payload of its one row of the table ``rest``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.runtime import materialize, ship


@dataclass(frozen=True)
class Entity:
    """A flat table: the key that holds its objects, the field with their id, the table of their parent ('' = the record)."""

    name: str
    id_field: str
    parent: str = ""


@dataclass(frozen=True)
class Layout:
    """All tables of a kind of document, and the wrappers that the visitor passes through without a row of their own."""

    root: str
    entities: tuple[Entity, ...]
    wrappers: frozenset[str] = field(default_factory=frozenset)


#: The tables and id fields of the project's records.
ENTITIES = (
    Entity("evidence_spans", "evidence_id"),
    Entity("coreference_links", "coreference_id"),
    Entity("conflict_sets", "conflict_id"),
    Entity("people_mentions", "mention_id"),
    Entity("relationship_claims", "relationship_id"),
    Entity("events", "event_id"),
    Entity("descriptions", "description_id"),
    Entity("stories", "story_id"),
    Entity("unresolved_questions", "question_id"),
    Entity("resolutions", "mention_id"),
    Entity("passes", "pass_id"),
    Entity("name_variants", "variant_id", "people_mentions"),
    Entity("claim_refs", "object_id", "conflict_sets"),
    Entity("supporting_signals", "rule_id", "resolutions"),
    Entity("calls", "call_id", "passes"),
)
WRAPPERS = frozenset({"result", "extraction", "processing", "trace"})

TAGGED = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "record_id", "entity", "entity_id", "parent_entity", "parent_id", "payload")])

#: Schemas of the flat tables, over the payload; absent fields become null.
_UNCERTAIN = "uncertainty struct<status:string,markers:array<string>,evidence_ids:array<string>,source_segment_ids:array<string>>"
_CLAIM = f"source_segment_ids array<string>, evidence_ids array<string>, evidence_class string, verification_status string, assertion_mode string, {_UNCERTAIN}, provenance struct<recording_id:string,narrator:string,generated_by_activity_id:string,evidence_ids:array<string>>, derived_from_claim_ids array<string>, conflict_ids array<string>"
_DATE = "struct<value:string,kind:string,approximate:boolean,original_expression:string,normalized_value:string,anchor_event_id:string,source_evidence_ids:array<string>,verification_status:string>"
SCHEMAS = {
    "rest": "recording_id string, speaker_id string, speaker_name string, languages array<string>",
    "people_mentions": f"mention_id string, name string, category string, relation_to_speaker string, confidence double, aliases array<string>, {_CLAIM}",
    "name_variants": "variant_id string, surface string, variant_type string, source_segment_ids array<string>, verification_status string",
    "relationship_claims": f"relationship_id string, relationship_type string, relationship_state string, subject_mention_id string, object_mention_id string, state_evidence_ids array<string>, {_CLAIM}",
    "evidence_spans": "evidence_id string, segment_id string, text string, source_layer string, evidence_class string, start_char int, end_char int, purposes array<string>, derived_from_evidence_ids array<string>",
    "coreference_links": "coreference_id string, anaphor_text string, status string, source_segment_ids array<string>, candidate_mention_ids array<string>, antecedent_mention_ids array<string>, evidence_ids array<string>, verification_status string",
    "conflict_sets": "conflict_id string, conflict_type string, status string, evidence_ids array<string>",
    "claim_refs": "object_id string, object_type string",
    "events": f"event_id string, event_type string, title string, location string, description string, participant_mention_ids array<string>, date {_DATE}, {_CLAIM}",
    "descriptions": f"description_id string, person_mention_id string, description string, perspective string, {_CLAIM}",
    "stories": f"story_id string, title string, summary string, privacy string, sensitivity string, person_mention_ids array<string>, event_ids array<string>, {_CLAIM}",
    "unresolved_questions": "question_id string, question string, reason string, related_mention_ids array<string>, source_segment_ids array<string>, evidence_ids array<string>",
    "resolutions": "mention_id string, status string, person_id string",
    "supporting_signals": "rule_id string, kind string, detail string",
    "passes": "pass_id string, name string, status string",
    "calls": "call_id string, model string, status string",
}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _loads(text: str) -> object:
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def _members(value: object, id_field: str) -> list[dict]:
    """The objects of a collection, whatever its shape."""
    if isinstance(value, str):
        value = _loads(value) if value.lstrip()[:1] in ("[", "{") else None
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if isinstance(value, dict):
        if id_field in value:
            return [value]
        return [x for x in value.values() if isinstance(x, dict) and id_field in x]
    return []


#: The table of what a record holds outside its tables; its id is that of the record.
REST = "rest"


def visit(document: object, record_id: str, layout: Layout, with_payload: bool = True) -> Iterator[tuple[str, str, str, str, str | None]]:
    """(entity, entity_id, parent_entity, parent_id, payload) of every object with an id, depth first."""
    tables = {(e.parent, e.name): e for e in layout.entities}
    stack: list[tuple[object, str, str, str]] = [(document, "", record_id, "")]
    rest: dict[str, object] = {}
    while stack:
        node, table, key, place = stack.pop()
        if not isinstance(node, dict):
            continue
        below = []
        for name, value in node.items():
            entity = tables.get((table, name))
            if entity is not None:
                for x in _members(value, entity.id_field):
                    id_ = x.get(entity.id_field)
                    if id_ is None or id_ == "":
                        continue
                    id_ = id_ if isinstance(id_, str) else json.dumps(id_)
                    payload = None
                    if with_payload:
                        payload = json.dumps({k: v for k, v in x.items() if (entity.name, k) not in tables}, ensure_ascii=False)
                    yield entity.name, id_, table or layout.root, key, payload
                    below.append((x, entity.name, id_, ""))
            elif name in layout.wrappers:
                if isinstance(value, str):
                    value = _loads(value)
                below.append((value, table, key, f"{place}{name}."))
            elif not table and isinstance(value, dict):
                below.append((value, table, key, f"{place}{name}."))
            elif not table and with_payload:
                rest[place + name] = value
        stack.extend(reversed(below))
    if rest:
        yield REST, record_id, layout.root, record_id, json.dumps(rest, ensure_ascii=False)


def _emit(batches: Iterator[pa.RecordBatch], source: str, layout: Layout, with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.name, pa.string()) for f in TAGGED])
    for b in batches:
        rows = []
        for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            document = _loads(text)
            if isinstance(document, dict):
                rows.extend((source, rid, *r) for r in visit(document, rid, layout, with_payload))
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)


def flatten_records(df: DataFrame, source: str, record_id: str, document: str, layout: Layout, with_payload: bool = True) -> DataFrame:
    """Tagged rows (source, record_id, entity, entity_id, parent_entity, parent_id, payload) of all documents of ``df``."""
    ship(df.sparkSession)
    two = df.where(F.col(document).isNotNull() & F.col(record_id).isNotNull()).select(F.col(record_id).alias("record_id"), F.col(document).alias("document"))
    return two.mapInArrow(partial(_emit, source=source, layout=layout, with_payload=with_payload), TAGGED)


def write_tables(tagged: DataFrame, path: str) -> None:
    """Store tagged rows partitioned by their table."""
    tagged.write.partitionBy("entity").mode("overwrite").parquet(path)


def typed(tagged: DataFrame, entity: str) -> DataFrame:
    """One flat table with typed columns; equal rows that were delivered twice come once."""
    rows = tagged.where(F.col("entity") == entity).distinct()
    return rows.select("source", "record_id", "entity_id", "parent_entity", "parent_id", F.from_json("payload", SCHEMAS[entity]).alias("p")).select("source", "record_id", "entity_id", "parent_entity", "parent_id", "p.*")


def read_table(spark, path: str, entity: str) -> DataFrame:
    """One flat table of ``write_tables``; only its own partition is read."""
    return typed(spark.read.schema(TAGGED).parquet(path), entity)


def project_records(read) -> DataFrame:
    """Tagged rows of the project's two kinds of document; ``read(table)`` gives a table."""
    one = Layout("raw_extraction", ENTITIES, WRAPPERS)
    two = Layout("payload", ENTITIES, WRAPPERS)
    a = flatten_records(read("benchmark_cases"), "benchmark_cases", "case_id", "raw_extraction", one)
    b = flatten_records(read("pipeline_results"), "pipeline_results", "recording_id", "payload", two)
    return a.unionByName(b)


def stored(tagged: DataFrame) -> DataFrame:
    """Tagged rows written by table to the shared folder and read again; a query of one table reads that table's files only."""
    return materialize(tagged, by=["entity"])
