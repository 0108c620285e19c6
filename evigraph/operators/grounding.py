"""How well transcripts ground what was extracted: couples and siblings they name, evidence classes, decisions on claims.

Defined results: a claim without a signal for its pair is insufficient; a pair with signals of two kinds contradicts both; a
mention that its cited segments do not name has the class of an inference; null names are inferences.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import kinship as K
from evigraph.functions import lexicon
from evigraph.functions.text import stable_id
from evigraph.operators.linguistics import Span, _phrases, _rows, names_in, tokens, units
from evigraph.runtime import ship


def _cues(phrases, kind: str, ts: list[Span]) -> list[Span]:
    table = {tuple(p.split()): p for p in phrases}
    return [Span(s.start, s.end, s.text, kind, str(v)) for s, v in _phrases(ts, table, kind)]


def pair_signals(text: str, people: list[dict]) -> list[tuple[str, str, str, str]]:
    """(type, first, second, rule) of couples and siblings that a text names as a pair, in order of their mentions.

    Within one unit: exactly two joined names with a cue after them (or before, where the cue allows it), or one name, a phrase
    that marries, and another name. A negation, a former state or, for siblings, a cousin in the unit gives no signal.
    """
    ts = tokens(text)
    found = names_in(ts, people)
    out = set()
    for u in units(text):
        own = [t for t in ts if u.start <= t.start and t.end <= u.end]
        words = {t.info for t in own}
        named = [(s, m) for s, m in found if u.start <= s.start and s.end <= u.end]
        if words & set(lexicon.NEGATION) or words & set(K.ENDED):
            continue
        direct = _cues(K.MARRY, "marry", own)
        joined = [
            (a, b, m, n)
            for i, (a, m) in enumerate(named)
            for b, n in named[i + 1 : i + 2]
            if m != n and [t.info for t in own if a.end <= t.start and t.end <= b.start] in [[j] for j in K.JOINERS]
        ]
        if len({m for _, m in named}) == 2:
            for a, b, m, n in joined:
                for c in _cues(K.COUPLE_CUES, "couple", own):
                    if 0 <= c.start - b.end <= K.PAIR_CHARS or (K.COUPLE_CUES[c.info] and 0 <= a.start - c.end <= K.BEFORE_PAIR_CHARS):
                        out.add(("spouse", *sorted((m, n)), "pair.couple"))
                if not words & set(K.COUSINS):
                    for c in _cues(K.SIBLING_CUES, "sibling", own):
                        if 0 <= c.start - b.end <= K.PAIR_CHARS:
                            out.add(("sibling", *sorted((m, n)), "pair.sibling"))
            for c in direct:
                before = [m for s, m in named if s.end <= c.start]
                after = [m for s, m in named if 0 <= s.start - c.end <= 2]
                if before and after and before[-1] != after[0]:
                    out.add(("spouse", *sorted((before[-1], after[0])), "pair.direct"))
    return sorted(out)


_PAIRS = pa.schema([(n, pa.string()) for n in ("record", "segment_id", "relationship_type", "first", "second", "rule")])


def _pairs(batches):
    return _rows(batches, _PAIRS, lambda r: [(r["record"], g["segment_id"], *x) for g in r["segments"] or () if g["text"] for x in pair_signals(g["text"], r["people"] or [])])


def named_pairs(joined: DataFrame) -> DataFrame:
    """Couples and siblings that the segments name as pairs."""
    ship(joined.sparkSession)
    return joined.select("record", "segments", "people").mapInArrow(_pairs, ", ".join(f"{f.name} string" for f in _PAIRS))


def mention_classes(people: DataFrame, occurrences: DataFrame, anchors: DataFrame, speakers: DataFrame) -> DataFrame:
    """(record, mention_id, evidence_class) of every mention, by how its record names it.

    ``people``: record, mention_id, name; ``occurrences``: record, mention_id, form; ``anchors``: record of transcripts with a
    first-person word; ``speakers``: record, speaker.
    """
    forms = occurrences.groupBy("record", "mention_id").agg(F.max((F.col("form") == "exact").cast("int")).alias("exact"))
    speaking = anchors.select("record").distinct().withColumn("first_person", F.lit(True))
    rows = people.select("record", "mention_id", "name").dropDuplicates(["record", "mention_id"]).join(forms, ["record", "mention_id"], "left").join(speakers, "record", "left").join(speaking, "record", "left")
    cls = (
        F.when(F.col("exact") == 1, lexicon.EVIDENCE_CLASSES[0])
        .when(F.col("exact") == 0, lexicon.EVIDENCE_CLASSES[1])
        .when((F.col("name") == F.col("speaker")) & F.col("first_person"), lexicon.EVIDENCE_CLASSES[2])
        .otherwise(lexicon.EVIDENCE_CLASSES[4])
    )
    return rows.select("record", "mention_id", cls.alias("evidence_class"))


def claim_decisions(claims: DataFrame, signals: DataFrame) -> DataFrame:
    """(record, relationship_id, decision): supported, contradicted or insufficient.

    ``claims``: record, relationship_id, relationship_type, subject, object; ``signals``: record, relationship_type, subject,
    object. Pairs are compared without direction, then types.
    """
    pair = lambda: (F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"))
    told = signals.select("record", *pair(), "relationship_type").groupBy("record", "a", "b").agg(F.collect_set("relationship_type").alias("types"))
    c = claims.select("record", "relationship_id", "relationship_type", *pair()).distinct().join(told, ["record", "a", "b"], "left")
    decision = F.when(F.col("types").isNull(), "insufficient").when((F.size("types") == 1) & F.array_contains("types", F.col("relationship_type")), "supported").otherwise("contradicted")
    return c.select("record", "relationship_id", decision.alias("decision"))


def activities(cases: DataFrame) -> DataFrame:
    """Three activities of every transcript's history: recognition, extraction and sanitizing, with content-addressed ids."""
    t = F.col("transcript")
    rows = cases.select(F.col("case_id").alias("record"), t["recording_id"].alias("recording_id"), t["asr_model"].alias("m"), t["asr_revision"].alias("v")).dropDuplicates(["record"])
    act = lambda stage, system, version: F.struct(F.lit(stage).alias("stage"), system.alias("system"), version.alias("version"))
    each = F.explode(F.array(act("asr", F.col("m"), F.col("v")), act("extractor", F.lit("recorded"), F.lit("1")), act("sanitizer", F.lit("evigraph"), F.lit("1"))))
    out = rows.select("record", "recording_id", each.alias("x")).select("record", "recording_id", "x.*")
    return out.withColumn("activity_id", stable_id("activity", F.col("recording_id"), F.col("stage"), F.col("system"), F.col("version")))


def merge_passes(passes: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Objects of all passes, each once by the key of its kind: (record, kind, key, pass_order, payload); the earliest pass stands.

    ``passes``: record, kind, pass_order, payload (a JSON object); ``keys``: the fields that make the key of each kind.
    """
    value = F.lit(None).cast("string")
    for kind, fields in keys.items():
        value = F.when(F.col("kind") == kind, F.concat_ws("\x1f", *(F.lower(F.trim(F.coalesce(F.get_json_object("payload", f"$.{f}"), F.lit("")))) for f in fields))).otherwise(value)
    rows = passes.withColumn("key", value).where("key is not null")
    return rows.groupBy("record", "kind", "key").agg(F.min(F.struct("pass_order", "payload")).alias("m"), (F.count("*") - 1).alias("n_dropped")).select("record", "kind", "key", "m.pass_order", "m.payload", "n_dropped")


def graded(classes: Column) -> Column:
    """Whether the weakest of an array of classes may be accepted without review."""
    return F.forall(classes, lambda c: c.isin(*lexicon.EVIDENCE_CLASSES[:3]))
