"""What a transcript says about people: tokens, units, quotations, names, kinship, pronouns, and the signals they make.

One Arrow pass over rows that hold a whole transcript with its people; a transcript is bounded, so a row is. No row meets
another record's. The rules are fail-closed: where two readings are possible there is no signal.

Defined results: null and empty segments have no annotations; a record without people has no names and no signals; people
whose name is null or has no letters are skipped; offsets count code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import kinship as K
from evigraph.functions import lexicon
from evigraph.runtime import ship

_WORD = re.compile(r"[^\W_]+")
_SOLID = re.compile(r"\S+")
_QUOTES = {"«": "»", "“": "”", "„": "“"}


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    text: str
    kind: str
    info: str = ""


def tokens(text: str) -> list[Span]:
    """Words with offsets; ``info`` is their compatible, case-folded form."""
    return [Span(m.start(), m.end(), m.group(), "token", unicodedata.normalize("NFKC", m.group()).casefold()) for m in _WORD.finditer(text)]


def quotation_scopes(text: str) -> list[int]:
    """For each character: 0 outside quotations, else the number of the innermost open one; a stray closing mark opens for good."""
    out, stack, n = [], [], 0
    for c in text:
        if c in _QUOTES or (c == '"' and (not stack or stack[-1][0] != c)):
            n += 1
            stack.append((_QUOTES.get(c, '"'), n))
            out.append(n)
            continue
        out.append(stack[-1][1] if stack else 0)
        if c in _QUOTES.values() or c == '"':
            if stack and stack[-1][0] == c:
                stack.pop()
            elif c != '"':
                n += 1
                stack.append(("", n))
    return out


def _gaps(text: str, ts: list[Span]) -> Iterator[tuple[int, int, int]]:
    """(start, end, number of the word that follows) of what stands before, between and after the words of a text."""
    at = 0
    for i, t in enumerate(ts):
        yield at, t.start, i
        at = t.end
    yield at, len(text), len(ts)


def _pieces(text: str, cuts: list[int], kind: str, apart: str) -> list[Span]:
    """What lies between neighbouring cuts, without outer white space; pieces of nothing but ``apart`` are left out."""
    out = []
    for a, b in pairwise([0, *sorted(set(cuts)), len(text)]):
        body = text[a:b].rstrip()
        inner = body.lstrip()
        if inner.strip(apart):
            out.append(Span(a + len(body) - len(inner), a + len(body), inner, kind))
    return out


def _turns(text: str, ts: list[Span], i: int) -> bool:
    """Whether the subject turns at the word ``i``: a word of turning before white space, or a joining one before a pronoun."""
    if i >= len(ts) or not text[ts[i].end : ts[i].end + 1].isspace():
        return False
    if ts[i].info in K.SWITCHES:
        return True
    return ts[i].info in K.WEAK_SWITCHES and i + 1 < len(ts) and ts[i + 1].info in K.SWITCH_PRONOUNS and not text[ts[i].end : ts[i + 1].start].strip()


def units(text: str, most: int = lexicon.CONTEXT_CHARS) -> list[Span]:
    """Sentences, cut where the subject turns, and packed by words where they are longer than ``most``.

    A scan over the gaps between words: each run of end marks in a gap ends a unit, and so does the white space or comma before
    a word at which the subject turns.
    """
    ts = tokens(text)
    cuts = []
    for a, b, following in _gaps(text, ts):
        ended = [k + 1 for k in range(a, b) if text[k] in K.UNIT_ENDS and (k + 1 == len(text) or text[k + 1] not in K.UNIT_ENDS)]
        cuts += ended
        before = text[a:b].rstrip()
        if not (ended and ended[-1] == a + len(before)) and len(before) < b - a + before.endswith(",") and _turns(text, ts, following):
            cuts.append(a + len(before) - before.endswith(","))
    found = _pieces(text, cuts, "unit", K.UNIT_ENDS)
    if not found and text.strip():
        found = _pieces(text, [], "unit", "")
    return [x for u in found for x in (_packed(u, most) if u.end - u.start > most else [u])]


def _packed(unit: Span, most: int) -> list[Span]:
    """A unit as runs of whole words of at most ``most`` characters; a word that is longer is cut into blocks."""
    starts, ends = zip(*((m.start(), m.end()) for m in _SOLID.finditer(unit.text)), strict=True)
    spans = []
    i = 0
    while i < len(starts):
        j = bisect_right(ends, starts[i] + most)
        if j > i:
            spans.append((starts[i], ends[j - 1]))
        else:
            spans += [(k, min(k + most, ends[i])) for k in range(starts[i], ends[i], most)]
        i = max(j, i + 1)
    return [Span(unit.start + a, unit.start + b, unit.text[a:b], "unit") for a, b in spans]


def _table(groups: dict, language: str) -> dict[tuple[str, ...], tuple[str, tuple]]:
    out = {}
    for frame, words in groups.items():
        for w in words:
            out[tuple(w.split())] = (language, frame)
    return out


_MY = _table(K.KAZAKH_MY, "kk_my")
_KIN = _table(K.KAZAKH_OF, "kk") | _table(K.RUSSIAN, "ru") | _table(K.RUSSIAN_PHRASES, "ru") | _table(K.ENGLISH, "en") | _table(K.ENGLISH_PHRASES, "en") | _MY


def _base(word: str) -> str:
    """A Kazakh word without its case ending, if that leaves a kinship word."""
    for e in K.KAZAKH_CASES:
        if word.endswith(e) and (word[: -len(e)],) in _KIN:
            return word[: -len(e)]
    return word


def _phrases(ts: list[Span], table: dict, kind: str, form=lambda w: w) -> Iterator[tuple[Span, object]]:
    """Longest entries of a table of word tuples, left to right."""
    i, longest = 0, max(map(len, table), default=0)
    while i < len(ts):
        for n in range(min(longest, len(ts) - i), 0, -1):
            key = tuple(form(t.info) if n == 1 else t.info for t in ts[i : i + n])
            if key in table:
                yield Span(ts[i].start, ts[i + n - 1].end, " ".join(t.text for t in ts[i : i + n]), kind), table[key]
                i += n
                break
        else:
            i += 1


def kinship(ts: list[Span]) -> list[tuple[Span, str, tuple]]:
    """(span, language, frame) of kinship words, phrases first."""
    return [(s, lang, frame) for s, (lang, frame) in _phrases(ts, _KIN, "kinship", _base)]


def _pronouns() -> dict[tuple[str, ...], tuple[str, str]]:
    out = {}
    for number, groups in (("singular", K.SINGULAR), ("plural", K.PLURAL)):
        for lang, words in groups.items():
            out |= {(w,): (lang, number) for w in words}
    for number, groups in (("singular", K.COMPOUND_SINGULAR), ("plural", K.COMPOUND_PLURAL)):
        for lang, phrases in groups.items():
            out |= {tuple(p.split()): (lang, number) for p in phrases}
    return out


_PRONOUNS = _pronouns()
_ANCHORS = {(w,): lang for lang, ws in K.FIRST_PERSON.items() for w in ws} | {tuple(p.split()): lang for lang, ps in K.FIRST_PERSON_PHRASES.items() for p in ps}


def anaphors(ts: list[Span]) -> list[tuple[Span, str, str]]:
    """(span, language, number) of third-person words, compounds first."""
    return [(s, lang, number) for s, (lang, number) in _phrases(ts, _PRONOUNS, "anaphor")]


def anchors(ts: list[Span]) -> list[Span]:
    """First-person words, and Kazakh kinship words that say "my" by themselves."""
    found = [Span(s.start, s.end, s.text, "anchor", str(lang)) for s, lang in _phrases(ts, _ANCHORS, "anchor")]
    return found + [Span(s.start, s.end, s.text, "anchor", lang) for s, lang, _ in kinship(ts) if lang == "kk_my"]


def russian_forms(name: str) -> set[str]:
    """Case forms of a Russian given name by its last letter."""
    for lasts, dropped, endings in K.RUSSIAN_ENDINGS:
        if name[-1:] in lasts and name:
            return {name, *(name[: len(name) - dropped] + e for e in endings)}
    return {name}


def name_matches(ts: list[Span], name: str) -> list[Span]:
    """Where a name stands: its words in a row, or its single word with a Kazakh or Russian ending or an English possessive."""
    want = [t.info for t in tokens(name)]
    if not want:
        return []
    out = []
    for i in range(len(ts) - len(want) + 1):
        run = ts[i : i + len(want)]
        head, last, got = [t.info for t in run[:-1]], run[-1], want[-1]
        if head != want[:-1]:
            continue
        how = None
        if last.info == got:
            how = "exact"
            if i + len(want) < len(ts) and ts[i + len(want)].info == "s" and ts[i + len(want)].start == last.end + 1:
                how = "possessive"
        elif len(got) >= 3 and last.info.startswith(got) and last.info[len(got) :] in K.KAZAKH_CASES:
            how = "genitive" if last.info[len(got) :] in K.KAZAKH_GENITIVE else "case"
        elif len(got) >= 3 and last.info in russian_forms(got):
            how = "case"
        if how:
            out.append(Span(run[0].start, last.end, " ".join(t.text for t in run), "name", how))
    return out


def names_in(ts: list[Span], people: list[dict]) -> list[tuple[Span, str]]:
    """(span, mention) of all people; of names that begin at one place the longest stands."""
    found = [(s, p["mention_id"]) for p in people if p.get("name") for s in name_matches(ts, p["name"])]
    longest: dict[int, int] = {}
    for s, _ in found:
        longest[s.start] = max(longest.get(s.start, 0), s.end)
    return sorted({(s, m) for s, m in found if s.end == longest[s.start]}, key=lambda x: (x[0].start, x[1]))


def signals(text: str, people: list[dict], speaker: str | None) -> list[tuple[str, str, str, str, str, str]]:
    """(type, subject, subject role, object, object role, rule) that a segment states; one target near a kinship word, else none.

    The subject is the possessor: the speaker beside a first-person word, or the person whose genitive stands before.
    """
    ts = tokens(text)
    found = names_in(ts, people)
    scopes = quotation_scopes(text)
    out = []
    for span, lang, frame in kinship(ts):
        before = [t for t in ts if t.end <= span.start][-2:]
        owner, rule = None, ""
        genitive = [m for s, m in found if s.info in ("genitive", "possessive") and 0 <= span.start - s.end <= 4]
        if lang == "kk_my" or any(t.info in K.POSSESSIVE.get(lang, ()) for t in before):
            owner, rule = speaker, "speaker"
        elif len(set(genitive)) == 1:
            owner, rule = genitive[0], "named"
        if owner is None:
            continue
        near = {m for s, m in found if 0 <= s.start - span.end <= lexicon.NEAR_CHARS and m != owner and scopes[s.start] == scopes[span.start] and not re.search(r"[.!?…\n]", text[span.end : s.start])}
        negated = any(t.info in lexicon.NEGATION for t in before)
        if len(near) == 1 and not negated:
            kind, possessor, relative = frame
            target = near.pop()
            first, second = (owner, possessor), (target, relative)
            if kind == "spouse" and second < first:
                first, second = second, first
            out.append((kind, *first, *second, f"{lang}.{rule}"))
    return sorted(set(out))


def links(segments: list[dict], people: list[dict]) -> list[tuple[str, int, int, str, str, str, str, str]]:
    """(segment, start, end, surface, number, status, antecedents, candidates) of third-person words before a kinship word.

    Candidates stand before the word in its own unit, else in the unit before; both fit one context. A singular word with one
    candidate is resolved, a plural one only with an explicit couple; other words with candidates are ambiguous.
    """
    flow = []
    for g in segments:
        text = g["text"] or ""
        ts = tokens(text)
        cited = [p for p in people if not p.get("source_segment_ids") or g["segment_id"] in p["source_segment_ids"]]
        flow += [(g["segment_id"], text, u, ts, quotation_scopes(text), names_in(ts, cited)) for u in units(text)]
    out = []
    for i, (segment, text, unit, ts, scopes, found) in enumerate(flow):
        own = [t for t in ts if unit.start <= t.start and t.end <= unit.end]
        kin = kinship(own)
        for span, _, number in anaphors(own):
            if scopes[span.start]:
                continue
            if not any(0 <= k.start - span.end <= lexicon.KINSHIP_CHARS and scopes[k.start] == 0 for k, _, _ in kin):
                continue
            here = [(s, m) for s, m in found if unit.start <= s.start and s.end <= span.start and scopes[s.start] == 0]
            context = text[unit.start : span.start]
            if not here and i:
                _, text0, unit0, _, scopes0, found0 = flow[i - 1]
                if unit0.end - unit0.start + unit.end - unit.start + 1 <= lexicon.CONTEXT_CHARS:
                    here = [(s, m) for s, m in found0 if unit0.start <= s.start and s.end <= unit0.end and scopes0[s.start] == 0]
                    context = text0[unit0.start : unit0.end]
            candidates = sorted({m for _, m in here})
            if not candidates:
                continue
            words = {t.info for t in tokens(context)}
            couple = len(candidates) == 2 and words & set(K.JOINERS) and words & set(K.COUPLE)
            if number == "singular" and len(candidates) == 1 or number == "plural" and couple:
                status, antecedents = "resolved", candidates
            elif len(candidates) > 1:
                status, antecedents = "ambiguous", []
            else:
                status, antecedents = "unresolved", []
            out.append((segment, span.start, span.end, span.text, number, status, ",".join(antecedents), ",".join(candidates)))
    return out


def clauses(text: str) -> list[Span]:
    """Clauses: a cut after end marks before white space, at dots of omission, and before words that oppose."""
    ts = tokens(text)
    cuts = []
    for a, b, following in _gaps(text, ts):
        gap = text[a:b]
        cuts += [a + k + 1 for k, c in enumerate(gap) if c in K.CLAUSE_ENDS and gap[k + 1 : k + 2].isspace() or c == "." and gap[k - 1 : k] == "." and gap[k + 1 : k + 2] != "."]
        if following < len(ts) and ts[following].info in K.OPPOSING and gap[-1:].isspace() and text[b + len(ts[following].text) :][:1].isspace():
            cuts.append(b)
    return _pieces(text, cuts, "clause", "")


def uncertainty(text: str) -> list[Span]:
    """Phrases of uncertainty outside quotations, with their status; none after a negation or near a word of certainty."""
    ts = tokens(text)
    table = {tuple(t.info for t in tokens(p)): (status, p) for status, ps in lexicon.UNCERTAINTY.items() for p in ps}
    scopes = quotation_scopes(text)
    guards = [s for s, _ in _phrases(ts, {tuple(g.split()): g for g in lexicon.UNCERTAINTY_GUARDS}, "guard")]
    out = []
    for s, (status, phrase) in _phrases(ts, table, "uncertainty"):
        before = [t.info for t in ts if t.end <= s.start][-1:]
        own = set(phrase.split())
        near = any(g.text.casefold() not in own and max(g.start - s.end, s.start - g.end) <= lexicon.GUARD_CHARS and not (s.start <= g.start < s.end) for g in guards)
        if scopes[s.start] == 0 and before != ["не"] and not near:
            out.append(Span(s.start, s.end, s.text, "uncertainty", status))
    return out


def scoped_uncertainty(text: str, surface: str) -> str | None:
    """The status of a surface: reported where it stands only inside reported quotations, else that of the markers of its one
    clause, unresolved where its clause cannot be told, None without a marker."""
    ts = tokens(text)
    hits = name_matches(ts, surface)
    scopes = quotation_scopes(text)
    if hits and all(scopes[h.start] for h in hits) and any(t.info in lexicon.REPORTED for t in ts):
        return "reported"
    found = uncertainty(text)
    if not found:
        return None
    own = [c for c in clauses(text) if any(c.start <= h.start < c.end for h in hits)]
    if len(own) != 1:
        return "unresolved"
    order = ("uncertain", "remembered_imprecisely", "unresolved")
    inside = [m.info for m in found if own[0].start <= m.start < own[0].end]
    return max(inside, key=order.index) if inside else None


def annotations(text: str) -> list[Span]:
    """Units, kinship words, third-person words, first-person anchors and phrases of uncertainty of a text."""
    ts = tokens(text)
    out = list(units(text)) + anchors(ts) + uncertainty(text)
    out += [Span(s.start, s.end, s.text, "kinship", f"{lang}:{frame[0]}:{frame[2]}") for s, lang, frame in kinship(ts)]
    out += [Span(s.start, s.end, s.text, "anaphor", f"{lang}:{number}") for s, lang, number in anaphors(ts)]
    return sorted(out, key=lambda s: (s.start, s.end, s.kind))


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [x for r in b.to_pylist() for x in make(r)]
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ANNOTATED = pa.schema([("record", pa.string()), ("segment_id", pa.string()), ("kind", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("surface", pa.string()), ("info", pa.string())])
ANNOTATED = "record string, segment_id string, kind string, start_char int, end_char int, surface string, info string"


def _annotate(batches):
    return _rows(batches, _ANNOTATED, lambda r: [(r["record"], g["segment_id"], s.kind, s.start, s.end, s.text, s.info) for g in r["segments"] or () if g["text"] for s in annotations(g["text"])])


def annotate(transcripts: DataFrame) -> DataFrame:
    """Annotations of (record, segments) rows; Python because offsets of words need a scanner."""
    ship(transcripts.sparkSession)
    return transcripts.select("record", "segments").mapInArrow(_annotate, ANNOTATED)


def with_people(transcripts: DataFrame, people: DataFrame) -> DataFrame:
    """(record, speaker, segments, people): people (record, mention_id, name, source_segment_ids) in one array a record."""
    each = people.select("record", F.struct("mention_id", "name", "source_segment_ids").alias("p")).where("p.mention_id is not null").distinct()
    return transcripts.join(each.groupBy("record").agg(F.array_sort(F.collect_list("p")).alias("people")), "record", "left")


_NAMES = pa.schema([("record", pa.string()), ("segment_id", pa.string()), ("mention_id", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("surface", pa.string()), ("form", pa.string())])


def _names(batches):
    return _rows(batches, _NAMES, lambda r: [(r["record"], g["segment_id"], m, s.start, s.end, s.text, s.info) for g in r["segments"] or () if g["text"] for s, m in names_in(tokens(g["text"]), r["people"] or [])])


def name_occurrences(joined: DataFrame) -> DataFrame:
    """Where each person of a record is named, and in which form."""
    ship(joined.sparkSession)
    return joined.select("record", "segments", "people").mapInArrow(_names, "record string, segment_id string, mention_id string, start_char int, end_char int, surface string, form string")


_SIGNALS = pa.schema([(n, pa.string()) for n in ("record", "segment_id", "relationship_type", "subject", "subject_role", "object", "object_role", "rule")])


def _speaker_id(r: dict) -> str:
    """The mention whose name is the speaker's, if there is one; else the speaker."""
    want = [t.info for t in tokens(r["speaker"] or "")]
    same = [p["mention_id"] for p in r["people"] or () if p["name"] and [t.info for t in tokens(p["name"])] == want and want]
    return same[0] if len(same) == 1 else "speaker"


def _signals(batches):
    return _rows(batches, _SIGNALS, lambda r: [(r["record"], g["segment_id"], *x) for g in r["segments"] or () if g["text"] for x in signals(g["text"], r["people"] or [], _speaker_id(r))])


def relationship_signals(joined: DataFrame) -> DataFrame:
    """The relationships that the segments state."""
    ship(joined.sparkSession)
    return joined.select("record", "speaker", "segments", "people").mapInArrow(_signals, ", ".join(f"{f.name} string" for f in _SIGNALS))


_LINKS = pa.schema([("record", pa.string()), ("segment_id", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), *((n, pa.string()) for n in ("surface", "number", "status", "antecedents", "candidates"))])


def _links(batches):
    return _rows(batches, _LINKS, lambda r: [(r["record"], *x) for x in links([g for g in r["segments"] or ()], r["people"] or [])])


def coreference_links(joined: DataFrame) -> DataFrame:
    """Third-person words before kinship, with candidates and status."""
    ship(joined.sparkSession)
    return joined.select("record", "segments", "people").mapInArrow(_links, "record string, segment_id string, start_char int, end_char int, surface string, number string, status string, antecedents string, candidates string")


def alias_linked(text: str, alias: str, name: str) -> bool:
    """Whether a text says that ``alias`` is another name: a cue stands beside it, at most one word between, and it has the name."""
    ts = tokens(text)
    cues = {tuple(c.split()): c for c in lexicon.ALIAS_CUES}
    found = [s for s, _ in _phrases(ts, cues, "cue")]
    hits = name_matches(ts, alias)
    near = False
    for h in hits:
        for c in found:
            a, b = (c.end, h.start) if c.end <= h.start else (h.end, c.start)
            near = near or (b < a) or (b - a <= lexicon.ALIAS_CHARS and len(_WORD.findall(text[a:b])) <= 1)
    return near and (bool(name_matches(ts, name)) or [t.info for t in tokens(name)] == [t.info for t in tokens(alias)])


def name_candidates(ts: list[Span]) -> list[Span]:
    """Words with a capital within four words of a kinship word that are no kinship, pronoun or first-person word themselves."""
    kin = [i for i, t in enumerate(ts) if (_base(t.info),) in _KIN]
    plain = lambda t: (t.info,) not in _PRONOUNS and (t.info,) not in _ANCHORS and (_base(t.info),) not in _KIN
    return [Span(t.start, t.end, t.text, "name_candidate") for i, t in enumerate(ts) if t.text[0].isupper() and plain(t) and any(abs(i - k) <= 4 for k in kin)]


_ANCHORED = pa.schema([("record", pa.string()), ("anchor_id", pa.string()), ("kind", pa.string()), ("segment_id", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("surface", pa.string()), ("mention_id", pa.string())])


def _bundle(r: dict) -> list[tuple]:
    rows = []
    for g in r["segments"] or ():
        if not g["text"]:
            continue
        ts = tokens(g["text"])
        own = [("speaker", s, "") for s in anchors(ts)] + [("known_person", s, m) for s, m in names_in(ts, r["people"] or [])] + [("name_candidate", s, "") for s in name_candidates(ts)]
        rows += [(k, g["segment_id"], s, m) for k, s, m in own]
    first: dict[tuple, tuple] = {}
    for k, seg, s, m in rows:
        first.setdefault((k, seg, s.text.casefold(), m), (s, m))
    return [(r["record"], f"anchor_{i:03d}", k, seg, s.start, s.end, s.text, m) for i, ((k, seg, _, _), (s, m)) in enumerate(first.items(), 1)]


def _bundles(batches):
    return _rows(batches, _ANCHORED, _bundle)


def anchor_bundle(joined: DataFrame) -> DataFrame:
    """Numbered anchors of each record: first-person words, known people and candidate names, each once a segment."""
    ship(joined.sparkSession)
    return joined.select("record", "segments", "people").mapInArrow(_bundles, "record string, anchor_id string, kind string, segment_id string, start_char int, end_char int, surface string, mention_id string")


def name_variants(people: DataFrame) -> DataFrame:
    """(record, mention_id, variant_type, surface, norm): the name as it stands first, then its aliases, each normal form once."""
    from evigraph.functions.text import normalize

    own = people.select("record", "mention_id", F.posexplode(F.concat(F.array(F.struct(F.lit("primary").alias("t"), F.col("name").alias("s"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("explicit_alias").alias("t"), a.alias("s"))))).alias("pos", "x"))
    rows = own.select("record", "mention_id", "pos", F.col("x.t").alias("variant_type"), F.col("x.s").alias("surface"), normalize(F.col("x.s")).alias("norm")).where("norm <> ''")
    first = rows.groupBy("record", "mention_id", "norm").agg(F.min(F.struct("pos", "variant_type", "surface")).alias("m"))
    return first.select("record", "mention_id", "m.variant_type", "m.surface", "norm")
