"""Sentences of texts in any language and script, by maximum-entropy classification of candidate boundaries.

Candidates are clusters of end marks (every mark that Unicode calls a sentence terminal) with their closing quotes, line ends, and
white space between characters of scripts that use none. Each is classified by features of its neighbourhood: tokens on both
sides, their case, length, digits and script, the marks, the white space and whether a quotation is open. The classifier is logistic
regression over hashed features. It learns from reliable boundaries only, the ends of transcript segments: it predicts how often a
place like this is the end of a segment, and divides by how often a true boundary is one (learning from positive and unlabelled
cases). Line ends have weights of their own, learned from the same segments set one to a line, wrapped at a width, or both; what
tells a wrapped line from a finished one is mostly whether the next word would still have fitted. White space between Han or kana
is a boundary by itself, and in scripts like Thai where a text has no end mark at all.

Defined results: null texts give no sentence, nor do empty and blank ones; offsets count code points, the end is exclusive,
outer white space is left out; text after the last boundary is a sentence of its own; a case that was delivered twice gives
its sentences once; very long texts are read in one pass.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.runtime import bounded, ship

#: The bound of the fitted sample, of each table: transcripts, characters of one transcript, and characters of all.
SAMPLE_CASES, CASE_CHARS, SAMPLE_CHARS = 3_000, 40_000, 6_000_000
#: Transcripts of the sample whose line ends are fitted.
LINE_CASES = 300
DIMENSIONS = 1 << 18
#: A quotation that does not close within so many characters is not taken for one.
LONGEST_QUOTE = 400
#: Below and above these shares an unlabelled place counts as known in the later fits.
UNLIKELY, LIKELY = 0.2, 0.6

_MARKS = r"[\p{Sentence_Terminal}…]"
_CLOSERS = "\"'»”“’」』)）]＂"
_BARE = r"\p{Han}\p{Hiragana}\p{Katakana}"
#: Scripts that part phrases, not words, by white space.
_PHRASED = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_CANDIDATE = regex.compile(rf"(?P<mark>{_MARKS}+)(?P<close>[\"'»”’」』\)）\]＂“]*)(?P<space>\s*)|(?P<line>[^\S\n]*\n\s*)|(?P<gap>(?<=[{_BARE}ー”」』])[^\S\n]+(?=[{_BARE}“「『\d])|(?<=\d)[^\S\n]+(?=[{_BARE}“「『]))|(?P<phrase>(?<=[{_PHRASED}])[^\S\n]+(?=[{_PHRASED}]))")
_MARK = regex.compile(_MARKS)
_TOKEN = regex.compile(r"\p{Han}|[\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}]+|\d+|[^\s\p{L}\p{M}\d]")
_FIRST = regex.compile(r"\S+")
_PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "‹": "›"}


@dataclass
class Candidate:
    """A place where a sentence may end: ``end`` is after its closing marks, ``next`` where the following text begins."""

    end: int
    next: int
    sure: bool
    features: list[str]
    line: bool = False


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations that are opened and closed within one line and a bounded length."""
    out = []
    stack: list[tuple[str, int]] = []
    straight = -1
    for m in regex.finditer(r"[«»“”„「」『』‹›\"＂\n]", text):
        c, i = m.group(), m.start()
        if c == "\n":
            stack.clear()
            straight = -1
        elif c in "\"＂":
            if straight >= 0 and i - straight <= LONGEST_QUOTE:
                out.append((straight, i))
                straight = -1
            else:
                straight = i
        elif stack and c == stack[-1][0]:
            start = stack.pop()[1]
            if i - start <= LONGEST_QUOTE:
                out.append((start, i))
        elif c in _PAIRS:
            stack.append((_PAIRS[c], i))
    return sorted(out)


def _shape(token: str) -> str:
    if token.isdigit():
        return f"0{min(len(token), 4)}"
    if token[:1].isalpha():
        kind = "U" if token.isupper() and len(token) > 1 else "u" if token[0].isupper() else "l" if token[0].islower() else "o"
        return f"{kind}{min(len(token), 4)}"
    return token


def _script(token: str) -> str:
    c = token[:1]
    if not c.isalpha():
        return "0" if c.isdigit() else "-"
    o = ord(c)
    if o < 0x370:
        return "L"
    return "C" if 0x400 <= o < 0x530 else "D" if 0x900 <= o < 0x980 else "H" if 0x3040 <= o < 0xA000 else unicodedata.name(c, "x").split()[0].lower()


def _word(token: str) -> str:
    return "0" * min(len(token), 4) if token.isdigit() else token.lower()


def candidates(text: str) -> list[Candidate]:
    """All candidate boundaries of a text in order, the end of the text left out."""
    quotes = quotations(text)
    first = regex.search(r"\p{L}", text)
    style = "l" if first and first.group().islower() else "u"
    width, setting = _setting(text)
    unmarked = None
    out = []
    q = 0
    inside_until = -1
    for m in _CANDIDATE.finditer(text):
        start = m.start()
        while q < len(quotes) and quotes[q][0] < start:
            inside_until = max(inside_until, quotes[q][1])
            q += 1
        if m["mark"] is None:
            end, next_ = start, m.end()
            if next_ >= len(text) or not text[:end].strip():
                continue
            quoted = inside_until >= end
            if m["line"] is not None:
                out.append(Candidate(end, next_, False, _line_features(text, start, end, next_, "", quoted, style, width, setting), True))
                continue
            if m["phrase"] is not None and unmarked is None:
                unmarked = _MARK.search(text) is None
            out.append(Candidate(end, next_, inside_until < start and (m["phrase"] is None or bool(unmarked)), _features(text, start, start, next_, "_", "", m.group(), quoted, style)))
            continue
        mark, close = m["mark"], m["close"]
        end = m.end("close")
        # an opening mark of the next quotation is not a closing one
        while close and not any(b == end - 1 for _, b in quotes[max(0, q - 4) : q + 4]) and close[-1] not in ")）]":
            close = close[:-1]
            end -= 1
        next_ = end
        while next_ < len(text) and text[next_].isspace():
            next_ += 1
        if next_ >= len(text):
            continue
        quoted = inside_until >= end
        space = text[end:next_]
        if "\n" in space and _fits(text, end, next_, width):
            out.append(Candidate(end, next_, False, _line_features(text, start, end, next_, mark, quoted, style, width, setting), True))
        else:
            # where a line is full its end is a space like any other
            out.append(Candidate(end, next_, False, _features(text, start, end, next_, mark, close, space.replace("\n", " "), quoted, style)))
    return out


def _setting(text: str) -> tuple[int, str]:
    """The length of the longest line; how many lines, and what part of them, are too full for the word that follows, and whether
    any line begins in lower case.

    Nearly all lines of a wrapped text are full and many begin in lower case, but of a text with a sentence to a line only the
    longest few are full.
    """
    if "\n" not in text:
        return 0, ""
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    width = max(map(len, lines), default=0)
    full = sum(len(a) + 1 + len(_FIRST.match(b).group()) > width for a, b in pairwise(lines))
    return width, f"{min(full, 3)}{4 * full // max(len(lines) - 1, 1)}{any(x[0].islower() for x in lines[1:]):d}"


def _fits(text: str, end: int, next_: int, width: int) -> bool:
    """Whether the first word of the next line would still have had room in this one, were lines wrapped at ``width``."""
    word = _FIRST.match(text, next_)
    return text.find("\n", end, next_) != text.rfind("\n", end, next_) or end - text.rfind("\n", 0, end) + len(word.group() if word else "") <= width


def _line_features(text: str, start: int, end: int, next_: int, mark: str, quoted: bool, style: str, width: int, setting: str) -> list[str]:
    """Features of a line end; all begin with ^ and meet no other features."""
    before = _TOKEN.findall(text[max(0, start - 40) : start])[-1:]
    after = _TOKEN.findall(text[next_ : next_ + 40])[:2]
    b, n = (before[0] if before else ""), (after[0] if after else "")
    blank = text.count("\n", end, next_) > 1
    fits = "b" if blank else "f" if _fits(text, end, next_, width) else "w"
    kind = "m" if mark else "p" if b and not b[0].isalnum() else "t"
    shape, wide = _shape(n)[:1], min(width // 25, 6)
    filled = 4 * (end - text.rfind("\n", 0, end) - 1) // max(width, 1)
    return ["^" + x for x in (fits + setting, fits + setting + shape, fits + setting + kind + shape, setting[2:] + shape, fits + setting[2:] + shape, fits, "k" + kind, fits + kind, fits + shape, fits + shape + style, fits + str(wide), fits + str(wide) + shape, f"{fits}r{filled}", f"{fits}r{filled}{shape}", f"q{quoted}{fits}", "b" + _word(b) if kind == "p" else "", f"s{_script(b)}{fits}", f"{fits}{kind}{shape}{wide}")]


def _features(text: str, start: int, end: int, next_: int, mark: str, close: str, space: str, quoted: bool, style: str) -> list[str]:
    """``style`` is l where the text itself begins in lower case, as transcripts without capitals do."""
    before = _TOKEN.findall(text[max(0, start - 40) : start])[-2:]
    after = _TOKEN.findall(text[next_ : next_ + 40])[:4]
    words = [t for t in after if t[0].isalnum()]
    b1, b2 = (before[-1] if before else ""), (before[-2] if len(before) > 1 else "")
    lead = after[0] if after and not after[0][0].isalnum() else ""
    n1, n2 = (words[0] if words else ""), (words[1] if len(words) > 1 else "")
    kind = mark if len(mark) < 3 else mark[:1] + "+"
    gap = "n" if "\n" in space else "s" if space else "0"
    shape = _shape(n1)[:1]
    return [
        "m" + kind, "g" + gap, f"mg{kind}{gap}", "q" + str(quoted), f"c{close[:1]}{lead}", f"mc{kind}{close[:1]}{shape}", "l" + lead,
        "b" + _word(b1), f"b2{_shape(b2)} {_word(b1)}", "bs" + _shape(b1), f"bg{_word(b1)}{gap}", f"bc{_word(b1)}{shape}",
        "n" + _word(n1), f"n2{_shape(n1)} {_word(n2)}", "ns" + _shape(n1), f"sc{_script(b1)}{_script(n1)}",
        f"bsn{_shape(b1)}{shape}{gap}{kind}", f"ln{lead}{_word(n1)}", f"ls{lead}{shape}{kind}{close[:1]}", f"ii{_shape(b1)}{_shape(n1)}{gap}", f"t{_shape(b2)}{_shape(b1)}{_shape(n1)}",
        f"S{style}{shape}{gap}", f"S{style}{shape}{_word(b1)}", f"S{style}{_word(n1)}",
    ]


def _hashed(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIMENSIONS for f in features]


@dataclass
class BoundaryModel:
    weights: np.ndarray
    bias: float
    rate: float
    line_bias: float = 0.0

    def probabilities(self, found: list[Candidate]) -> np.ndarray:
        """How likely each candidate is a true boundary."""
        if not found:
            return np.zeros(0)
        line = np.array([c.line for c in found])
        out = np.zeros(len(found))
        for own, bias, rate in ((False, self.bias, self.rate), (True, self.line_bias, 1.0)):
            at = np.flatnonzero(line == own)
            if len(at):
                x = np.array([_hashed(found[i].features) for i in at.tolist()])
                out[at] = np.minimum(1 / (1 + np.exp(-(self.weights[x].sum(axis=1) + bias))) / rate, 1.0)
        return out


def _regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, l2: float = 3.0, step: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch adaptive gradient."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    g2, gb2 = np.full(DIMENSIONS, 1e-8), 1e-8
    flat = x.ravel()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(w[x].sum(axis=1) + bias)))
        d = (p - y) * weight
        g = np.bincount(flat, np.repeat(d, x.shape[1]), DIMENSIONS) + l2 * w
        g2 += g * g
        w -= step * g / np.sqrt(g2)
        gb = d.sum()
        gb2 += gb * gb
        bias -= step * gb / np.sqrt(gb2)
    return w, bias


def _joined(segments: list[str]) -> tuple[str, set[int]]:
    """The segments as one text, and where each but the first begins.

    Segments of scripts without spaces are joined without one, and so are some of the others: white space alone must not
    tell the end of a segment from any other end of a sentence.
    """
    text, begins = "", set()
    for s in segments:
        if text:
            bare = text[-1] in "。！？」』”" or zlib.crc32(s.encode("utf-8", "surrogatepass")) % 6 == 0
            text += "" if bare else " "
            begins.add(len(text))
        text += s.strip()
    return text, begins


def fit(segment_lists: list[list[str]], rounds: int = 60) -> BoundaryModel:
    """Learn from transcripts given as lists of segments; only the ends of segments are taken for known boundaries."""
    rows: list[list[str]] = []
    known: list[int] = []
    for segments in segment_lists:
        text, begins = _joined([s for s in segments if s and s.strip()])
        for c in candidates(text):
            if not c.line:
                rows.append(c.features)
                known.append(int(c.next in begins))
    if not rows or not any(known):
        return BoundaryModel(np.zeros(DIMENSIONS), 10.0, 1.0, 10.0)
    w_line, line_bias = _fit_lines(segment_lists[:: max(1, len(segment_lists) // LINE_CASES)][:LINE_CASES], rounds)
    x, y = np.array([_hashed(r) for r in rows]), np.array(known, dtype=np.float64)
    w, bias = _regress(x, y, np.ones(len(y)), rounds)
    p = 1 / (1 + np.exp(-(w[x].sum(axis=1) + bias)))
    share = np.minimum(p / np.median(p[y == 1]), 1.0)
    for _ in range(2):
        # fitted again on the known ends and on those places that the fit before is sure about
        sure = (y == 1) | (share < UNLIKELY) | (share > LIKELY)
        target = np.where((y == 1) | (share > (UNLIKELY + LIKELY) / 2), 1.0, 0.0)
        w, bias = _regress(x[sure], target[sure], np.ones(int(sure.sum())), rounds)
        share = 1 / (1 + np.exp(-(w[x].sum(axis=1) + bias)))
    return BoundaryModel(w + w_line, float(bias), 1.0, line_bias)


def _wrapped(text: str, width: int) -> str:
    """A text with line ends in place of the spaces at which its lines are full."""
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return "\n".join([*lines, line])


def _broken(text: str) -> str:
    """A text with line ends in place of some spaces, wherever the hash of the word after them says so."""
    first, *rest = text.split()
    return first + "".join(("\n" if zlib.crc32(w.encode("utf-8", "surrogatepass")) % 6 == 0 else " ") + w for w in rest)


def _set_in_lines(segments: list[str]) -> Iterator[tuple[str, set[int]]]:
    """Texts whose line ends are known, and where a segment begins in them: one segment to a line with its marks or without, the
    whole text wrapped or broken anywhere, and wrapped segments."""
    seed = zlib.crc32("".join(segments).encode("utf-8", "surrogatepass"))
    width = 30 + seed % 71
    bare = [s.rstrip(".!?…।。！？ ") or s for s in segments]
    sets = [("\n", segments), ("\n", bare), ("\n\n" if seed % 3 == 0 else "\n", [_wrapped(s, width) for s in bare]), (" ", segments)]
    for joint, parts in sets:
        text, begins = "", set()
        for s in parts:
            if text:
                text += joint
                begins.add(len(text))
            text += s
        if joint == " ":
            # now and then lines are broken anywhere
            text, begins = _wrapped(text, width) if seed % 5 else _broken(text), set()
        yield (text.lower() if seed % 4 == 0 else text), begins


def _fit_lines(segment_lists: list[list[str]], rounds: int) -> tuple[np.ndarray, float]:
    """Weights of line ends. A line end after a mark inside a segment is not known and left out."""
    rows: list[list[str]] = []
    known: list[int] = []
    for segments in segment_lists:
        own = [" ".join(s.split()) for s in segments if s and s.strip()]
        if len(own) > 1:
            for text, begins in _set_in_lines(own):
                for c in candidates(text):
                    if c.line and (c.next in begins or "^km" not in c.features):
                        rows.append(c.features)
                        known.append(int(c.next in begins))
    if not any(known):
        return np.zeros(DIMENSIONS), 10.0
    return _regress(np.array([_hashed(r) for r in rows]), np.array(known, dtype=np.float64), np.ones(len(known)), rounds)


def split(text: str, model: BoundaryModel) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text."""
    found = candidates(text)
    p = model.probabilities(found)
    out, at = [], 0
    for c, s in zip(found, p.tolist(), strict=True):
        if c.sure or s >= 0.5:
            out.append((at, c.end))
            at = c.next
    out.append((at, len(text)))
    return [(a, b) for a, b in (_trim(text, a, b) for a, b in out) if a < b]


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


SENTENCES = "case_id string, field string, start_char int, end_char int"
_ARROW = pa.schema([("case_id", pa.string()), ("field", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())])


def _cut(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, f, s, e) for k, f, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for s, e in split(t or "", model.value)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def training_sample(cases: DataFrame, key: str, segments: str, most: int = SAMPLE_CASES, chars: int = SAMPLE_CHARS) -> list[list[str]]:
    """The segments of at most ``most`` transcripts and ``chars`` characters, chosen by the hash of their key."""
    size = F.aggregate("s", F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))
    rows = cases.select(F.col(key).alias("k"), F.col(segments).alias("s")).select("k", "s", size.alias("n"), F.xxhash64("k").alias("h")).where(F.col("n") < CASE_CHARS)
    rows = bounded(rows, cases.count(), most).orderBy("h", "k").limit(most)
    # the sample is bounded, so its running total may be worked out in one task
    so_far = Window.orderBy("h", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return [list(r["s"]) for r in rows.withColumn("n", F.sum("n").over(so_far)).where(F.col("n") <= chars).select("s").collect()]


def sentences(texts: DataFrame, model) -> DataFrame:
    """(case_id, field, start_char, end_char) of (case_id, field, text) rows; ``model`` is a broadcast one."""
    ship(texts.sparkSession)
    return texts.where(F.col("text").isNotNull()).select("case_id", "field", "text").mapInArrow(partial(_cut, model=model), SENTENCES)


def project_sentences(read) -> DataFrame:
    """Sentences of both texts of every end-to-end case; ``read(table)`` gives a table."""
    cases = read("e2e_cases")
    model = fit(training_sample(cases, "case_id", "request.transcript.segments.text") + training_sample(read("benchmark_cases"), "case_id", "transcript.segments.text"))
    fields = F.array(F.struct(F.lit("full_text").alias("field"), F.col("request.transcript.full_text").alias("text")), F.struct(F.lit("reference_text").alias("field"), F.col("reference_text").alias("text")))
    texts = cases.select("case_id", F.explode(fields).alias("f")).select("case_id", "f.field", "f.text").distinct()
    return sentences(texts, cases.sparkSession.sparkContext.broadcast(model))

