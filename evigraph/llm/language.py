"""Language of texts and of their pieces, with a confidence, by word-first backoff.

Words are taken in their one form (look-alike letters and widths undone). A known word scores by its log frequency in each
language, an unknown one by its longest known character n-grams, from five letters down to one. The tables
are fitted on a bounded sample of labelled documents; wrong labels in it are found by scoring the sample with its own
tables and are left out in a second fit. A tenth of the sample is held out to fit how sharp the posteriors are and how well the words
of a language are usually covered by its tables. Pieces that change their language are cut where they do, by the cheapest sequence
of languages over their words.

Defined results: null, empty and blank texts have no piece; a piece without letters has a null language and confidence 0;
the confidence is the posterior of the best language under equal priors, tempered by the number of words, times how well the piece is
covered by that language against what is usual, so that a text in none of the languages has a low one; equal scores go to
the first code in order; repeated rows count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.lookalike import transducer
from evigraph.runtime import ship

#: The bound of the fitted sample: so many labelled documents, none longer than so many characters.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 4_000, 20_000
#: Words and n-grams kept for each language; bounds the broadcast model.
WORDS_KEPT, GRAMS_KEPT = 40_000, 30_000
LONGEST_GRAM = 5
#: Evidence of one word is cut at this many nats, so that no single word decides a long text.
MOST = 7.0
#: Weight of the n-grams of an unknown word against a known word.
UNKNOWN = 0.5
#: How far a word is covered by a known word (0) or by n-grams of so many letters, where the language is not far behind the best one.
COVERS, BEHIND = {0: 1.0, 5: 0.6, 4: 0.4, 3: 0.1}, 2.0
#: Nats that a change of language within a piece costs, and the words of the windows that tell where to look for one.
SWITCH, WINDOW = 12.0, 8

_WORD = regex.compile(r"(?V1)\p{Han}|[\p{Hiragana}\p{Katakana}ー]+|(?<![\d+/=_])[[\p{L}\p{M}]--\p{Han}--\p{Hiragana}--\p{Katakana}]++(?![\d+/=_])")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class LanguageModel:
    codes: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray
    sharpness: float = 1.0
    usual: float = 0.0

    def score_word(self, word: str) -> np.ndarray:
        """The scores of a word by language, and then how far each language covers it."""
        word = transducer().apply(word)
        i = self.words.get(word)
        if i is not None:
            return self._covered(self.word_scores[i], 0)
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            hit = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if hit:
                return self._covered(UNKNOWN * self.gram_scores[hit].mean(axis=0), n)
        return np.zeros(2 * len(self.codes), np.float32)

    def _covered(self, scores: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([scores, np.where(scores >= scores.max() - BEHIND, COVERS.get(n, 0.0), 0.0)]).astype(np.float32)


def _table(counts: dict[str, Counter], codes: list[str], keep: int, joint: bool) -> tuple[dict[str, int], np.ndarray]:
    """Numbered keys and their centred log frequencies, one column a language.

    ``joint`` leaves out the size of the languages: while labels are still wrong, a few strays would weigh more in a small
    language than the many right cases in a large one.
    """
    kept = sorted({k for c in codes for k, _ in counts[c].most_common(keep)})
    number = {k: i for i, k in enumerate(kept)}
    n = np.array([[counts[c][k] for c in codes] for k in kept], dtype=np.float64).reshape(len(kept), len(codes))
    total = n.sum(axis=0)
    share = np.log(n + 0.02) if joint else np.log((n + 0.02) / (total + 0.02 * len(kept) + 1))
    share -= share.max(axis=1, keepdims=True)
    return number, np.maximum(share, -MOST).astype(np.float32)


def fit(words: dict[str, Counter], codes: list[str], joint: bool = False) -> LanguageModel:
    """Tables of word counts by language."""
    # a language with few texts must not lose its rare words to noise of a large one
    grams: dict[str, Counter] = {c: Counter() for c in codes}
    for c in codes:
        for w, n in words[c].items():
            if n > 1 or len(words[c]) < WORDS_KEPT:
                for k in range(1, LONGEST_GRAM + 1):
                    for g in grams_of(w, k):
                        grams[c][g] += min(n, 8)
    word_numbers, word_scores = _table(words, codes, WORDS_KEPT, joint)
    grams_by_length = [({g for c in codes for g in grams[c] if len(g) == k}) for k in range(1, LONGEST_GRAM + 1)]
    gram_numbers: dict[str, int] = {}
    parts = []
    for k in range(LONGEST_GRAM):
        own = {c: Counter({g: n for g, n in grams[c].items() if g in grams_by_length[k]}) for c in codes}
        numbers, scores = _table(own, codes, GRAMS_KEPT, joint)
        gram_numbers |= {g: i + len(gram_numbers) for g, i in numbers.items()}
        parts.append(scores)
    return LanguageModel(codes, word_numbers, gram_numbers, word_scores, np.concatenate(parts))


def fit_labelled(texts: list[tuple[str, str]], codes: list[str]) -> LanguageModel:
    """Fit on (label, text), score the pieces of the sample with the result, and fit again on the languages they show.

    A piece moves to another language only where that is clear; doubtful pieces are left out of the second fit.
    """
    labels = [label for label, text in texts for p in text.split("\n\n") if p.strip()]
    pieces = [words_of(p) for _, text in texts for p in text.split("\n\n") if p.strip()]
    for _ in range(2):
        totals = Scorer(fit(_counts(labels, pieces, codes), codes, joint=True)).totals(pieces)[:, : len(codes)]
        best = totals.argmax(axis=1)
        lead = np.partition(totals, -1)[:, -1] - np.partition(totals, -2)[:, -2] if len(codes) > 1 else np.full(len(best), 2 * MOST)
        shown = [codes[i] for i in best.tolist()]
        keep = [i for i, (label, lang, by) in enumerate(zip(labels, shown, lead.tolist(), strict=True)) if pieces[i] and (lang == label or by > MOST)]
        labels, pieces = [shown[i] for i in keep], [pieces[i] for i in keep]
    held = [i % 10 == 9 for i in range(len(pieces))]
    pick = lambda rows, out: [r for r, h in zip(rows, held, strict=True) if h == out]
    trial = fit(_counts(pick(labels, False), pick(pieces, False), codes), codes)
    model = fit(_counts(labels, pieces, codes), codes)
    model.sharpness, model.usual = _calibrated(trial, pick(labels, True), pick(pieces, True))
    return model


def _calibrated(model: LanguageModel, labels: list[str], pieces: list[list[str]]) -> tuple[float, float]:
    """The factor of the scores under which the held-out labels are likeliest, and the coverage that 99 of 100 pieces reach."""
    if not pieces:
        return 1.0, 0.0
    totals, n = Scorer(model).totals(pieces), np.array([len(p) for p in pieces])
    truth = np.array([model.codes.index(c) for c in labels])
    losses = []
    for k in (0.25, 0.5, 1.0, 2.0):
        p = _posteriors(totals[:, : len(model.codes)], n, k)[np.arange(len(truth)), truth]
        losses.append((-np.log(np.maximum(p, 1e-6)).sum(), k))
    long = n >= 4
    cover = totals[np.arange(len(truth)), len(model.codes) + truth] / np.maximum(n, 1)
    return min(losses)[1], float(np.quantile(cover[long], 0.01)) if long.any() else 0.0


def reliability(model: LanguageModel, labels: list[str], pieces: list[str]) -> list[tuple[float, int, float, float]]:
    """(lower bound of the confidence, pieces, mean confidence, share that is right) of labelled pieces, for reports."""
    totals, n = Scorer(model).score(pieces)
    langs, confidence = decide(totals, n, model)
    right = np.array([a == b for a, b in zip(langs, labels, strict=True)])
    out = []
    for low, high in pairwise((0.0, 0.5, 0.8, 0.9, 0.99, 1.01)):
        at = (confidence >= low) & (confidence < high)
        if at.any():
            out.append((low, int(at.sum()), float(confidence[at].mean()), float(right[at].mean())))
    return out


def _counts(labels: list[str], pieces: list[list[str]], codes: list[str]) -> dict[str, Counter]:
    words: dict[str, Counter] = {c: Counter() for c in codes}
    for label, piece in zip(labels, pieces, strict=True):
        words[label].update(piece)
    apply = transducer().apply
    out: dict[str, Counter] = {c: Counter() for c in codes}
    for c in codes:
        for w, n in words[c].items():
            out[c][apply(w)] += n
    return out


class Scorer:
    """Scores whole batches; the scores of each distinct word are worked out once in a task."""

    def __init__(self, model: LanguageModel, keep: int = 300_000) -> None:
        self.model, self.keep = model, keep
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, 2 * len(self.model.codes)), np.float32)

    def _numbers(self, lists: list[list[str]]) -> np.ndarray:
        new = set().union(*lists) - self.number.keys() if lists else set()
        if new and len(self.number) + len(new) > self.keep:
            self._reset()
            new = set().union(*lists)
        for w in sorted(new):
            i = len(self.number)
            if i == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.number[w] = i
            self.rows[i] = self.model.score_word(w)
        get = self.number.__getitem__
        n = sum(map(len, lists))
        return np.fromiter((i for ws in lists for i in map(get, ws)), np.int32, n)

    def totals(self, lists: list[list[str]]) -> np.ndarray:
        """The summed scores and coverage of each list of words by language."""
        numbers = self._numbers(lists)
        rows = self.rows[numbers]
        n = np.array([len(x) for x in lists], np.int64)
        begin = np.cumsum(n) - n
        out = np.zeros((len(lists), 2 * len(self.model.codes)))
        if len(rows):
            out[n > 0] = np.add.reduceat(rows, begin[n > 0], axis=0)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(totals and coverage of each text by language, number of words)."""
        lists = [words_of(t) for t in texts]
        return self.totals(lists), np.array([len(x) for x in lists], np.int64)


def _posteriors(totals: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    scaled = sharpness * totals / np.sqrt(np.maximum(n, 1))[:, None]
    p = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def decide(totals: np.ndarray, n: np.ndarray, model: LanguageModel) -> tuple[list[str | None], np.ndarray]:
    """The best language of each row and its confidence."""
    if not len(totals):
        return [], np.zeros(0)
    k = len(model.codes)
    p = _posteriors(totals[:, :k], n, model.sharpness)
    best = totals[:, :k].argmax(axis=1)
    at = np.arange(len(p))
    cover = np.minimum(1.0, totals[at, k + best] / np.maximum(n, 1) / model.usual) ** 2 if model.usual else 1.0
    return [model.codes[b] if m else None for b, m in zip(best, n, strict=True)], np.where(n > 0, p[at, best] * cover, 0.0)


def segments(text: str, scorer: Scorer) -> list[tuple[int, int, int]]:
    """(start, end, number of the language) of the parts of a piece by the cheapest sequence of languages over its words.

    A change costs ``SWITCH``; a part ends before the first word of the next one. Texts without words have no part.
    """
    found = [m.span() for m in _WORD.finditer(text)]
    if not found:
        return []
    numbers = scorer._numbers([[text[a:b].lower() for a, b in found]])
    scores = -scorer.rows[numbers][:, : len(scorer.model.codes)]
    best, back = scores[0], []
    for row in scores[1:]:
        least = int(best.argmin())
        change = best[least] + SWITCH < best
        back.append(np.where(change, least, np.arange(len(best))))
        best = np.where(change, best[least] + SWITCH, best) + row
    path = [int(best.argmin())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    path.reverse()
    cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1])]
    begins = [0, *(found[i][0] for i in cuts[1:])]
    return [(a, b, path[i]) for a, b, i in zip(begins, [*begins[1:], len(text)], cuts, strict=True)]


def changes(lists: list[list[str]], scorer: Scorer) -> list[bool]:
    """Whether some ``WINDOW`` words of a list clearly speak for another language than the whole; only such pieces can be cut."""
    k = len(scorer.model.codes)
    out = []
    for words in lists:
        numbers = scorer._numbers([words])
        rows = scorer.rows[numbers][:, :k]
        if len(rows) < 2:
            out.append(False)
            continue
        total = np.cumsum(np.concatenate([np.zeros((1, k), np.float32), rows]), axis=0)
        w = min(WINDOW, len(rows) - 1)
        part = total[w:] - total[:-w]
        whole = int(total[-1].argmax())
        out.append(bool((part.max(axis=1) - part[:, whole]).max() > SWITCH / 2))
    return out


PIECES = "source string, record_id string, piece int, lang string, confidence double, n_words int"
_ARROW = pa.schema([("source", pa.string()), ("record_id", pa.string()), ("piece", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32())])


def _slices(texts: list[str], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    a = n = 0
    for i, t in enumerate(texts):
        if i > a and n + len(t) > limit:
            yield a, i
            a = i
            n = 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def _label(batches: Iterator[pa.RecordBatch], model, source: str) -> Iterator[pa.RecordBatch]:
    """Rows (record_id, pieces array) to one row a piece that has any text."""
    scorer = Scorer(model.value)
    for b in batches:
        ids, numbers, texts = [], [], []
        for rid, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k, t in enumerate(pieces or (), 1):
                if t and not t.isspace():
                    ids.append(rid)
                    numbers.append(k)
                    texts.append(t)
        for i, j in _slices(texts):
            totals, n = scorer.score(texts[i:j])
            langs, confidence = decide(totals, n, model.value)
            yield pa.RecordBatch.from_arrays([pa.array([source] * (j - i)), pa.array(ids[i:j], pa.string()), pa.array(numbers[i:j], pa.int32()), pa.array(langs, pa.string()), pa.array(confidence), pa.array(n, pa.int32())], schema=_ARROW)


SEGMENTS = "source string, record_id string, piece int, segment int, start_char int, end_char int, lang string, confidence double"
_SEGMENTS = pa.schema([("source", pa.string()), ("record_id", pa.string()), ("piece", pa.int32()), ("segment", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def _cut(batches: Iterator[pa.RecordBatch], model, source: str) -> Iterator[pa.RecordBatch]:
    """Rows (record_id, pieces array) to one row for each part of a piece that is in one language."""
    scorer = Scorer(model.value)
    for b in batches:
        flat = [(rid, k, t) for rid, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, t in enumerate(pieces or (), 1) if t and not t.isspace()]
        for i, j in _slices([t for _, _, t in flat]):
            part = flat[i:j]
            mixed = changes([words_of(t) for _, _, t in part], scorer)
            spans = [(rid, k, n, a, z, t[a:z]) for (rid, k, t), m in zip(part, mixed, strict=True) for n, (a, z, _) in enumerate(segments(t, scorer) if m else [(0, len(t), 0)], 1)]
            totals, n = scorer.score([x[5] for x in spans])
            langs, confidence = decide(totals, n, model.value)
            ids, numbers, order, starts, ends, _ = zip(*spans, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(spans)), *(pa.array(c, t) for c, t in ((ids, pa.string()), (numbers, pa.int32()), (order, pa.int32()), (starts, pa.int32()), (ends, pa.int32()), (langs, pa.string()))), pa.array(confidence)], schema=_SEGMENTS)


def training_sample(documents: DataFrame, codes: list[str], most: int = SAMPLE_DOCUMENTS) -> list[tuple[str, str]]:
    """At most ``most`` labelled documents of bounded length, chosen by the hash of their id.

    Ids are chosen first, over the columns id, label and length alone; only the texts of those are read then.
    """
    labelled = documents.where(F.col("lang").isin(codes) & (F.col("n_chars") <= SAMPLE_CHARS)).select("doc_id", F.xxhash64("doc_id").alias("h"))
    ids = [r["doc_id"] for r in labelled.orderBy("h", "doc_id").limit(most).collect()]
    chosen = documents.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    rows = documents.join(F.broadcast(chosen), documents["doc_id"] == chosen["id"], "left_semi").where(F.col("lang").isin(codes) & (F.length("text") <= SAMPLE_CHARS))
    return [(r["lang"], r["text"]) for r in rows.select("lang", "text", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(most).collect()]


def label_pieces(df: DataFrame, source: str, record_id: str, pieces: str, model) -> DataFrame:
    """One row a piece of each record. ``pieces``: a column with an array of texts; ``model``: a broadcast model."""
    ship(df.sparkSession)
    return df.select(F.col(record_id).cast("string").alias("record_id"), F.col(pieces).alias("pieces")).mapInArrow(partial(_label, model=model, source=source), PIECES)


def _project(read, codes: list[str], most: int) -> tuple:
    """(a broadcast model, the cases, the documents), the last two as record ids with arrays of pieces."""
    documents = read("documents")
    model = documents.sparkSession.sparkContext.broadcast(fit_labelled(training_sample(documents, codes, most), codes))
    paragraphs = documents.select("doc_id", F.split("text", "\n\n").alias("pieces"))
    cases = read("benchmark_cases").select("case_id", F.col("transcript.segments.text").alias("pieces")).distinct()
    return model, cases, paragraphs


def project_pieces(read, codes: list[str], most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Every segment of every transcript and every paragraph of every document with its language; ``read(table)`` gives a table."""
    model, cases, paragraphs = _project(read, codes, most)
    return label_pieces(cases, "benchmark_cases", "case_id", "pieces", model).unionByName(label_pieces(paragraphs, "documents", "doc_id", "pieces", model))


def project_segments(read, codes: list[str], most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Every part of a segment or paragraph that is in one language."""
    model, cases, paragraphs = _project(read, codes, most)
    part = lambda df, source, key: df.select(F.col(key).cast("string").alias("record_id"), "pieces").mapInArrow(partial(_cut, model=model, source=source), SEGMENTS)
    return part(cases, "benchmark_cases", "case_id").unionByName(part(paragraphs, "documents", "doc_id"))


def record_labels(read, codes: list[str]) -> DataFrame:
    """(source, record_id, named): the languages that each record's label names."""
    hint = F.transform(F.coalesce("transcript.language_hints", F.array().cast("array<string>")), lambda h: F.lower(F.substring_index(h, "-", 1)))
    known = F.array(*map(F.lit, codes))
    cases = read("benchmark_cases").select(F.lit("benchmark_cases").alias("source"), F.col("case_id").alias("record_id"), F.array_intersect(hint, known).alias("named")).distinct()
    docs = read("documents").select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("record_id"), F.when(F.col("lang").isin(codes), F.array("lang")).otherwise(F.array().cast("array<string>")).alias("named"))
    return cases.unionByName(docs)


def mislabelled(pieces: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, record_id, piece, lang) of pieces whose language their record's label does not name."""
    rows = pieces.where("lang is not null").join(labels, ["source", "record_id"])
    return rows.where(~F.array_contains("named", F.col("lang"))).select("source", "record_id", "piece", "lang").distinct()


def by_record(pieces: DataFrame) -> DataFrame:
    """(source, record_id, lang, confidence, n_pieces, n_languages): the language with most words of each record."""
    per = pieces.where("lang is not null").groupBy("source", "record_id", "lang").agg(F.sum("n_words").alias("w"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"), F.count("*").alias("p"))
    out = per.groupBy("source", "record_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "lang", "c")).alias("m"), F.sum("w").alias("words"), F.sum("p").alias("n_pieces"), F.count("*").alias("n_languages"))
    return out.select("source", "record_id", "m.lang", (F.col("m.c") / F.col("words")).alias("confidence"), "n_pieces", "n_languages")
