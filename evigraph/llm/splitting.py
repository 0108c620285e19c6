"""Cutting oversized texts at natural boundaries by recursive bisection, with overlaps.

A text over the limit is cut at the strongest boundary near its midpoint (paragraph, line, sentence, clause, word, then any
character), and each half that still exceeds the limit together with its overlap is cut again. The tree of cuts does not
depend on the limit, so all budgets share one tree and each takes the nodes that fit first. Overlaps are attached last.

Defined results: a text within the limit gives no row; null and empty texts give no row; a piece's ``start_token`` ..
``end_token`` are places in the document's own ids and it begins with ``shared_tokens`` of the piece before it; this is the
budget's overlap, or up to three tokens more where that place is inside a character, or less where the text of the piece
alone would need more tokens than the limit; no piece, alone or as a slice, exceeds the limit, but for a single character that
has more tokens than it. A budget without a positive limit gives no row; an overlap that is not smaller than its limit counts
as half of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evigraph.llm import bpe
from evigraph.llm.bpe import Encoder
from evigraph.llm.encode import chunks
from evigraph.runtime import ship

PIECES = "doc_id bigint, budget_id string, piece int, start_char int, end_char int, start_token bigint, end_token bigint, n_tokens int, shared_tokens int, boundary int, text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("budget_id", pa.string()), ("piece", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("n_tokens", pa.int32()), ("shared_tokens", pa.int32()), ("boundary", pa.int32()), ("text", pa.string())])


def _strength() -> np.ndarray:
    """[how the word before ends, white space before the next word] -> class of the boundary between them."""
    t = np.zeros((6, 2), np.int8)
    t[:, 1] = bpe.WORD
    t[bpe.SPACED_CLAUSE, 1] = bpe.CLAUSE
    t[bpe.SPACED_SENTENCE, 1] = bpe.SENTENCE
    t[bpe.FULL_CLAUSE, :] = bpe.CLAUSE
    t[bpe.FULL_SENTENCE, :] = bpe.SENTENCE
    t[bpe.LINE_END, :] = bpe.LINE
    return t


STRENGTH = _strength()


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi] one after the other, and where each range begins."""
    n = hi - lo + 1
    at = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(at - lo, n), at


class Bisection:
    """The units of a chunk of texts: words, and the characters of words that are too long to be kept whole."""

    def __init__(self, encoder: Encoder, texts: list[str], most: int) -> None:
        numbers = encoder.numbers(texts)
        words = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        ends, spaced = encoder.ends[words], encoder.spaced[words]
        size = encoder.sizes[words]
        strength = np.zeros(len(words), np.int8)
        strength[1:] = STRENGTH[ends[:-1], spaced[1:].astype(np.int8)]
        line = ends == bpe.LINE_END
        strength[1:][line[:-1] & line[1:]] = bpe.INSIDE
        strength[2:][line[:-2] & line[1:-1] & ~line[2:]] = bpe.PARAGRAPH
        ids = encoder.flat(words)
        self.encoder, self.texts, self.ids = encoder, texts, ids
        self.starts = np.append(encoder.starts_char[ids], True)
        self.chars = np.concatenate([[0], np.cumsum(encoder.chars[ids])])
        self.bytes = np.concatenate([[0], np.cumsum(encoder.bytes[ids])])
        self.start_before = np.maximum.accumulate(np.where(self.starts, np.arange(len(self.starts)), 0))
        self.word_at = word_at = np.concatenate([[0], np.cumsum(size)])
        self.word_start = np.zeros(len(ids) + 1, bool)
        self.word_start[word_at] = True
        # a unit begins at every word and, inside long words, at every character
        big = np.repeat(size > most, size)
        begins = self.word_start[:-1] | (big & self.starts[:-1])
        at = np.flatnonzero(begins)
        self.tokens = np.append(at, len(ids))
        level = np.zeros(len(ids), np.int8)
        level[word_at[:-1][size > 0]] = strength[size > 0]
        self.strength = level[at]
        unit_doc = np.repeat(doc, size)[at]
        self.first = np.searchsorted(unit_doc, np.arange(len(texts)), "left")
        self.last = np.searchsorted(unit_doc, np.arange(len(texts)), "right")
        self.doc_token = self.tokens[self.first]

    def cuts(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each range of at least two units: the strongest boundary in the middle half, the nearest to the middle."""
        t = self.tokens
        a, b = t[lo], t[hi]
        left = np.clip(np.searchsorted(t, a + (b - a) / 4, "left"), lo + 1, hi - 1)
        right = np.clip(np.searchsorted(t, b - (b - a) / 4, "right") - 1, lo + 1, hi - 1)
        middle = np.clip(np.searchsorted(t, (a + b) / 2, "left"), lo + 1, hi - 1)
        none = left > right
        left[none] = right[none] = middle[none]
        at, begin = _spans(left, right)
        n = right - left + 1
        key = (self.strength[at].astype(np.int64) << 40) - np.abs(2 * t[at] - np.repeat(a + b, n))
        best = np.maximum.reduceat(key, begin)
        hit = np.flatnonzero(key == np.repeat(best, n))
        owner = np.repeat(np.arange(len(lo)), n)[hit]
        return at[hit[np.unique(owner, return_index=True)[1]]]

    def shared_from(self, cut: np.ndarray, first: np.ndarray, overlap: int) -> np.ndarray:
        """The token at which a piece that begins at token ``cut`` starts with its overlap."""
        return np.where(cut == first, cut, self.start_before[np.maximum(cut - overlap, first)])

    def alone(self, doc: int, a: int, b: int) -> int:
        """Tokens of the text of [a, b) when it is encoded by itself."""
        if self.word_start[a]:
            return b - a
        end = a + 1
        while end < b and not self.word_start[end]:
            end += 1
        base = self.chars[self.doc_token[doc]]
        part = self.texts[doc][self.chars[a] - base : self.chars[end] - base]
        return len(self._part(part)) + b - end

    def _part(self, part: str) -> list[int]:
        known = self.encoder.parts
        if part not in known:
            if len(known) > 200_000:
                known.clear()
            known[part] = [i for ids in bpe.merge_words([w.encode("utf-8", "surrogatepass") for w in self.encoder.find(part)], self.encoder.vocabulary) for i in ids]
        return known[part]

    def leaves(self, budgets: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(budget number, doc, lo, hi) arrays of the pieces, in rounds; lo and hi are units."""
        doc = np.flatnonzero(self.last > self.first)
        lo, hi = self.first[doc], self.last[doc]
        open_ = np.ones((len(doc), len(budgets)), bool)
        for k, (_, limit, _) in enumerate(budgets):
            open_[:, k] = self.tokens[hi] - self.tokens[lo] > limit
        keep = open_.any(axis=1)
        doc, lo, hi, open_ = doc[keep], lo[keep], hi[keep], open_[keep]
        while len(doc):
            single = hi - lo < 2
            if single.any():
                # a unit that cannot be halved any more is a piece; its overlap is cut to what fits
                for k in range(len(budgets)):
                    left = open_[:, k] & single
                    if left.any():
                        yield k, doc[left], lo[left], hi[left]
                doc, lo, hi, open_ = doc[~single], lo[~single], hi[~single], open_[~single]
                continue
            cut = self.cuts(lo, hi)
            doc, lo, hi, open_ = np.repeat(doc, 2), np.repeat(lo, 2), np.repeat(hi, 2), np.repeat(open_, 2, axis=0)
            lo[1::2], hi[::2] = cut, cut
            for k, (_, limit, overlap) in enumerate(budgets):
                start = self.shared_from(self.tokens[lo], self.doc_token[doc], overlap)
                fits = open_[:, k] & (self.tokens[hi] - start <= limit)
                if fits.any():
                    yield k, doc[fits], lo[fits], hi[fits]
                    open_[:, k] &= ~fits
            keep = open_.any(axis=1)
            doc, lo, hi, open_ = doc[keep], lo[keep], hi[keep], open_[keep]


def split_chunk(encoder: Encoder, keys: list, texts: list[str], budgets: list[tuple]) -> Iterator[pa.RecordBatch]:
    most = max(1, min(16, *(max(1, (limit - overlap) // 4) for _, limit, overlap in budgets))) if budgets else 1
    tree = Bisection(encoder, texts, most)
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in budgets]
    for k, *arrays in tree.leaves(budgets):
        found[k].append(tuple(arrays))
    key_of = pa.array(keys, pa.int64())
    for k, (budget, limit, overlap) in enumerate(budgets):
        if not found[k]:
            continue
        doc, lo, hi = (np.concatenate(x) for x in zip(*found[k], strict=True))
        order = np.lexsort((lo, doc))
        doc, lo, hi = doc[order], lo[order], hi[order]
        cut, end = tree.tokens[lo], tree.tokens[hi]
        start = tree.shared_from(cut, tree.doc_token[doc], overlap)
        # a word that is cut has no more tokens by itself than bytes; only pieces that this could take over the limit are looked at
        word_end = tree.word_at[np.searchsorted(tree.word_at, start)]
        most_alone = end - np.minimum(word_end, end) + tree.bytes[np.minimum(word_end, end)] - tree.bytes[start]
        for i in np.flatnonzero(most_alone > limit).tolist():
            while start[i] < cut[i] and tree.alone(int(doc[i]), int(start[i]), int(end[i])) > limit:
                start[i] += 1
                while not tree.starts[start[i]]:
                    start[i] += 1
        new = np.concatenate([[True], doc[1:] != doc[:-1]])
        number = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) + 1
        base_char, base = tree.chars[tree.doc_token[doc]], tree.doc_token[doc]
        a, b = tree.chars[start] - base_char, tree.chars[end] - base_char
        body = [texts[d][x:y] for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True)]
        level = np.where(new, bpe.PARAGRAPH + 1, tree.strength[lo])
        numbers = [pa.array(c.astype(np.int64), f.type, safe=False) for c, f in zip((number, a, b, start - base, end - base, end - start, cut - start, level), list(_ARROW)[2:10], strict=True)]
        whole = pa.RecordBatch.from_arrays([key_of.take(pa.array(doc)), pa.repeat(budget, len(doc)), *numbers, pa.array(body, pa.string())], schema=_ARROW)
        for i in range(0, len(doc), 20_000):
            yield whole.slice(i, 20_000)


def _split(batches: Iterator[pa.RecordBatch], budgets: list[tuple], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for keys, texts in chunks(batches):
        yield from split_chunk(encoder, keys, texts, budgets)


def split_documents(df: DataFrame, budgets: list[tuple], path: str = "") -> DataFrame:
    """The pieces of every text of ``df`` (doc_id, text) that exceeds a budget, for each (budget_id, max_tokens, overlap_tokens)."""
    ship(df.sparkSession)
    usable = [(b, limit, max(0, min(overlap or 0, (limit - 1) // 2 if (overlap or 0) >= limit else overlap or 0))) for b, limit, overlap in budgets if limit and limit > 0]
    return df.select("doc_id", "text").mapInArrow(partial(_split, budgets=usable, path=path), PIECES)
