"""Byte-level BPE over whole partitions by a pair occurrence index.

The words of a partition that have not been met before are laid out in one array of symbols. An index maps every adjacent
pair that has a merge to all its positions; the ranks that occur are taken in ascending order, all positions of a rank
are merged at once, and only the position lists of the neighbouring pairs are updated. Each distinct word is merged once.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Fixed value: how the vocabulary's text is cut into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Folder of the public tokenizers; a parameter of every operator that encodes.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"

#: Distinct words whose ids a task keeps; beyond, it starts afresh (ids stay the same, only work is repeated).
KEEP_WORDS = 400_000


def _byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return letters


@dataclass(frozen=True)
class Vocabulary:
    """Byte ids, merges as (left id << 32 | right id) -> (rank, merged id), and the bytes of each id."""

    byte_id: tuple[int, ...]
    merges: dict[int, tuple[int, int]]
    token_bytes: tuple[bytes, ...]


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    model = json.loads(open(path, encoding="utf-8").read())["model"]
    letters = _byte_letters()
    ids = model["vocab"]
    to_bytes = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        if all(c in letters for c in token):
            to_bytes[i] = bytes(letters[c] for c in token)
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
    byte_id = [0] * 256
    for c, b in letters.items():
        byte_id[b] = ids[c]
    return Vocabulary(tuple(byte_id), merges, tuple(to_bytes))


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word, merged together through one pair occurrence index."""
    byte_id, merges = vocabulary.byte_id, vocabulary.merges
    symbols: list[int] = []
    starts = []
    for w in words:
        starts.append(len(symbols))
        symbols.extend(map(byte_id.__getitem__, w))
        symbols.append(-1)
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    previous = -1
    for i, s in enumerate(symbols):
        if previous >= 0 and s >= 0:
            key = previous << 32 | s
            if key in merges:
                index.setdefault(key, []).append(i - 1)
        previous = s
    active = [(merges[k][0], k) for k in index]
    heapq.heapify(active)
    while active:
        _, key = heapq.heappop(active)
        positions = index.pop(key, None)
        if positions is None:
            continue
        left, right, new = key >> 32, key & 0xFFFFFFFF, merges[key][1]
        positions.sort()
        for i in positions:
            if symbols[i] != left:
                continue
            j = after[i]
            if symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -2
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            if h >= 0 and symbols[h] >= 0:
                pair = symbols[h] << 32 | new
                if pair in merges:
                    if pair not in index:
                        index[pair] = []
                        heapq.heappush(active, (merges[pair][0], pair))
                    index[pair].append(h)
            if symbols[k] >= 0:
                pair = new << 32 | symbols[k]
                if pair in merges:
                    if pair not in index:
                        index[pair] = []
                        heapq.heappush(active, (merges[pair][0], pair))
                    index[pair].append(i)
    out = []
    for s in starts:
        ids = []
        while symbols[s] >= 0:
            ids.append(symbols[s])
            s = after[s]
        out.append(ids)
    return out


#: Classes of boundary, from weak to strong: inside a word, word, clause, sentence, line, paragraph.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
#: How a word may end: marks that count only before white space, and marks that need none.
SPACED_CLAUSE, SPACED_SENTENCE, FULL_CLAUSE, FULL_SENTENCE, LINE_END = 1, 2, 3, 4, 5
_ENDS = (
    (LINE_END, regex.compile(r"\n\s*$")),
    (FULL_SENTENCE, regex.compile(r"[。！？।॥][\"'”’»）)\]」』]*$")),
    (SPACED_SENTENCE, regex.compile(r"[.!?…][\"'”’»）)\]」』]*$")),
    (FULL_CLAUSE, regex.compile(r"[，、；：]$")),
    (SPACED_CLAUSE, regex.compile(r"[,;:—–-][\"'”’»)\]]*$")),
)


def _end_class(word: str) -> int:
    return next((k for k, p in _ENDS if p.search(word)), 0)


class Encoder:
    """Ids of texts, with the distinct words of a task kept as numbered rows of flat tables."""

    def __init__(self, path: str = "", keep: int = KEEP_WORDS) -> None:
        self.vocabulary = load_vocabulary(path or f"{TOKENIZERS}/{BYTE_BPE}")
        self.find = regex.compile(WORDS).findall
        self.keep = keep
        by = self.vocabulary.token_bytes
        self.starts_char = np.array([bool(b) and b[0] & 0xC0 != 0x80 for b in by])
        self.bytes = np.array([len(b) for b in by], dtype=np.int32)
        self.chars = np.array([sum(c & 0xC0 != 0x80 for c in b) for b in by], dtype=np.int32)
        self._reset()

    def _reset(self) -> None:
        self.parts: dict[str, list[int]] = {}
        self.number: dict[str, int] = {}
        self.words = 0
        self.store = np.zeros(4096, np.int32)
        self.offsets = np.zeros(1024, np.int64)
        self.stored = 0
        self.sizes = np.zeros(1024, np.int32)
        self.ends = np.zeros(1024, np.int8)
        self.spaced = np.zeros(1024, bool)

    def _learn(self, words: list[str]) -> None:
        merged = merge_words([w.encode("utf-8", "surrogatepass") for w in words], self.vocabulary)
        ids = np.fromiter(chain.from_iterable(merged), np.int32)
        while len(self.store) < self.stored + len(ids):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.stored : self.stored + len(ids)] = ids
        first, self.words = self.words, self.words + len(words)
        while len(self.sizes) < self.words:
            self.sizes, self.ends, self.spaced, self.offsets = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.ends, self.spaced, self.offsets))
        sizes = np.array([len(m) for m in merged], np.int64)
        self.sizes[first : self.words] = sizes
        self.offsets[first : self.words] = self.stored + np.cumsum(sizes) - sizes
        self.stored += len(ids)
        for i, w in enumerate(words, first):
            self.number[w] = i
            self.ends[i] = _end_class(w)
            self.spaced[i] = w[0].isspace()

    def numbers(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The word numbers of each text; they hold until the next call."""
        cut = [self.find(t) for t in texts]
        new = set().union(*cut) - self.number.keys() if cut else set()
        if new and len(self.number) + len(new) > self.keep:
            self._reset()
            new = set().union(*cut)
        if new:
            self._learn(sorted(new))
        get = self.number.__getitem__
        return [np.fromiter(map(get, words), np.int32, len(words)) for words in cut]

    def flat(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of a row of word numbers: one gather from the store of all words."""
        sizes = self.sizes[numbers]
        at = np.cumsum(sizes, dtype=np.int64) - sizes
        return self.store[np.arange(int(sizes.sum())) + np.repeat(self.offsets[numbers] - at, sizes)]

    def encode(self, text: str) -> list[int]:
        return self.flat(self.numbers([text])[0]).tolist()

    def size(self, text: str) -> int:
        return int(self.sizes[self.numbers([text])[0]].sum())
