"""Text functions as Column expressions; they stay inside generated code unless their docstring says otherwise.

Null stays null everywhere; the empty text gives the empty text or the empty array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions import lexicon


def lowered(c: Column) -> Column:
    """Lower case in which the dotted capital I has one form in every engine."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def normalize(c: Column) -> Column:
    """Letters and digits in lower case, anything else one space, trimmed."""
    return F.trim(F.regexp_replace(lowered(c), r"[^\p{L}\p{N}]+", " "))


def name_key(c: Column) -> Column:
    """Letters, digits and underscores in lower case, joined."""
    return F.regexp_replace(lowered(c), r"[^\p{L}\p{N}_]+", "")


def collapse(c: Column) -> Column:
    """Lower case with ё as е and white space as one space; punctuation stays."""
    return F.trim(F.regexp_replace(F.replace(lowered(c), F.lit("ё"), F.lit("е")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def casefolded(s: pd.Series) -> pd.Series:
    """Compatibility form and case folding, which no built-in has; vectorized Python."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def words(c: Column) -> Column:
    """The words of the normalized text."""
    return F.filter(F.split(normalize(c), " "), lambda t: t != "")


def significant(c: Column) -> Column:
    """Words of two letters or more, and digits."""
    return F.filter(words(c), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the whole words of ``phrase`` stand together in ``text``; both normalized already."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def statements(c: Column) -> Column:
    """The statements of a text: cut after end marks before white space, and at line ends."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?…])\s+|[\n\r]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def occurrences(text: Column, part: Column) -> Column:
    """The places, from 0, at which ``part`` occurs in ``text``, overlaps included; empty where it does not fit.

    The text is split before every occurrence, so the work grows with its length and not with its square; every piece but the
    first begins with one.
    """
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.split(text, quoted)
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.when((acc["at"] > 0) | F.startswith(text, part), F.array_append(acc["found"], acc["at"])).otherwise(acc["found"]).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    return F.when(F.length(part) > 0, F.aggregate(pieces, start, step, lambda acc: acc["found"])).otherwise(F.array().cast("array<int>"))


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the words of ``needle`` come in ``hay`` in this order; an empty needle does not."""
    at = F.aggregate(hay, F.lit(0), lambda i, t: F.when(F.get(needle, i) == t, i + 1).otherwise(i))
    return (F.size(needle) > 0) & (at == F.size(needle))


def in_order(tokens: Column, shared: Column) -> Column:
    """The words of ``tokens`` that are among ``shared``, in their order."""
    return F.filter(tokens, lambda t: F.array_contains(shared, t))


def any_of(tokens: Column, lexemes: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, lexemes)))


def support(statement: Column, evidence: Column) -> Column:
    """How a text supports a statement; the order of the checks decides.

    exact (the normalized statement is part of the normalized text, even within words), adds_causality, drops_negation,
    unsupported (a word is missing), ordered, role_order_changed.
    """
    s, e = normalize(statement), normalize(evidence)
    st, et = significant(statement), significant(evidence)
    shared = F.array_intersect(st, et)
    return (
        F.when((F.size(st) == 0) | (s == ""), "unsupported")
        .when(F.contains(e, s), "exact")
        .when(any_of(st, lexicon.CAUSALITY) & ~any_of(et, lexicon.CAUSALITY), "adds_causality")
        .when(any_of(et, lexicon.NEGATION) & ~any_of(st, lexicon.NEGATION), "drops_negation")
        .when(F.size(F.array_except(st, et)) > 0, "unsupported")
        .when(is_subsequence(st, et), "ordered")
        .when(in_order(et, shared) != st, "role_order_changed")
        .otherwise("unsupported")
    )


def is_supported(statement: Column, evidence: Column) -> Column:
    return support(statement, evidence).isin("exact", "ordered")


def all_supported(text: Column, evidence: Column) -> Column:
    """Whether a text has statements and all of them are supported."""
    parts = statements(text)
    return (F.size(parts) > 0) & F.forall(parts, lambda s: is_supported(s, evidence))


def title_supported(title: Column, evidence: Column, allowed: Column) -> Column:
    """Whether a title is supported, or has words and each of them is a significant word of the array ``allowed`` of texts."""
    words_ = F.flatten(F.transform(F.coalesce(allowed, F.array().cast("array<string>")), significant))
    own = significant(title)
    return is_supported(title, evidence) | ((F.size(own) > 0) & (F.size(F.array_except(own, words_)) == 0))


def question_adds_facts(question: Column, evidence: Column) -> Column:
    """Whether a question has words, those of asking left out, that its evidence lacks."""
    own = F.array_except(significant(question), F.array(*map(F.lit, lexicon.QUESTION_WORDS)))
    return F.size(F.array_except(own, significant(evidence))) > 0


def is_open(c: Column) -> Column:
    """Whether a text signals that something is not known."""
    n = normalize(c)
    out = F.lit(False)
    for s in lexicon.OPEN_SIGNALS:
        out = out | F.contains(n, F.lit(s))
    return out


def drops_negation(text: Column, evidence: Column) -> Column:
    return any_of(words(evidence), lexicon.NEGATION) & ~any_of(words(text), lexicon.NEGATION)


def script(c: Column) -> Column:
    """cyrillic, latin, mixed or other."""
    cyr, lat = c.rlike(r"[\x{0400}-\x{04FF}]"), c.rlike(r"[A-Za-z\x{00C0}-\x{024F}]")
    return F.when(cyr & lat, "mixed").when(cyr, "cyrillic").when(lat, "latin").otherwise("other")


def prefers_kazakh(c: Column) -> Column:
    """Whether a text has letters or first-person words of Kazakh."""
    return lowered(c).rlike(f"[{lexicon.KAZAKH_LETTERS}]") | any_of(words(c), lexicon.FIRST_PERSON["kk"])


def _starts(stem: str) -> Callable[[Column], Column]:
    return lambda t: F.startswith(t, F.lit(stem))


def categories(normalized: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """The sorted names of the lists that have a marker in a normalized text."""
    tokens = F.split(normalized, " ")
    hits = []
    for name in sorted(lists):
        whole = [m for m in lists[name] if not m.endswith("*")]
        stems = [m[:-1] for m in lists[name] if m.endswith("*")]
        hit = any_of(tokens, tuple(whole)) if all(" " not in m for m in whole) else F.lit(False)
        for m in stems:
            hit = hit | F.exists(tokens, _starts(m))
        hits.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*hits))


def sensitivity(c: Column) -> Column:
    """(level, categories) of a text."""
    n = normalize(c)
    high, some = categories(n, lexicon.HIGHLY_SENSITIVE), categories(n, lexicon.SENSITIVE)
    return F.when(F.size(high) > 0, F.struct(F.lit("highly_sensitive").alias("level"), high.alias("categories"))).when(F.size(some) > 0, F.struct(F.lit("sensitive").alias("level"), some.alias("categories"))).otherwise(F.struct(F.lit("normal").alias("level"), F.array().cast("array<string>").alias("categories")))


def stable_id(prefix: str, *parts: Column, length: int = 32, separator: str = "\x1f") -> Column:
    """A content-addressed id; null parts count as empty."""
    joined = F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, length))
