"""One form for texts that look the same but differ in their characters.

A transducer is compiled from a precomputed table: full- and half-width forms, composed and decomposed characters of every script,
white space, invisible characters, ligatures and look-alike letters of other scripts each have one output. It reads a text once,
always takes the longest entry that matches (a grapheme cluster before its base letter) and writes the outputs. The table is made
from the Unicode data of the Python that runs and checked for conflicts: the output of an output is itself, no two letters of one
script share an output, and upper case never becomes lower case.

What only resembles another character stays distinct on purpose: quotes and apostrophes of different shape, bold, italic and
encircled characters, superscripts, and letters that a script tells apart itself (У and Ү).

Defined results: null stays null; a text of nothing but white space and invisible characters becomes the empty text; equal
texts are never a pair; rows without a key, a group or a text take no part; a key that was delivered twice counts once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.runtime import materialize, ship

#: Cyrillic and Greek letters that look like Latin ones.
CYRILLIC_LIKE = "АВСЕНІЈКМОРЅТХУаеһіјорсԛѕхуԝӘәԁԚԜ"
CYRILLIC_AS = "ABCEHIJKMOPSTXYaehijopcqsxywƏədQW"
GREEK_LIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXvopcj"
#: Letters of other scripts that look like Latin ones.
OTHER_LIKE = "ѵՕՏՍհոսօցզյᎪᎬᎫᎳᎷᎻᎽᏀᏃᎢᎡᏚᏙᏞᏟᏢᏦᏴᎠ"
OTHER_AS = "vOSUhnuogqjAEJWMHYGZTRSVLCPKBD"

#: Code points that are not seen at all (first and last of each range).
INVISIBLE_RANGES = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
INVISIBLE = "".join(chr(c) for a, b in INVISIBLE_RANGES for c in range(a, b + 1))


#: Where Unicode has characters that are equal to others or to a base and its marks; syllables of Hangul are composed by rule.
CANONICAL = [*range(0xC0, 0x2400), *range(0x2A00, 0x2B00), *range(0x3040, 0x3100), *range(0xF900, 0xFB00), *range(0xFB1D, 0xFB50), *range(0x11000, 0x11A00), *range(0x2F800, 0x2FA20)]
#: Ligatures and Roman numerals: one character that looks like several letters, or like one.
JOINED = [*range(0xFB00, 0xFB07), *range(0x2160, 0x2180)]


def _letters() -> dict[str, str]:
    """Each single character whose output is another one."""
    out = {}
    for like, as_ in ((CYRILLIC_LIKE, CYRILLIC_AS), (GREEK_LIKE, GREEK_AS), (OTHER_LIKE, OTHER_AS)):
        out |= dict(zip(like, as_, strict=True))
    for c in map(chr, [*range(0xFF01, 0xFFEF), *range(0x3200, 0x3400)]):
        d = unicodedata.decomposition(c)
        if d.startswith(("<wide>", "<narrow>")):
            out[c] = unicodedata.normalize("NFKC", c)
    for c in "‐‑−":
        out[c] = "-"
    return out


def _accented(letters: dict[str, str]) -> dict[str, str]:
    """Each way to write an accented letter (one character, or a base of any look and its marks) to one composed form."""
    looks: dict[str, list[str]] = {}
    for c, o in letters.items():
        looks.setdefault(o, []).append(c)
    out = {}
    for c in map(chr, CANONICAL):
        d = unicodedata.normalize("NFD", c)
        if d == c or unicodedata.combining(d[0]):
            continue
        target = unicodedata.normalize("NFC", letters.get(d[0], d[0]) + d[1:])
        if c != target:
            out[c] = target
        for base in {d[0], letters.get(d[0], d[0]), *looks.get(letters.get(d[0], d[0]), ())}:
            if base + d[1:] != target:
                out[base + d[1:]] = target
    return out


def build_table() -> dict[str, str]:
    """The whole mapping, checked for conflicts."""
    letters = _letters()
    table = _accented(letters) | letters | {chr(c): d for c in JOINED if (d := unicodedata.normalize("NFKC", chr(c))) != chr(c)}
    for source, target in table.items():
        again = "".join(table.get(c, c) for c in target)
        if table.get(target, target) != target or (len(target) == 1 and again != target):
            raise ValueError(f"{source!r} goes to {target!r}, which goes on to {again!r}")
        if len(source) == len(target) == 1 and source.isupper() and target.islower():
            raise ValueError(f"{source!r} would lose its case")
    seen: dict[tuple[str, str], str] = {}
    for source, target in letters.items():
        script = unicodedata.name(source).split()[0]
        if seen.setdefault((script, target), source) != source:
            raise ValueError(f"{source!r} and {seen[script, target]!r} of one script would become equal")
    return table


class Transducer:
    """The compiled table; ``apply`` reads a text once."""

    def __init__(self) -> None:
        self.table = build_table()
        hidden = regex.escape(INVISIBLE)
        singles = "".join(regex.escape(c) for c in sorted(self.table) if len(c) == 1)
        mark = rf"[\p{{M}}--[{hidden}]]"
        cluster = rf"[^\s\p{{M}}{hidden}][{hidden}]*{mark}[\p{{M}}{hidden}]*"
        self.hidden = regex.compile(f"(?V1)[{hidden}]+")
        self.pattern = regex.compile(rf"(?V1){cluster}|[\uFF66-\uFF9D][\uFF9E\uFF9F]|[\u1100-\u11FF\uA960-\uA97F\uD7B0-\uD7FF]{{2,}}|[{singles}]|[\s{hidden}]+")
        self.plain = regex.compile(r"[\x21-\x7e]*(?: [\x21-\x7e]+)*")
        self.known: dict[str, str] = {}

    def _out(self, m: regex.Match) -> str:
        s = m.group()
        got = self.known.get(s)
        if got is None:
            got = self.table.get(s)
            if got is None:
                if s[0].isspace() or self.hidden.fullmatch(s[0]):
                    got = " " if self.hidden.sub("", s) else ""
                else:
                    got = self._cluster(self.hidden.sub("", s))
            if len(self.known) < 100_000:
                self.known[s] = got
        return got

    def _cluster(self, s: str) -> str:
        """A base letter with its marks in canonical order."""
        d = unicodedata.normalize("NFD", s)
        return self.table.get(d) or unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in d))

    def apply(self, text: str) -> str:
        if self.plain.fullmatch(text):
            return text
        return self.pattern.sub(self._out, text).strip()


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(T.StringType())
def one_form(texts: pd.Series) -> pd.Series:
    """The one form of each text; null stays null."""
    apply = transducer().apply
    return texts.map(apply, na_action="ignore")


def unified(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``df`` with the one form of ``text`` as a further column."""
    ship(df.sparkSession)
    return df.withColumn(out, one_form(F.col(text)))


def digest(column: str) -> Column:
    """128 bits of a text: what is compared and moved in its place."""
    return F.unhex(F.md5(column))


def _formed(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key, grp, text, form) of the rows of forms that have more than one text; texts and forms as digests, written once.

    Forms with a single text, nearly all of them, leave before any join.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(text).alias("text"))
    rows = materialize(unified(rows, "text").select("key", "grp", digest("text").alias("text"), digest("form").alias("form")).distinct())
    many = rows.groupBy("grp", "form").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("grp", "form")
    return rows.join(many, ["grp", "form"], "left_semi")


def form_classes(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key, class_id, n_texts, n_members): one row for each row that looks like another text of its group.

    A class is named by the least key in it; it has as many rows as members, however many pairs these make.
    """
    rows = _formed(df, key, group, text)
    texts = rows.groupBy("grp", "form", "text").agg(F.min("key").alias("least"), F.countDistinct("key").alias("n"))
    classes = texts.groupBy("grp", "form").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_members"))
    return rows.select("grp", "form", "key").distinct().join(classes, ["grp", "form"]).select("key", "class_id", "n_texts", "n_members")


def equal_looking(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key_a, key_b) of rows of one group whose texts look the same but are not equal.

    The distinct texts of a form are paired first, and only then their rows, so copies of one text never meet each other. The
    pairs are what the project asks for; ``form_classes`` says the same in one row a member.
    """
    rows = _formed(df, key, group, text)
    texts = rows.select("grp", "form", "text").distinct()
    both = texts.withColumnRenamed("text", "text_a").join(texts.withColumnRenamed("text", "text_b"), ["grp", "form"]).where("text_a < text_b").drop("form")
    left = rows.select("grp", F.col("text").alias("text_a"), F.col("key").alias("a"))
    right = rows.select("grp", F.col("text").alias("text_b"), F.col("key").alias("b"))
    pairs = both.join(left, ["grp", "text_a"]).join(right, ["grp", "text_b"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
