"""Linking typed spellings of names to the profiles they name, by a trie join.

The names of a family's profiles are sharded into tries. Every distinct word of the family's mentions runs through the trie
as a Levenshtein automaton (with transpositions) that yields all names within a bounded distance; inflected forms are looked
up exactly. The pairs found this way are checked over the orders in which given name, surname and patronymic may stand, and
each mention keeps its one best profile. Words are compared in a folded spelling in which scripts, transliterations, look-alike
letters and doubled letters agree. Short forms come from the table of known ones, from the profiles' own aliases, and from
aliases that a share of the profiles of one given name have.

Defined results: null and blank names, and names without letters, give no row; a mention whose best two profiles are equally
good gives no row; null, blank and crammed aliases are allowed; a mention or profile that was delivered twice counts once; a
profile without a usable name is never named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm.lookalike import CYRILLIC_AS, CYRILLIC_LIKE, transducer
from evigraph.runtime import materialize, ship

#: Names in one trie, and words of mentions run through one copy of it; larger families are cut into more shards.
TRIE_NAMES, SHARD_WORDS = 20_000, 20_000
#: Share of all profiles that must have a word as a name before it counts as known, and share of the profiles of a given name that
#: must have an alias before it counts as a short form of that name. Shares, so that they mean the same at every size.
KNOWN_SHARE, FORM_SHARE = 1 / 20_000, 0.1

#: The symbol of each Cyrillic letter, and of Latin letters and groups of both transliterations; 9 is ya, 8 is yu.
CYRILLIC = dict(zip("абвгғдезиійкқлмнңоөпрстуұүфхһыэәё", "abvggdeziiikklmnnooprstuuufhhieae", strict=True)) | {"ж": "j", "ц": "c", "ч": "q", "ш": "w", "щ": "w", "ъ": "", "ь": "", "ю": "8", "я": "9"}
LATIN_GROUPS = {"shch": "w", "sh": "w", "ch": "q", "zh": "j", "kh": "h", "ts": "c", "yo": "e", "yu": "8", "ya": "9", "iu": "8", "ia": "9", "io": "e"}
LATIN = {"y": "i", "q": "k", "ñ": "n", "ş": "w", "ç": "q", "ğ": "g", "ä": "a", "ö": "o", "ü": "u", "ū": "u", "x": "h", "ə": "a", "w": "u", "ë": "e", "ß": "s", "â": "a", "î": "i"}

#: Words for relatives that stand beside a name.
KIN = "ата атам атай аға ағам ағай аке әке әкем ана анам апа апам апай апке әпке әже әжем әжей тәте тәтем көке көкем іні інім қарындас дед деда дедушка баба бабушка бабуля дядя тётя тетя тётка мама папа отец мать брат сестра сын дочь внук внучка ata aga agai agay apa apai apay azhe aje tate koke ded dedushka baba babushka dyadya tyotya tetya uncle aunt auntie grandmother grandfather grandma grandpa mother father brother sister onkel tante oma opa großmutter großvater teyze amca dede nine"

#: Case endings in folded spelling.
KAZAKH_ENDINGS = ("nin", "din", "tin", "ga", "ge", "ka", "ke", "ni", "di", "ti", "da", "de", "ta", "te", "dan", "den", "tan", "ten", "nan", "nen", "men", "ben", "pen")
RUSSIAN_HARD, RUSSIAN_A, RUSSIAN_IA, RUSSIAN_I = ("a", "u", "om", "e"), ("i", "e", "u", "oi", "ei"), ("i", "iu", "e", "ei", "ie", "iei"), ("a", "ia", "u", "iu", "em", "e")

_PATRONYMIC = re.compile(r"(uli|kizi|oviq|eviq|iniq|ovna|evna|iqna|[^aeiou]iq)$")
_SURNAME = re.compile(r"(ov|ova|ev|eva|in|ina|ski|skaia|enko|iuk)$")
_BACK = dict(zip(CYRILLIC_AS, CYRILLIC_LIKE, strict=True))
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=200_000)
def letters(word: str, cyrillic: bool) -> str:
    """One word in its one form as symbols, one for each letter, in which both scripts and all transliterations agree."""
    word = word if not cyrillic else "".join(_BACK.get(c, c) for c in word)
    word = word.lower().replace("\u0451", "ё").replace("ı", "i").replace("i\u0307", "i")
    out, i = [], 0
    while i < len(word):
        for n in (4, 2):
            g = word[i : i + n]
            # io is yo inside a word, but not in the ending of surnames in -iov, nor at the start
            if g in LATIN_GROUPS and (g != "io" or i and word[i + 2 : i + 3] != "v"):
                out.append(LATIN_GROUPS[g])
                i += n
                break
        else:
            c = word[i]
            out.append(CYRILLIC.get(c, LATIN.get(c, c if c.isascii() else "")))
            i += 1
    return "".join(out)


@lru_cache(maxsize=200_000)
def fold(symbols: str) -> str:
    """The spelling in which words are equal: ya and yu written out, doubled letters once."""
    text = symbols.replace("9", "ia").replace("8", "iu")
    return "".join(b for a, b in pairwise(" " + text) if a != b)


def folded(c: Column) -> Column:
    """``fold`` of a column."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit("9"), F.lit("ia")), F.lit("8"), F.lit("iu")), r"(.)\1+", "$1")


_ONLY_LATIN = re.compile(r"[bdfgjklmnqrtuvwzDFGJLNQRUVWZäöüñğşūıçÄÖÜÑĞŞŪÇ]")
_ONLY_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def words_of(name: str) -> list[str]:
    """The words of a name as symbols, kin terms left out; a Cyrillic initial stays the capital letter that it is."""
    raw = _LETTERS.findall(transducer().apply(name or "").replace("'", ""))
    cyr = [bool(_ONLY_CYRILLIC.search(w)) for w in raw]
    lat = [bool(_ONLY_LATIN.search(w)) for w in raw]
    default = sum(cyr) > sum(lat) or (not any(cyr) and not any(lat) and bool(_ONLY_CYRILLIC.search(name or "")))
    words = []
    for w, c, la in zip(raw, cyr, lat, strict=True):
        if c and la:
            c = len(_ONLY_CYRILLIC.findall(w)) >= len(_ONLY_LATIN.findall(w))
        elif not c and not la:
            c = default
        f = letters(w, c)
        if f:
            words.append(_cyrillic(w).upper() if len(w) == 1 and c else f)
    rest = [w for w in words if fold(w) not in _kin()]
    return rest if any(len(w) > 1 for w in rest) else words


def _cyrillic(word: str) -> str:
    return "".join(_BACK.get(c, c) for c in word)


def capitals_of(name: str) -> list[str]:
    """The capitals that the Cyrillic words of a name begin with."""
    raw = _LETTERS.findall(transducer().apply(name or ""))
    return sorted({_cyrillic(w)[0].upper() for w in raw if _ONLY_CYRILLIC.search(w)})


@lru_cache(maxsize=1)
def _kin() -> frozenset[str]:
    apply = transducer().apply
    return frozenset(fold(letters(apply(w), bool(_ONLY_CYRILLIC.search(w)))) for w in KIN.split())


def is_patronymic(word: str) -> bool:
    return len(word) > 4 and bool(_PATRONYMIC.search(fold(word)))


def is_surname(word: str) -> bool:
    return len(word) > 3 and bool(_SURNAME.search(fold(word)))


def parts_of(name: str) -> tuple[list[str], list[str], list[str]]:
    """(given names, surnames, patronymics) of a full name by the shape and order of its words."""
    words = [w for w in words_of(name) if len(w) > 1]
    patronymics = [w for i, w in enumerate(words) if i and is_patronymic(w)]
    rest = [w for i, w in enumerate(words) if not (i and is_patronymic(w))]
    if len(rest) == 1:
        return rest, [], patronymics
    if len(rest) == 2:
        first_is_surname = bool(patronymics and words[-1] in patronymics and len(words) == 3) or "," in (name or "") or (is_surname(rest[0]) and not is_surname(rest[1]))
        return ([rest[1]], [rest[0]], patronymics) if first_is_surname else ([rest[0]], [rest[1]], patronymics)
    return rest[:1], rest[1:], patronymics


@lru_cache(maxsize=100_000)
def inflected(name: str) -> tuple[str, ...]:
    """Case forms of a name, folded."""
    form = fold(name)
    out = [form + e for e in KAZAKH_ENDINGS]
    if form.endswith("ia"):
        out += [form[:-2] + e for e in RUSSIAN_IA]
    elif form.endswith("a"):
        out += [form[:-1] + e for e in RUSSIAN_A]
    elif form.endswith("i"):
        out += [x + e for e in RUSSIAN_I for x in (form, form[:-1])]
    else:
        out += [form + e for e in RUSSIAN_HARD]
    return tuple(sorted({fold(f) for f in out} - {form}))


def allowed(word: str) -> int:
    """The distance within which a word of this length may be another one misspelt."""
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


class Trie:
    """Names in a trie; ``near`` runs a word through it as a Levenshtein automaton with transpositions."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, name: str) -> None:
        node = self.root
        for c in name:
            node = node.setdefault(c, {})
        node[""] = name

    def near(self, word: str, bound: int) -> list[tuple[str, int]]:
        """(name, distance) of the names within ``bound``; a branch ends where no continuation can come within it."""
        n = len(word)
        out = []
        stack = [(self.root, "", list(range(n + 1)), None)]
        while stack:
            node, last, row, above = stack.pop()
            end = node.get("")
            if end is not None and row[n] <= bound:
                out.append((end, row[n]))
            for c, child in node.items():
                if c == "":
                    continue
                left = row[0] + 1
                new = [left]
                for j in range(n):
                    w = word[j]
                    d = row[j] if w == c else row[j] + 1
                    if left < d:
                        d = left + 1
                    up = row[j + 1] + 1
                    if up < d:
                        d = up
                    if above is not None and j and w == last and word[j - 1] == c and above[j - 1] + 1 < d:
                        d = above[j - 1] + 1
                    new.append(d)
                    left = d
                if min(new) <= bound or min(row) <= bound - 1:
                    stack.append((child, c, new, row))
        return out


@lru_cache(maxsize=500_000)
def distance(a: str, b: str, bound: int) -> int:
    """Levenshtein distance with transpositions, or bound + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        new = [i]
        for j in range(1, len(b) + 1):
            d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > bound:
            return bound + 1
    return min(row[-1], bound + 1)


GIVEN, SURNAME, PATRONYMIC = KINDS = ("g", "f", "p")
MATCHES = "family_id string, word string, name string, kind string, dist int, bent boolean"
_MATCHES = pa.schema([("family_id", pa.string()), ("word", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("dist", pa.int32()), ("bent", pa.bool_())])


def _trie_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards arrive in order, the names of each before its words; one trie is held at a time.

    A word that is a name by itself is never a misspelt other one, so it is only looked up, exactly and in its case forms.
    """
    key, trie, kinds, same, bent = None, Trie(), {}, {}, {}
    for b in batches:
        rows = []
        for family, t, s, side, text, kind in zip(*(b.column(n).to_pylist() for n in ("family_id", "t", "s", "side", "text", "kind")), strict=True):
            if (family, t, s) != key:
                key = (family, t, s)
                trie, kinds, same, bent = Trie(), {}, {}, {}
            if side == 0:
                trie.add(text)
                kinds.setdefault(text, []).append(kind)
                same.setdefault(fold(text), set()).add((text, kind))
                for f in inflected(text):
                    bent.setdefault(f, set()).add((text, kind))
                continue
            f = fold(text)
            found = {(name, k): d for name, d in trie.near(text, 0 if kind else allowed(text)) for k in kinds[name]} | dict.fromkeys(same.get(f, ()), 0)
            rows.extend((family, text, name, k, d, False) for (name, k), d in sorted(found.items()))
            rows.extend((family, text, name, k, 0, True) for name, k in sorted(bent.get(f, ())))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCHES, strict=True)], schema=_MATCHES)


def trie_join(names: DataFrame, words: DataFrame, trie_names: int = TRIE_NAMES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Pairs of words and names of one family within the allowed distance.

    ``names``: family_id, text, kind; ``words``: family_id, text and perhaps known (whether it is a name by itself); distinct. A family with many names has several tries,
    and its words visit each; a family with many words has several copies of its tries, and each word visits one.
    """
    ship(names.sparkSession)
    n = names.groupBy("family_id").agg(F.ceil(F.count("*") / trie_names).cast("int").alias("tries"))
    w = words.groupBy("family_id").agg(F.ceil(F.count("*") / shard_words).cast("int").alias("copies"))
    size = n.join(w, "family_id")
    left = names.join(size, "family_id").select("family_id", F.pmod(F.xxhash64("text", "kind"), "tries").cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("s"), F.lit(0).alias("side"), "text", "kind")
    right = words.join(size, "family_id").select("family_id", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("t"), F.pmod(F.xxhash64("text"), "copies").cast("int").alias("s"), F.lit(1).alias("side"), "text", (F.when(F.col("known"), "known").otherwise("") if "known" in words.columns else F.lit("")).alias("kind"))
    shards = left.unionByName(right).repartition("family_id", "t", "s").sortWithinPartitions("family_id", "t", "s", "side", "text")
    return shards.mapInArrow(_trie_join, MATCHES)


PARTS = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("givens", "surnames", "patronymics", "shorts", "other_surnames", "capitals")])


@F.pandas_udf(PARTS)
def _profile_parts(canonical: pd.Series, aliases: pd.Series) -> pd.DataFrame:
    out = []
    for name, own in zip(canonical, aliases, strict=True):
        givens, surnames, patronymics = parts_of(name or "")
        shorts: list[str] = []
        others: list[str] = []
        for alias in own if own is not None else ():
            for a in re.split(r"[;/|]", alias or ""):
                words = [w for w in words_of(a) if len(w) > 1]
                if len(words) == 1:
                    shorts.append(words[0])
                elif words:
                    g, s, p = parts_of(a)
                    shorts += g
                    others += s
                    patronymics = patronymics + p
        out.append((sorted(set(givens)), sorted(set(surnames)), sorted(set(patronymics)), sorted(w for w in set(shorts) if fold(w) not in map(fold, givens)), sorted(set(others)), sorted({c for n in (name, *(own if own is not None else ())) for c in capitals_of(n or "")})))
    return pd.DataFrame(out, columns=PARTS.names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _initial_symbols(words: pd.Series) -> pd.Series:
    """The symbols of the initials among words."""
    return words.map(lambda ws: sorted({letters(w, w.isupper()) for w in ws if len(w) == 1}), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _mention_words(names: pd.Series) -> pd.Series:
    return names.map(words_of, na_action="ignore")


def profile_parts(profiles: DataFrame) -> DataFrame:
    """family_id, person_id and the folded parts of each profile's names, each profile once."""
    own = profiles.select("family_id", "person.person_id", "person.canonical_name", "person.aliases").where("family_id is not null and person_id is not null")
    own = own.groupBy("family_id", "person_id").agg(F.min("canonical_name").alias("canonical_name"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("aliases"))
    return own.select("family_id", "person_id", _profile_parts("canonical_name", "aliases").alias("p")).select("family_id", "person_id", "p.*")


def short_forms(people: DataFrame, known: DataFrame, share: float = FORM_SHARE) -> DataFrame:
    """(given, short) pairs: the known ones, and aliases that at least ``share`` of the profiles of a given name have.

    ``people``: givens, shorts and n, the number of profiles that have just these names.
    """
    table = known.select(_mention_words("given_name")[0].alias("given"), _mention_words("short_form")[0].alias("short"))
    own = people.select(F.explode("givens").alias("given"), "shorts", "n")
    total = own.groupBy("given").agg(F.sum("n").alias("total"))
    shared = own.select("given", F.explode("shorts").alias("short"), "n").groupBy("given", "short").agg(F.sum("n").alias("n")).join(total, "given").where(F.col("n") >= share * F.col("total"))
    return table.unionByName(shared.select("given", "short")).where("given is not null and short is not null").where(folded(F.col("given")) != folded(F.col("short"))).distinct()


def _min(words: list[str], word: str, bound: int) -> int:
    """The least distance to one of ``words``, or bound + 1; words that fold to one are equal."""
    f = fold(word)
    return min((0 if fold(w) == f else distance(word, w, bound) for w in words), default=bound + 1)


def _begins(name: str, initial: str, capitals: list[str]) -> bool:
    """Whether a name begins with an initial; Cyrillic capitals that only look or sound alike are told apart."""
    symbol = letters(initial, initial.isupper())
    return name.startswith(symbol) and (not initial.isupper() or not capitals or initial in capitals)


def judge(words: list[str], person: dict, known: set[str]) -> float | None:
    """How badly a mention's words fit a person over all orders of its parts; None where they do not fit at all.

    ``known`` holds the folded words that are names by themselves: they are never taken for misspelt other names.
    """
    full = [w for w in words if len(w) > 1]
    initials = [w for w in words if len(w) == 1]
    surnames, others, patronymics = person["surnames"], person["other_surnames"], person["patronymics"]
    givens, shorts, more = person["givens"], person["shorts"], person["more"]
    own = [*givens, *shorts]
    first = [*own, *more]
    if initials and any(is_surname(w) for w in full) and not any(fold(w) in map(fold, first) for w in full):
        surname = next((w for w in full if is_surname(w)), full[0])
        bound = 0 if fold(surname) in known else 1
        d = min(_min(surnames, surname, bound), _min(others, surname, bound))
        if d > bound or not any((s[-1] == "a") == (surname[-1] == "a") for s in [*surnames, *others]):
            return None
        if not any(_begins(g, initials[0], person["capitals"]) for g in givens):
            return None
        if len(initials) > 1:
            if patronymics and not any(_begins(p, initials[1], person["capitals"]) for p in patronymics):
                return None
            return d + (0.1 if patronymics else 0.3)
        return d + 0.2
    best: float | None = None
    for i, word in enumerate(full):
        f = fold(word)
        cost = next((c for c, names in ((0.0, givens), (0.05, shorts), (0.15, more)) if any(fold(n) == f for n in names)), None)
        if cost is None and any(f in inflected(g) for g in first):
            cost = 0.2
        if cost is None:
            bound = 0 if f in known else allowed(word)
            d = _min(first, word, bound)
            if d > bound:
                continue
            cost = float(d)
        for j, w in enumerate(full):
            if j == i:
                continue
            b = 0 if fold(w) in known else allowed(w)
            s, o, p = _min(surnames, w, b), _min(others, w, b), _min(patronymics, w, b)
            if min(s, o, p) <= b:
                cost += min(s, o + 0.05, p)
            elif is_patronymic(w):
                cost += 9.0 if patronymics else 0.2
            elif is_surname(w):
                cost += 9.0 if surnames else 0.3
            elif any(fold(w) == fold(n) for n in own) or any(fold(w) in inflected(x) for x in [*surnames, *patronymics]):
                cost += 0.1
            elif any(fold(w) == fold(n) for n in more):
                cost += 0.15
            else:
                cost += 9.0 if surnames or fold(w) in known else 0.6
        if initials:
            cost += 0.1
        if cost < 3 and (best is None or cost < best):
            best = cost
    return best


_JUDGED = pa.schema([("family_id", pa.string()), ("spelling", pa.string()), ("person_id", pa.string()), ("n", pa.int64()), ("cost", pa.float64())])
_PARTS = ("givens", "surnames", "patronymics", "shorts", "other_surnames", "capitals", "more")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        parts = zip(*(b.column(n).to_pylist() for n in _PARTS), strict=True)
        for family, spelling, person, n, words, known, own in zip(*(b.column(c).to_pylist() for c in ("family_id", "spelling", "person_id", "n", "words", "known")), parts, strict=True):
            cost = judge(words, dict(zip(_PARTS, (x or [] for x in own), strict=True)), set(known or ()))
            if cost is not None:
                rows.append((family, spelling, person, n, cost))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _JUDGED, strict=True)], schema=_JUDGED)


def _candidates(texts: DataFrame, people: DataFrame, given: DataFrame, matches: DataFrame) -> DataFrame:
    """(family_id, spelling, person_id): all pairs that can decide a spelling, without all people who share a given name.

    A spelling meets everybody of whom two of its words match different names: a given name with a surname, a patronymic or an
    alias of their own, and, where it has initials, a surname with the first letter of a given name. Of whom only one given name
    matches, people of one class (the same name at the same level, the same given names, surname known or not, patronymic known
    or not) all fit a spelling equally badly. Two of a class, besides those met already, tell the best one and a tie. Where its
    least and its greatest person have been met already, the whole class is joined. Classes in which a further word costs more
    than any link may are left out.
    """
    hits = texts.select("family_id", F.col("name").alias("spelling"), F.explode("words").alias("word")).join(matches.withColumnRenamed("name", "text"), ["family_id", "word"]).select("family_id", "spelling", "word", "kind", "text").distinct()
    by_given = hits.where(F.col("kind") == GIVEN).select("family_id", "spelling", "word", "text")
    second = people.select("family_id", "person_id", F.explode(F.array_distinct(F.concat(_kinded("surnames", SURNAME), _kinded("other_surnames", SURNAME), _kinded("patronymics", PATRONYMIC)))).alias("x")).select("family_id", "person_id", F.col("x.k").alias("kind"), F.col("x.t").alias("second"))
    # an alias of a person's own stands beside the given name like a surname does
    beside = second.unionByName(given.where("level < 2").select("family_id", "person_id", F.lit(GIVEN).alias("kind"), F.col("text").alias("second")))
    both = given.select("family_id", "person_id", "text").distinct().join(beside, ["family_id", "person_id"]).where((F.col("kind") != GIVEN) | (F.col("text") != F.col("second")))
    by_second = hits.select("family_id", "spelling", F.col("word").alias("other"), "kind", F.col("text").alias("second"))
    paired = by_given.join(by_second, ["family_id", "spelling"]).where("word <> other").join(both, ["family_id", "text", "kind", "second"]).select("family_id", "spelling", "person_id")
    initials = texts.where(F.exists("words", lambda w: F.length(w) == 1)).select("family_id", F.col("name").alias("spelling"), F.explode(_initial_symbols("words")).alias("symbol"))
    starts = people.select("family_id", "person_id", F.explode("givens").alias("g")).select("family_id", "person_id", F.substring("g", 1, 1).alias("symbol")).distinct()
    surnamed = second.where(F.col("kind") == SURNAME).select("family_id", "person_id", "second").distinct().join(starts, ["family_id", "person_id"])
    by_initial = initials.join(by_second.where(F.col("kind") == SURNAME), ["family_id", "spelling"]).join(surnamed, ["family_id", "second", "symbol"]).select("family_id", "spelling", "person_id")
    met = materialize(paired.unionByName(by_initial).distinct())

    of_class = ["family_id", "text", "level", "givens", "has_surname", "has_patronymic"]
    flags = people.select("family_id", "person_id", "givens", (F.size("surnames") > 0).alias("has_surname"), (F.size("patronymics") > 0).alias("has_patronymic"))
    members = given.join(flags, ["family_id", "person_id"])
    classes = members.groupBy(*of_class).agg(F.count(F.lit(1)).alias("members"), F.min("person_id").alias("a"), F.max("person_id").alias("b"))
    n_words = texts.select("family_id", F.col("name").alias("spelling"), F.size(F.filter("words", lambda w: F.length(w) > 1)).alias("full"))
    wanted = by_given.select("family_id", "spelling", "text").distinct().join(n_words, ["family_id", "spelling"]).join(classes, ["family_id", "text"])
    wanted = materialize(wanted.where((F.col("full") == 1) | ~F.col("has_surname") | ~F.col("has_patronymic")).drop("full"))
    two = wanted.select("family_id", "spelling", F.explode(F.array_distinct(F.array("a", "b"))).alias("person_id")).distinct()
    at = ["spelling", *of_class]
    again = met.join(members, ["family_id", "person_id"]).select(*at, "person_id").distinct()
    taken = wanted.join(again, at).groupBy(*at).agg(F.count(F.lit(1)).alias("seen"), F.max((F.col("person_id") == F.col("a")).cast("int")).alias("seen_a"), F.max((F.col("person_id") == F.col("b")).cast("int")).alias("seen_b"))
    # at least one of the two was met already and others, that were not, are left
    short = wanted.join(taken, at).where((F.col("seen_a") + F.col("seen_b") > 0) & (F.col("members") > F.col("seen")) & (F.col("members") > 2))
    rest = short.select(*at).join(members, of_class).select("family_id", "spelling", "person_id")
    return met.unionByName(two).unionByName(rest).distinct()


def _kinded(column: str, kind: str) -> Column:
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("k"), t.alias("t")))


def link_mentions(mentions: DataFrame, profiles: DataFrame, known_forms: DataFrame, margin: float = 0.04) -> DataFrame:
    """(mention_id, person_id, cost) of each mention that names exactly one profile of its family.

    ``mentions``: mention_id, family_id, name.
    """
    ship(mentions.sparkSession)
    own = mentions.where("mention_id is not null and family_id is not null and name is not null").select("mention_id", "family_id", "name").distinct()
    texts = materialize(own.select("family_id", "name").distinct().select("family_id", "name", _mention_words("name").alias("words")).where(F.size("words") > 0))
    # people of one family with just the same names are one, counted; nobody among them can be told apart
    parts = materialize(profile_parts(profiles).groupBy("family_id", *PARTS.names).agg(F.min("person_id").alias("person_id"), F.count(F.lit(1)).alias("n")))
    by_name = short_forms(parts, known_forms).select(folded(F.col("given")).alias("f"), "short").distinct()
    more = parts.select("family_id", "person_id", F.explode("givens").alias("given")).select("family_id", "person_id", folded(F.col("given")).alias("f")).join(by_name, "f").groupBy("family_id", "person_id").agg(F.array_sort(F.collect_set("short")).alias("more"))
    people = materialize(parts.join(more, ["family_id", "person_id"], "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>"))))
    given = people.select("family_id", "person_id", F.explode(F.concat(_kinded("givens", "0"), _kinded("shorts", "1"), _kinded("more", "2"))).alias("x")).select("family_id", "person_id", F.col("x.k").alias("level"), F.col("x.t").alias("text")).distinct()
    every = F.concat(_kinded("givens", GIVEN), _kinded("shorts", GIVEN), _kinded("more", GIVEN), _kinded("surnames", SURNAME), _kinded("other_surnames", SURNAME), _kinded("patronymics", PATRONYMIC))
    by_person = people.select("family_id", "n", F.explode(F.array_distinct(every)).alias("x")).select("family_id", "n", F.col("x.k").alias("kind"), F.col("x.t").alias("text"))
    total = people.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    known = by_person.where(F.col("kind") != PATRONYMIC).groupBy(folded(F.col("text")).alias("f")).agg(F.sum("n").alias("n")).join(F.broadcast(total)).where(F.col("n") >= KNOWN_SHARE * F.col("total")).select("f")
    spelled = texts.select("family_id", F.col("name").alias("spelling"), F.explode("words").alias("text")).where(F.length("text") > 1).withColumn("f", folded(F.col("text")))
    seen = materialize(spelled.select("family_id", "text", "f").distinct().join(known.withColumn("known", F.lit(True)), "f", "left").select("family_id", "text", "f", F.coalesce("known", F.lit(False)).alias("known")))
    matches = materialize(trie_join(by_person.select("family_id", "text", "kind").distinct(), seen.select("family_id", "text", "known")))
    known_of = spelled.join(seen.where("known").select("family_id", "text"), ["family_id", "text"]).groupBy("family_id", "spelling").agg(F.collect_set("f").alias("known"))
    words = texts.select("family_id", F.col("name").alias("spelling"), "words").join(known_of, ["family_id", "spelling"], "left")
    full = _candidates(texts, people, given, matches).join(words, ["family_id", "spelling"]).join(people, ["family_id", "person_id"])
    judged = full.select("family_id", "spelling", "person_id", "n", "words", "known", *_PARTS).mapInArrow(_judge, "family_id string, spelling string, person_id string, n bigint, cost double")
    # the two best of a spelling are enough; each task hands on no more than two
    order = Window.partitionBy("family_id", "spelling").orderBy("cost", "person_id")
    best = judged.withColumn("place", F.row_number().over(order)).where("place <= 2").groupBy("family_id", F.col("spelling").alias("name")).agg(F.min(F.struct("cost", "person_id", "n")).alias("first"), F.count(F.lit(1)).alias("many"), F.max("cost").alias("last"))
    clear = best.where((F.col("first.n") == 1) & ((F.col("many") == 1) | (F.col("last") - F.col("first.cost") > margin)))
    return own.join(clear.select("family_id", "name", "first.person_id", "first.cost"), ["family_id", "name"]).select("mention_id", "person_id", "cost")
