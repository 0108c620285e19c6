"""One form for equal-looking texts, and pairs against brute force."""

import random
import unicodedata

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import lookalike as K

T = K.transducer()
ZWSP, SHY, BOM, NBSP, IDEO = "​", "­", "﻿", " ", "　"


@pytest.mark.parametrize(("a", "b"), [
    ("Аnna", "Anna"), ("ＡＢ１", "AB1"), ("й", "й"), ("ё", "ё"), (f"и{ZWSP}̆", "й"), ("ç", "ç"), ("с̧", "ç"), ("が", "が"),
    (f"a{NBSP}b", "a b"), (f"a {IDEO} b", "a b"), (f"{BOM} a{SHY}b ", "ab"), ("Ρо", "Po"), ("ν", "v"), ("һаt", "hat"), ("Ә", "Ə"), (f"a{ZWSP} {SHY}b", "a b"),
])
def test_equal_looks(a, b):
    assert T.apply(a) == T.apply(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("Кулпаш", "Күлпаш"), ("е", "ё"), ("и", "й"), ("ab", "a b"), ("о", "0"), ("ı", "i"), ("қ", "к")])
def test_different_looks(a, b):
    assert T.apply(a) != T.apply(b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=32, max_codepoint=0x530), st.sampled_from("ＡｂёйкәΑό̈​　かが।ऩ")), max_size=30))
def test_the_form_of_a_form_is_itself(text):
    once = T.apply(text)
    assert T.apply(once) == once
    assert T.apply(unicodedata.normalize("NFD", text)) == T.apply(unicodedata.normalize("NFC", text))


def test_table_has_no_conflicts(monkeypatch):
    K.build_table()
    monkeypatch.setattr(K, "CYRILLIC_LIKE", K.CYRILLIC_LIKE + "ѡ")
    monkeypatch.setattr(K, "CYRILLIC_AS", K.CYRILLIC_AS + "w")
    with pytest.raises(ValueError, match="become equal"):
        K.build_table()


def test_pairs_match_brute_force(spark):
    rng = random.Random(4)
    data = []
    for i in range(120):
        word = rng.choice(["Сара", "Орка", "Тест", "", "  "])
        word = "".join(rng.choice([c, {"а": "a", "р": "p", "О": "O", "Т": "T", "е": "e", "с": "c"}.get(c, c)]) + rng.choice(["", "", ZWSP]) for c in word)
        data.append((f"k{i:03d}", rng.choice(["f1", "f2"]), rng.choice([word, word, None])))
    data += data[:10] + [(None, "f1", "Сара"), ("kx", None, "Сара")]
    want = sorted({(a, b) for a, f, s in data for b, g, t in data if a and b and f and f == g and s is not None and t is not None and a < b and s != t and T.apply(s) == T.apply(t)})
    df = spark.createDataFrame(data, "id string, fam string, name string").selectExpr("id", "fam", "name", "'x' as form", "1 as key")
    got = rows(K.equal_looking(df, "id", "fam", "name"))
    assert got == want
    assert rows(K.equal_looking(df.limit(0), "id", "fam", "name")) == []


def test_unified_column(spark):
    df = spark.createDataFrame([("a", "Аb"), ("b", None), ("c", "")], "id string, t string")
    assert {r["id"]: r["form"] for r in K.unified(df, "t").collect()} == {"a": "Ab", "b": None, "c": ""}


@pytest.mark.parametrize(("a", "b"), [
    ("ｶﾞ", "ガ"), ("ﾊﾟﾝ", "パン"), ("\u1112\u1161\u11ab", "한"), ("\u1100\u1161", "가"), ("\u0627\u0653", "آ"), ("ﬁn", "fin"), ("ﬃ", "ffi"), ("ρ", "p"), ("ѵ", "v"), ("Ꭺnna", "Anna"), ("օ", "o"), ("Ⅳ", "IV"),
    ("\u0958", "\u0915\u093c"), ("\u212b", "Å"), ("A\u030a", "\u212b"), ("\u0435\u0300", "\u00e8"), ("\uf900", "\u8c48"), ("e\u0323\u0302", "\u1ec7"), ("e\u0302\u0323", "\u1ec7"), ("a\u200d\u0301", "\u00e1"), ("\u05d0\u05b7", "\ufb2e"), ("①", "①"), ("ﾞ", "\u3099"),
])
def test_written_by_hand_what_looks_the_same(a, b):
    apply = T.apply
    assert apply(a) == apply(b) and apply(apply(a)) == apply(a)


@pytest.mark.parametrize(("a", "b"), [("У", "Ү"), ("’", "'"), ("①", "1"), ("\U0001d400", "A"), ("x²", "x2"), ("é", "e"), ("й", "и"), ("A", "a"), ("が", "か"), ("ё", "е"), ("ı", "i")])
def test_written_by_hand_what_stays_distinct(a, b):
    apply = T.apply
    assert apply(a) != apply(b)


def test_class_rows(spark):
    df = spark.createDataFrame([("a", "g", "Анна"), ("b", "g", "Aннa"), ("c", "g", "Анна"), ("d", "g", "Вера"), ("e", "h", "Aннa"), ("f", "g", None), (None, "g", "Aннa"), ("b", "g", "Aннa")], "k string, g string, t string")
    assert rows(K.form_classes(df, "k", "g", "t")) == [("a", "a", 2, 3), ("b", "a", 2, 3), ("c", "a", 2, 3)]
    assert rows(K.form_classes(df.limit(0), "k", "g", "t")) == []
