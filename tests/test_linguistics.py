import pytest
from conftest import rows

from evigraph.operators import linguistics as L

A, B, S = {"mention_id": "a", "name": "Асқар", "source_segment_ids": None}, {"mention_id": "b", "name": "Болат", "source_segment_ids": None}, {"mention_id": "s", "name": "Серік", "source_segment_ids": None}


@pytest.mark.parametrize(("text", "name", "form"), [
    ("Мен Асқарды көрдім", "Асқар", "case"), ("Асқардың ағасы", "Асқар", "genitive"), ("Видел Анну", "Анна", "case"), ("Anna's brother", "Anna", "possessive"),
    ("Анна Мария пришла", "Анна Мария", "exact"), ("Асқаров келді", "Асқар", None), ("", "Асқар", None), ("Асқар", "", None),
])
def test_names_in_their_forms(text, name, form):
    got = L.name_matches(L.tokens(text), name)
    assert [g.info for g in got] == ([form] if form else [])
    assert all(text[g.start : g.end].casefold().startswith(g.text.casefold()[:3]) for g in got)


def test_quotation_scopes():
    assert L.quotation_scopes('a «b» "c" d') == [0, 0, 1, 1, 1, 0, 2, 2, 2, 0, 0]
    assert L.quotation_scopes("a» b")[-1] != 0
    assert L.quotation_scopes("") == []


def test_units_cut_at_switches_and_length():
    text = "Анна пришла, но Пётр ушёл. " + "слово " * 100
    got = L.units(text)
    assert [u.text for u in got][:2] == ["Анна пришла", ", но Пётр ушёл."] or [u.text for u in got][:2] == ["Анна пришла,", "но Пётр ушёл."]
    assert all(u.end - u.start <= 420 and text[u.start : u.end] == u.text for u in got)
    assert L.units("  \n ") == []


@pytest.mark.parametrize(("text", "want"), [
    ("Менің әкем Асқар болатын.", [("parent_child", "speaker", "child", "a", "parent", "kk_my.speaker")]),
    ("Асқардың ағасы Болат келді.", [("sibling", "a", "younger_sibling", "b", "older_sibling", "kk.named")]),
    ("Мой старший брат Болат жил там.", [("sibling", "speaker", "younger_sibling", "b", "older_sibling", "ru.speaker")]),
    ("Моя жена Болат.", [("spouse", "b", "spouse", "speaker", "spouse", "ru.speaker")]),
    ("Мой брат Болат и Асқар.", []), ("Не мой брат Болат.", []), ("Мой брат. Болат пришёл.", []), ("Мой брат сказал: «Болат ушёл».", []), ("Брат Болат.", []),
])
def test_signals(text, want):
    assert L.signals(text, [A, B], "speaker") == want


@pytest.mark.parametrize(("texts", "status"), [
    (["Асқар келді.", "Оның ағасы күлді."], ["resolved"]),
    (["Асқар мен Болат келді.", "Оның ағасы күлді."], ["ambiguous"]),
    (["Асқар мен Болат үйленді.", "Олардың баласы бар."], ["resolved"]),
    (["Асқар келді.", "Ол айтты: «Оның ағасы күлді»."], []),
    (["Асқар келді.", "Кеш болды.", "Оның ағасы күлді."], []),
    (["Асқар келді.", "Оның үйі үлкен."], []),
    ([], []),
])
def test_links(texts, status):
    got = L.links([{"segment_id": f"s{i}", "text": t} for i, t in enumerate(texts)], [A, B])
    assert [g[5] for g in got] == status


def test_frames(spark):
    t = spark.createDataFrame([("r", "Серік", [("s1", "Менің әкем Асқар."), ("s2", None)]), ("q", None, None)], "record string, speaker string, segments array<struct<segment_id:string,text:string>>")
    p = spark.createDataFrame([("r", "a", "Асқар", None), ("r", "s", "Серік", None), ("r", None, "x", None), ("q", "n", None, None)], "record string, mention_id string, name string, source_segment_ids array<string>")
    j = L.with_people(t, p)
    assert rows(L.relationship_signals(j), "record", "subject", "object") == [("r", "s", "a")]
    assert rows(L.name_occurrences(j), "mention_id", "start_char", "end_char") == [("a", 11, 16)]
    assert rows(L.coreference_links(j)) == []
    assert {r[0] for r in rows(L.annotate(t), "kind")} == {"unit", "kinship", "anchor"}
    assert rows(L.annotate(t.limit(0))) == []


def test_variants(spark):
    m = spark.createDataFrame([("r", "m", "Анна", ["анна", "Аня", None, ""]), ("r", "n", None, None)], "record string, mention_id string, name string, aliases array<string>")
    assert rows(L.name_variants(m), "mention_id", "variant_type", "surface") == [("m", "explicit_alias", "Аня"), ("m", "primary", "Анна")]


@pytest.mark.parametrize(("text", "alias", "name", "want"), [
    ("Анна, по прозвищу Аня, жила там.", "Аня", "Анна", True), ("Анна жила там. Пришла Аня, прозвище старое, давно забытое другое.", "Аня", "Анна", True),
    ("Анна пришла, а Вера прозвище дала той самой Ане.", "Аня", "Анна", False), ("Анна и Аня.", "Аня", "Анна", False), ("по прозвищу Аня", "Аня", "Анна", False), ("", "Аня", "Анна", False),
])
def test_alias_cues(text, alias, name, want):
    assert L.alias_linked(text, alias, name) is want


def test_anchor_bundle_numbers_each_once(spark):
    t = spark.createDataFrame([("r", "Серік", [("s1", "Менің әкем Асқар мен Асқар, Қайрат."), ("s2", None)])], "record string, speaker string, segments array<struct<segment_id:string,text:string>>")
    p = spark.createDataFrame([("r", "a", "Асқар", None)], "record string, mention_id string, name string, source_segment_ids array<string>")
    got = rows(L.anchor_bundle(L.with_people(t, p)), "anchor_id", "kind", "surface")
    assert [g[0] for g in got] == [f"anchor_{i:03d}" for i in range(1, len(got) + 1)]
    assert {(k, s) for _, k, s in got} == {("speaker", "Менің"), ("speaker", "әкем"), ("known_person", "Асқар"), ("name_candidate", "Асқар"), ("name_candidate", "Қайрат")}


@pytest.mark.parametrize(("text", "surface", "want"), [
    ("Кажется, Анна уехала.", "Анна", "uncertain"), ("Мне не кажется, Анна уехала.", "Анна", None), ("Без сомнения, возможно, Анна уехала.", "Анна", None),
    ("Кажется, Вера ушла, но Анна уехала.", "Анна", None), ("Возможно, она ушла.", "Анна", "unresolved"), ("Точно не знаю, Анна уехала.", "Анна", "unresolved"),
    ("Он сказал: «Анна уехала».", "Анна", "reported"), ("Анна уехала.", "Анна", None), ("", "Анна", None), ("Мүмкін, Анна кетті.", "Анна", "uncertain"),
])
def test_uncertainty(text, surface, want):
    assert L.scoped_uncertainty(text, surface) == want
    assert all(text[c.start : c.end] == c.text for c in L.clauses(text))
