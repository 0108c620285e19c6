"""Held-out accuracy of the language operator, and its defined cases."""

import os
import random

import pytest
from conftest import rows

from evigraph.llm import language as L

SF = "/root/testdata/sf0.01"
WORDS = {
    "xx": ["balo", "kira", "toman", "sure", "velo", "dagu"],
    "yy": ["qurt", "zhan", "oiyn", "beki", "shot", "ulgi"],
    "zz": ["你", "好", "山", "水", "人"],
}


def sample(rng, lang, n=12):
    sep = "" if lang == "zz" else " "
    return sep.join(rng.choice(WORDS[lang]) for _ in range(n))


def model(noise=0.2, n=120):
    rng = random.Random(1)
    data = []
    for i in range(n):
        lang = ("xx", "yy", "zz")[i % 3]
        label = rng.choice(("xx", "yy", "zz")) if rng.random() < noise else lang
        data.append((label, "\n\n".join(sample(rng, lang) for _ in range(2))))
    return L.fit_labelled(data, ["xx", "yy", "zz"])


def decide(m, texts):
    totals, n = L.Scorer(m).score(texts)
    return L.decide(totals, n, m)


def test_wrong_labels_do_not_matter():
    rng = random.Random(9)
    m = model()
    texts = [(lang, sample(rng, lang)) for lang in ("xx", "yy", "zz") for _ in range(30)]
    got, confidence = decide(m, [t for _, t in texts])
    assert got == [lang for lang, _ in texts]
    assert confidence.min() > 0.5


def test_unknown_words_back_off_to_letters():
    got, _ = decide(model(), ["balotoman kirasure", "qurtzhan oiynbeki"])
    assert got == ["xx", "yy"]


def test_look_alike_letters_do_not_matter():
    got, _ = decide(model(), ["bаlо kirа tоman", "ｋｉｒａ ｂａｌｏ"])
    assert got == ["xx", "xx"]


def test_no_letters_no_language():
    got, confidence = decide(model(), ["123 456", "", "?!"])
    assert got == [None, None, None] and confidence.tolist() == [0, 0, 0]


def test_scores_do_not_depend_on_batches_or_memory():
    m = model()
    texts = ["balo kira", "qurt", "你好", "", "balo qurt"]
    whole = L.Scorer(m).score(texts)[0]
    small = L.Scorer(m, keep=2)
    assert [small.score([t])[0][0].tolist() for t in texts] == whole.tolist()


def test_pieces_and_labels(spark):
    b = spark.sparkContext.broadcast(model())
    df = spark.createDataFrame([("r1", ["balo kira toman", None, "  ", "qurt zhan beki"]), ("r2", None), ("r3", []), ("r4", ["12"])], "id string, parts array<string>")
    pieces = L.label_pieces(df, "t", "id", "parts", b)
    assert rows(pieces, "record_id", "piece", "lang")[:2] == [("r1", 1, "xx"), ("r1", 4, "yy")]
    labels = spark.createDataFrame([("t", "r1", ["xx"]), ("t", "r4", [])], "source string, record_id string, named array<string>")
    assert rows(L.mislabelled(pieces, labels)) == [("t", "r1", 4, "yy")]
    by = rows(L.by_record(pieces), "record_id", "lang", "n_pieces", "n_languages")
    assert by == [("r1", "xx", 2, 2)]


def test_empty_sample(spark):
    m = L.fit_labelled([], ["xx", "yy"])
    got, _ = decide(m, ["balo", ""])
    assert got[1] is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_documents(spark):
    """Fitted on half of the labelled documents, most labels of the other half agree; those that do not are wrong labels."""
    codes = ["de", "en", "hi", "ja", "kk", "ru", "tr", "zh"]
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and length(text) > 40").orderBy("doc_id").collect() if r["lang"] in codes]
    m = L.fit_labelled(docs[::2], codes)
    held = [(lang, t) for lang, t in docs[1::2] if "\n\n" not in t]
    got, _ = decide(m, [t for _, t in held])
    assert sum(g == lang for g, (lang, _) in zip(got, held, strict=True)) / len(held) > 0.85


@pytest.fixture(scope="module")
def project(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    codes = sorted(r[0] for r in spark.read.parquet(f"{SF}/language_codes.parquet").select("lang").collect())
    return L.fit_labelled(L.training_sample(docs, codes), codes)


@pytest.mark.parametrize("text", [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan.", "Tất cả mọi người sinh ra đều được tự do và bình đẳng.",
    "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกัน", "Tous les êtres humains naissent libres et égaux en dignité.",
])
def test_a_language_outside_the_table_is_not_trusted(project, text):
    assert decide(project, [text])[1][0] < 0.5


def test_a_piece_that_changes_its_language_is_cut_there(project):
    text = "Мой дед родился в деревне и всю жизнь работал в колхозе. My grandmother was born in the city and she worked at the post office."
    scorer = L.Scorer(project)
    parts = L.segments(text, scorer)
    assert [project.codes[k] for _, _, k in parts] == ["ru", "en"] and text[parts[1][0] :].startswith("My") and parts[0][0] == 0 and parts[-1][1] == len(text)
    assert L.changes([L.words_of(text), L.words_of(text[:56]), []], scorer) == [True, False, False]
    assert L.segments("", scorer) == [] and L.segments("123", scorer) == []


def test_confidence_is_borne_out(project):
    rows_ = L.reliability(project, ["en", "ru", "en"], ["My grandfather came home", "Дед вернулся домой", "Atam üyge keldi"])
    assert sum(n for _, n, _, _ in rows_) == 3 and all(0 <= r <= 1 for *_, r in rows_)
