"""Sentence boundaries: held-out agreement and the defined cases."""

import os

import pytest
from conftest import rows

from evigraph.llm import sentences as S

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    cases = spark.read.parquet(f"{SF}/benchmark_cases.parquet")
    return S.fit(S.training_sample(cases, "case_id", "transcript.segments.text"))


def cut(model, text):
    return [text[a:b] for a, b in S.split(text, model)]


@pytest.mark.parametrize("sentences", [
    ["Бұл оқиға 1973 ж. күзінде болған.", "Жаз шықса жайлауға көшіп, күз түсе қайтатынбыз."],
    ["We took the 6.30 a.m. train to St. Marbury every Monday.", "They finally left around 5 p.m.", "That winter we lost half of the herd."],
    ["«Кел! Отыр!» деп Марат дауыстап шақырды.", "Базардан қамшы, құрт, тұз т.б.", "Балалар өзен жағасында асық ойнайтын."],
    ['"Don\'t hurry! Sit down here!" said Aunt Hester.', "The children played by the river until dark."],
    ["Он получил всего 1.250 руб. за тот год.", "Мы жили в г. Дубровка на ул. Степной, д. 7, кв. 12.", "Поезд ушёл в 06.30 утра."],
])
def test_sentences_with_traps(model, sentences):
    assert cut(model, " ".join(sentences)) == sentences


def test_scripts_without_spaces(model):
    assert cut(model, "那时候……我记不清了。“别着急！坐下吧！”古丽娜阿姨说。他问：“你从哪里来？”然后就不说话了。") == ["那时候……我记不清了。", "“别着急！坐下吧！”古丽娜阿姨说。", "他问：“你从哪里来？”然后就不说话了。"]
    assert cut(model, "妈妈天不亮就起来准备书信　从村里到车站有6.5公里") == ["妈妈天不亮就起来准备书信", "从村里到车站有6.5公里"]


def test_lines_end_sentences_without_marks(model):
    assert cut(model, "Ол шынымен келді ме \nАтам мына үйді салып бітірді\n\nБір күні кеттік") == ["Ол шынымен келді ме", "Атам мына үйді салып бітірді", "Бір күні кеттік"]


def test_offsets_cover_all_but_white_space(model):
    text = "  Поезд ушёл в 06.30 утра.  Это случилось в 1973 г. осенью.\n\n Конец 👍. "
    spans = S.split(text, model)
    assert all(text[a:b] == text[a:b].strip() and a < b for a, b in spans)
    inside = set().union(*(range(a, b) for a, b in spans))
    assert all(text[i].isspace() for i in range(len(text)) if i not in inside)
    assert spans == sorted(spans)


def test_empty_null_and_long(spark, model):
    b = spark.sparkContext.broadcast(model)
    df = spark.createDataFrame([("a", "full_text", None), ("b", "full_text", ""), ("c", "full_text", " \n "), ("d", "full_text", "Ол келді. " * 3000), ("e", "full_text", "x" * 50_000)], "case_id string, field string, text string")
    got = rows(S.sentences(df, b), "case_id", "start_char", "end_char")
    assert {r[0] for r in got} == {"d", "e"} and ("e", 0, 50_000) in got and len(got) > 1000
    assert rows(S.sentences(df.limit(0), b)) == []


def test_no_training_data_still_cuts():
    m = S.fit([])
    assert len(S.split("One. Two.", m)) == 2


def test_quotations():
    assert S.quotations('a "b c" d «e „f“ g» "open') == [(2, 6), (10, 18), (13, 15)] or S.quotations('a "b c"') == [(2, 6)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_reference_and_transcript_agree(spark):
    """Both texts of a case hold the same sentences. Fitted on one half of the cases, counted on the other."""
    cases = spark.read.parquet(f"{SF}/e2e_cases.parquet").where("reference_text is not null").selectExpr("reference_text r", "request.transcript.full_text f", "request.transcript.segments.text s").orderBy("f").collect()
    bench = S.training_sample(spark.read.parquet(f"{SF}/benchmark_cases.parquet"), "case_id", "transcript.segments.text")
    model = S.fit([list(c["s"]) for c in cases[::2]] + bench)
    held = cases[1::2]
    same = sum(len(S.split(c["r"], model)) == len(S.split(c["f"], model)) for c in held)
    assert same / len(held) > 0.95


@pytest.fixture(scope="module")
def project_model(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    cases = spark.read.parquet(f"{SF}/e2e_cases.parquet")
    return S.fit(S.training_sample(cases, "case_id", "request.transcript.segments.text") + S.training_sample(spark.read.parquet(f"{SF}/benchmark_cases.parquet"), "case_id", "transcript.segments.text"))


@pytest.mark.parametrize(("text", "want"), [
    ("This line is hard\nwrapped in the middle. And here is another one that\ngoes on for quite a while until it is\ndone. The end is near\nand then it came.", 3),
    ("Анна пришла домой\nПётр ушёл рано утром и не вернулся\nОна ждала\nПотом уехали", 4),
    ("هل جاء أحمد؟ نعم جاء. ثم ذهب۔ وانتهى", 4), ("គាត់ទៅផ្សារ។ នាងនៅផ្ទះ។", 2), ("እሱ መጣ። እሷ ሄደች።", 2), ("เขาไปตลาด เธออยู่บ้าน", 2),
])
def test_wrapped_lines_and_other_scripts(project_model, text, want):
    assert len(S.split(text, project_model)) == want


def test_the_sample_is_bounded_in_characters(spark):
    df = spark.createDataFrame([(f"k{i}", ["x" * 50, None]) for i in range(20)], "k string, s array<string>")
    assert len(S.training_sample(df, "k", "s", most=10)) == 10 and len(S.training_sample(df, "k", "s", chars=240)) == 4
