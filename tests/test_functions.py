import hashlib

import pytest
from pyspark.sql import functions as F

from evigraph.functions import temporal
from evigraph.functions import text as X


def one(spark, values, schema, column):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("statement", "evidence", "status"), [
    ("он жил в ауле", "Раньше он жил в ауле.", "exact"),
    ("потому жил в ауле", "жил долго в ауле", "adds_causality"),
    ("жил там в ауле", "не жил там в этом ауле", "drops_negation"),
    ("жил в городе", "жил в ауле", "unsupported"),
    ("жил ауле", "жил долго ауле", "ordered"),
    ("ауле жил", "жил долго ауле", "role_order_changed"),
    ("", "текст", "unsupported"),
])
def test_support(spark, statement, evidence, status):
    assert one(spark, (statement, evidence), "a string, b string", X.support(F.col("a"), F.col("b"))) == status


def test_occurrences(spark):
    place = lambda t, p: one(spark, (t, p), "a string, b string", X.occurrences(F.col("a"), F.col("b")))
    assert place("ааа", "аа") == [0, 1]
    assert place("a", "abc") == [] and place("", "a") == [] and place("abc", "") == []


def test_normal_forms_and_ids(spark):
    assert one(spark, ("Анна-Мария (Ё)_1",), "a string", X.normalize(F.col("a"))) == "анна мария ё 1"
    assert one(spark, ("Анна-Мария_1",), "a string", X.name_key(F.col("a"))) == "аннамария_1"
    assert one(spark, ("Ёлка \t\n И",), "a string", X.collapse(F.col("a"))) == "елка и"
    assert one(spark, (None,), "a string", X.normalize(F.col("a"))) is None
    want = "p_" + hashlib.sha256("x\x1f\x1fy".encode()).hexdigest()[:32]
    assert one(spark, ("x", None, "y"), "a string, b string, c string", X.stable_id("p", F.col("a"), F.col("b"), F.col("c"))) == want
    assert one(spark, ("ＡＢß",), "a string", X.casefolded(F.col("a"))) == "abss"


def test_statements_and_script(spark):
    assert one(spark, ("Один. Два!\nТри… ",), "a string", X.statements(F.col("a"))) == ["Один.", "Два!", "Три…"]
    assert one(spark, ("",), "a string", X.statements(F.col("a"))) == []
    assert [one(spark, (t,), "a string", X.script(F.col("a"))) for t in ("Анна", "Anna", "Aнна", "中")] == ["cyrillic", "latin", "mixed", "other"]


def test_sensitivity(spark):
    got = one(spark, ("Он умер, потом был суд",), "a string", X.sensitivity(F.col("a")))
    assert got["level"] == "sensitive" and got["categories"] == ["health_or_death", "legal_or_financial"]
    assert one(spark, ("наркотики и суд",), "a string", X.sensitivity(F.col("a")))["level"] == "highly_sensitive"
    assert one(spark, ("",), "a string", X.sensitivity(F.col("a")))["level"] == "normal"


@pytest.mark.parametrize(("text", "kind", "value", "low", "high"), [
    ("1943-05-12", "exact_date", "1943-05-12", None, None),
    ("1943-02-30", "invalid", None, None, None),
    ("9 мая 1945 года", "exact_date", "1945-05-09", None, None),
    ("9 мая", "relative", None, None, None),
    ("март 1953", "month_year", "1953-03", None, None),
    ("около февраля 1960", "approximate", "1960-02", "1960-02-01", "1960-02-29"),
    ("1941-1945", "range", None, "1941", "1945-12-31"),
    ("в конце восьмидесятых", "decade", None, "1987", "1989-12-31"),
    ("тоқсаныншы жылдардың басында", "decade", None, "1990", "1993-12-31"),
    ("до 1950", "relative", None, None, "1949-12-31"),
    ("1950 жылдан кейін", "relative", None, "1951", None),
    ("шамамен 1937", "approximate", "1937", "1936", "1938-12-31"),
    ("1937 год", "year", "1937", None, None),
    ("12/05/1943", "unknown", None, None, None),
    ("давно", "unknown", None, None, None),
    ("", "invalid", None, None, None),
    (None, None, None, None, None),
])
def test_dates(spark, text, kind, value, low, high):
    r = temporal.with_dates(spark.createDataFrame([(text,)], "e string"), "e").first()
    assert (r["kind"], r["value"], r["lower_bound"], r["upper_bound"]) == (kind, value, low, high)


def test_dates_stay_in_generated_code(spark):
    plan = temporal.with_dates(spark.createDataFrame([("1950",)], "e string"), "e")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize(("text", "state"), [("бывший муж", "former"), ("они развелись", "ended"), ("не мой брат", "negated"), ("как родной брат", "figurative"), ("не не брат", "unresolved"), ("сестра", "current"), (None, None)])
def test_states(spark, text, state):
    assert one(spark, (text,), "a string", temporal.relationship_state(F.col("a"))) == state


def test_titles_questions_and_openness(spark):
    get = lambda c: one(spark, ("свадьба в Алматы", "он жил в ауле и не уехал", ["свадьба", "Алматы"]), "t string, e string, a array<string>", c)
    t, e, a = F.col("t"), F.col("e"), F.col("a")
    assert get(X.title_supported(t, e, a)) is True and get(X.title_supported(t, e, F.array(F.lit("свадьба")))) is False
    assert get(X.question_adds_facts(F.lit("кто жил в ауле"), e)) is False and get(X.question_adds_facts(F.lit("кто пришёл"), e)) is True
    assert get(X.is_open(F.lit("Не помню, кажется"))) is True and get(X.is_open(e)) is False
    assert get(X.drops_negation(F.lit("он уехал"), e)) is True and get(X.drops_negation(F.lit("не уехал"), e)) is False
    assert get(X.all_supported(F.lit("Он жил в ауле. Не уехал."), e)) is True and get(X.all_supported(F.lit(""), e)) is False
