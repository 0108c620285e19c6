"""Dates as people say them, to partial ISO dates and bounds, as Column expressions.

The order of the readings decides: an ambiguous numeric date, an ISO date, a day and month with or without a year, a month and
year, a range of years, a decade, an age, a year with or without before / after / about, and before / after alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import lexicon
from evigraph.functions.text import lowered

_MONTH = "|".join(sorted((w for ws in lexicon.MONTHS.values() for w in ws), key=lambda w: (-len(w), w)))
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_YEAR = "1[5-9][0-9]{2}|20[0-9]{2}|21[0-9]{2}"


def _pattern(body: str) -> str:
    return _EDGE + body + _END


AMBIGUOUS = _pattern(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}")
ISO = _pattern(r"([0-9]{4})-([0-9]{2})-([0-9]{2})")
DAY_MONTH = _pattern(rf"([0-9]{{1,2}})\s+({_MONTH})(?:\s+([0-9]{{4}}))?")
MONTH_YEAR = _pattern(rf"({_MONTH})\s+([0-9]{{4}})")
RANGE = _pattern(r"(1[5-9][0-9]{2}|20[0-9]{2})\s*(?:-|–|—|и|мен)\s*(1[5-9][0-9]{2}|20[0-9]{2})")
AGE = _pattern(r"(?:когда\s+(?:ему|ей)\s+было\s+(?:лет\s+)?[0-9]{1,3}|[0-9]{1,3}\s+жасында)")
YEAR = _pattern(f"({_YEAR})")
ABOUT, BEFORE, AFTER = ("примерно", "около", "приблизительно", "шамамен", "шамасы", "сияқты"), ("до", "дейін", "бұрын"), ("после", "кейін", "соң")


def _stems(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(" ", r"\s+") for w in words)


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has the last word of one of ``words`` anywhere; without it no pattern of them can match, and this is far cheaper."""
    return reduce(Column.__or__, (F.contains(text, F.lit(w.split(" ")[-1])) for w in words))


def _has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has one of ``words`` as a whole word."""
    return _holds(text, words) & text.rlike(_pattern(f"(?:{'|'.join(words)})"))


def iso(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """A partial ISO date."""
    out = F.lpad(year.cast("string"), 4, "0")
    for part in (month, day):
        if part is not None:
            out = F.concat(out, F.lit("-"), F.lpad(part.cast("string"), 2, "0"))
    return out


def is_date(text: Column) -> Column:
    """Whether an ISO text is a day of the calendar."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull() & text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))


def month_number(word: Column) -> Column:
    """The number of a month's word, or null; a lookup in one literal map."""
    pairs = [F.lit(x) for n, ws in lexicon.MONTHS.items() for w in ws for x in (w, n)]
    return F.try_element_at(F.create_map(*pairs), word)


def decade(text: Column) -> Column:
    """The first year of the decade that a text names, else null."""
    return F.coalesce(*(F.when(_holds(text, ws) & text.rlike(_EDGE + f"(?:{_stems(ws)})"), F.lit(base)) for base, ws in lexicon.DECADES.items()))


def decade_bounds(base: Column, text: Column) -> tuple[Column, Column]:
    """First and last day of a decade, or of the part of it that a text names."""
    low, high = F.lit(0), F.lit(9)
    for a, b, ws in lexicon.DECADE_PARTS.values():
        hit = text.rlike(_pattern(f"(?:{'|'.join(ws)})"))
        low, high = F.when(hit, F.lit(a)).otherwise(low), F.when(hit, F.lit(b)).otherwise(high)
    return iso(base + low), F.concat(iso(base + high), F.lit("-12-31"))


FIELDS = ("kind", "value", "lower_bound", "upper_bound", "approximate", "issue")


def with_dates(rows: DataFrame, expression: str) -> DataFrame:
    """``rows`` with kind, value, lower_bound, upper_bound, approximate and issue of an expression; null stays null.

    In three projections: what the patterns find, which reading comes first, and what it means. One projection would hold
    every pattern many times over and be too large for generated code.
    """
    x = F.col("_x")
    # all that is extracted holds a digit
    got = lambda pattern, i: F.when(F.col("_digit"), F.nullif(F.regexp_extract(x, pattern, i), F.lit("")))
    found = {
        "_iso": F.concat_ws("-", got(ISO, 1), got(ISO, 2), got(ISO, 3)),
        "_day": got(DAY_MONTH, 1).try_cast("int"),
        "_month": month_number(got(DAY_MONTH, 2)),
        "_dm_year": got(DAY_MONTH, 3),
        "_m2": month_number(got(MONTH_YEAR, 1)),
        "_y2": got(MONTH_YEAR, 2),
        "_from": got(RANGE, 1),
        "_to": got(RANGE, 2),
        "_base": decade(x),
        "_year": got(YEAR, 1).try_cast("int"),
        "_about": _has(x, ABOUT),
        "_before": _has(x, BEFORE),
        "_after": _has(x, AFTER),
    }
    rows = rows.withColumn("_x", lowered(F.trim(expression))).withColumn("_digit", x.rlike("[0-9]")).withColumns(found)
    c = F.col
    full, month_year = iso(c("_dm_year"), c("_month"), c("_day")), iso(c("_y2"), c("_m2"))
    low, high = decade_bounds(c("_base"), x)
    end = lambda y: F.concat(y, F.lit("-12-31"))
    readings: list[tuple[Column, dict]] = [
        (x == "", {"kind": "invalid", "issue": "temporal_value_invalid"}),
        (c("_digit") & x.rlike(AMBIGUOUS), {"kind": "unknown", "issue": "temporal_format_ambiguous"}),
        ((c("_iso") != "") & is_date(c("_iso")), {"kind": "exact_date", "value": c("_iso")}),
        (c("_iso") != "", {"kind": "invalid", "issue": "temporal_value_invalid"}),
        (c("_day").isNotNull() & c("_dm_year").isNull(), {"kind": "relative", "issue": "temporal_anchor_missing"}),
        (c("_day").isNotNull() & is_date(full), {"kind": "exact_date", "value": full}),
        (c("_day").isNotNull(), {"kind": "invalid", "issue": "temporal_value_invalid"}),
        (c("_m2").isNotNull() & c("_about"), {"kind": "approximate", "value": month_year, "lower_bound": F.concat(month_year, F.lit("-01")), "upper_bound": F.date_format(F.last_day(F.try_to_date(F.concat(month_year, F.lit("-01")), "yyyy-MM-dd")), "yyyy-MM-dd"), "approximate": True}),
        (c("_m2").isNotNull(), {"kind": "month_year", "value": month_year}),
        (c("_from") > c("_to"), {"kind": "invalid", "issue": "temporal_range_invalid"}),
        (c("_from").isNotNull(), {"kind": "range", "lower_bound": c("_from"), "upper_bound": end(c("_to"))}),
        (c("_base").isNotNull(), {"kind": "decade", "lower_bound": low, "upper_bound": high, "approximate": True}),
        (c("_digit") & x.rlike(AGE), {"kind": "relative", "issue": "temporal_anchor_missing"}),
        (c("_year").isNotNull() & c("_before"), {"kind": "relative", "upper_bound": end(iso(c("_year") - 1)), "issue": "temporal_anchor_missing"}),
        (c("_year").isNotNull() & c("_after"), {"kind": "relative", "lower_bound": iso(c("_year") + 1), "issue": "temporal_anchor_missing"}),
        (c("_year").isNotNull() & c("_about"), {"kind": "approximate", "value": iso(c("_year")), "lower_bound": iso(c("_year") - 1), "upper_bound": end(iso(c("_year") + 1)), "approximate": True}),
        (c("_year").isNotNull(), {"kind": "year", "value": iso(c("_year"))}),
        (c("_before") | c("_after"), {"kind": "relative", "issue": "temporal_anchor_missing"}),
        (x.isNotNull(), {"kind": "unknown", "issue": "temporal_expression_unresolved"}),
    ]
    rows = rows.withColumn("_n", F.coalesce(*(F.when(cond, F.lit(i)) for i, (cond, _) in enumerate(readings))))
    out = {}
    for f in FIELDS:
        value = F.lit(False if f == "approximate" else None).cast("boolean" if f == "approximate" else "string")
        for i, (_, fields) in enumerate(readings):
            if f in fields:
                v = fields[f]
                value = F.when(F.col("_n") == i, v if isinstance(v, Column) else F.lit(v)).otherwise(value)
        out[f] = F.when(F.col("_n").isNotNull(), value)
    return rows.withColumns(out).drop("_x", "_n", "_digit", *found)


def occurs_in(expression: Column, evidence: Column) -> Column:
    """Whether an expression stands in its evidence, read without case, ё and extra white space."""
    from evigraph.functions.text import collapse

    return F.contains(collapse(evidence), collapse(expression)) & (collapse(expression) != "")


def relationship_state(c: Column) -> Column:
    """current, former, ended, negated, figurative or unresolved, by what a text says of a relationship."""
    x = lowered(c)
    out = F.lit("current")
    for name, patterns in reversed(lexicon.RELATIONSHIP_STATES):
        out = F.when(x.rlike(_pattern(f"(?:{'|'.join(patterns)})")), name).otherwise(out)
    return F.when(c.isNull(), F.lit(None)).otherwise(out)
