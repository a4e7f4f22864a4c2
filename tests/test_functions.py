import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimloom.functions import periods, text, units


def values(spark, rows, build, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(build).collect()]


def test_numbers_scales_currencies(spark):
    cases = {"6,318": 6318, "4,56,789": 456789, "63,177.4": 63177.4, "(1,234.5)": -1234.5, "12.5%": 12.5, "-3.2": -3.2, ".75": 0.75, "no digits here": None, "": None, "−7": -7, "(-7)": 7}
    assert values(spark, [(k,) for k in cases], units.parse_number(F.col("s")), "s string") == list(cases.values())
    scales = {"Crore": 1e7, "mn": 1e6, "Lakhs": 1e5, "250": 250.0, "none": None, "bn": 1e9}
    assert values(spark, [(k,) for k in scales], units.normalize_scale(F.col("s")), "s string") == list(scales.values())
    money = {"Rs.": "INR", "₹": "INR", "us$": "USD", "chf": "CHF", "dollars?": None}
    assert values(spark, [(k,) for k in money], units.normalize_currency(F.col("s")), "s string") == list(money.values())


@pytest.mark.parametrize("a,b,kind,same", [(6318e7, 63177.4e6, "currency", True), (6318e7, 5521e7, "currency", False), (43e7, 427e6, "currency", True), (3.1, 3.2, "ratio", False), (9.4, 7.0, "ratio", False), (2.7, 2.73, "ratio", True), (0.0, 0.0, "count", True)])
def test_tolerance(spark, a, b, kind, same):
    x, y = F.col("a"), F.col("b")
    assert values(spark, [(a, b, kind)], units.relative_difference(x, y) <= units.rounding_tolerance(x, y, F.col("k")), "a double, b double, k string") == [same]


def test_rounding_step_equals_python(spark):
    def python(v):
        s = f"{v:.10f}".rstrip("0")
        if len(s.split(".")[1]):
            return float(f"5e-{len(s.split('.')[1]) + 1}")
        n = str(int(abs(v)))
        return float(f"5e{(len(n) - len(n.rstrip('0')) if n != '0' else 0) - 1}")

    import random

    random.seed(5)
    xs = [0.0, 1.0, 100.0, 1100000000.1, -2.5, 1e-11, 7.0e12] + [round(random.uniform(-1e6, 1e6), random.randint(0, 6)) for _ in range(300)] + [random.uniform(0, 1e9) for _ in range(300)]
    assert values(spark, [(x,) for x in xs], units.rounding_step(F.col("v")), "v double") == [python(x) for x in xs]


PERIODS = {
    "FY24": ("fiscal_year", "2023-04-01", "2024-03-31"), "FY 2023-24": ("fiscal_year", "2023-04-01", "2024-03-31"), "2023-24": ("fiscal_year", "2023-04-01", "2024-03-31"), "the year ended March 31, 2024": ("fiscal_year", "2023-04-01", "2024-03-31"),
    "2024/25": ("fiscal_year", "2024-04-01", "2025-03-31"), "fiscal year 2025": ("fiscal_year", "2024-04-01", "2025-03-31"), "Q4FY24": ("quarter", "2024-01-01", "2024-03-31"), "Q1 FY2025": ("quarter", "2024-04-01", "2024-06-30"),
    "three months ended December 31, 2023": ("quarter", "2023-10-01", "2023-12-31"), "CY2024": ("calendar_year", "2024-01-01", "2024-12-31"), "as at March 31, 2024": ("point", "2024-03-31", "2024-03-31"), "December 31, 2021": ("point", "2021-12-31", "2021-12-31"),
    "nine-month period ended December 31, 2020": ("range", "2020-04-01", "2020-12-31"), "twelve months period ended March 31, 2024": ("fiscal_year", "2023-04-01", "2024-03-31"), "Dec 24": ("month", "2024-12-01", "2024-12-31"), "during the period under review": ("unknown", None, None),
}


def test_periods(spark):
    got = values(spark, [(k,) for k in PERIODS], periods.parse_period(F.col("s")), "s string")
    date = lambda s: s and dt.date.fromisoformat(s)
    assert [(g.kind, g.start, g.end) for g in got] == [(k, date(a), date(b)) for k, a, b in PERIODS.values()]
    us = values(spark, [("FY2024",)], periods.parse_period(F.col("s"), "us_federal"), "s string")[0]
    assert (us.start, us.end) == (dt.date(2023, 10, 1), dt.date(2024, 9, 30))


def test_names_and_claim_keys(spark):
    pairs = [("Acme Limited", "Acme Ltd", True), ("The Acme Co.", "acme", True), ("Acme Limited", "Acme Corp Limited, Northern Branch", False), ("Acme Limited", "Acme USA Inc", False), ("Beta Acme", "Acme Beta Ltd", True)]
    assert values(spark, [p[:2] for p in pairs], text.same_organisation(F.col("a"), F.col("b")), "a string, b string") == [p[2] for p in pairs]
    key = text.claim_key(F.lit("Acme"), F.lit("Revenue"), F.create_map(F.lit("segment"), F.lit("Retail"), F.lit("geography"), F.lit("X")), F.lit(None).cast("string"), F.lit("actual"))
    assert values(spark, [(1,)], key, "x int") == ["acme | revenue | geography=x segment=retail | actual"]
