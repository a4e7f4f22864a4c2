"""Queries of numbers, units, periods and normalisation: surfaces dealt over the rows of a table, results known beforehand.

The SQL never parses: it has the values that a reader of the surface would write down, or dates built from numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import periods, text, units, unittext
from claimloom.operators import normalize
from claimloom.plans.base import query, rows_of


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return repr(float(x)) + "::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _known(cases: list[tuple], names: list[str], kinds: list[str]) -> str:
    """SQL: each order with the known values of its case."""
    rows = ", ".join(f"({i}, {', '.join(_literal(x) for x in c)})" for i, c in enumerate(cases))
    cols = ", ".join(f"CAST(e.{n} AS {k}) AS {n}" for n, k in zip(names, kinds))
    return f"SELECT o_orderkey, {cols} FROM orders JOIN (VALUES {rows}) e(i, {', '.join(names)}) ON o_orderkey % {len(cases)} = e.i"


def _dealt(spark, sf, cases: list[tuple], names: list[str], kinds: list[str]) -> DataFrame:
    """Each order with the surfaces of its case."""
    orders = rows_of(spark, sf, "orders").select("o_orderkey")
    at = (F.col("o_orderkey") % len(cases)).cast("int")
    pick = lambda j, kind: F.get(F.array(*[F.lit(c[j]).cast(kind) for c in cases]), at)
    return orders.select("o_orderkey", *[pick(j, k).alias(n) for j, (n, k) in enumerate(zip(names, kinds))])


NUMBERS = [
    ("8,210", 8210.0), ("1,23,456", 123456.0), ("12,34,56,789.5", 123456789.5), ("(1,200.25)", -1200.25), ("-(7)", 7.0), ("( 3 )", -3.0), ("(-4)", 4.0), ("−5.5", -5.5), ("+6", 6.0), ("- 9", -9.0), (".75", 0.75), ("1,2", 1.0),
    ("grew 14.5% to 20", 14.5), ("none", None), ("", None), (None, None), ("US$ 3.2bn", 3.2), ("1,234,567", 1234567.0), ("a (12) b", 12.0), ("0", 0.0),
]


@query(_known([(v,) for _, v in NUMBERS], ["value"], ["DOUBLE"]))
def parse_number_forms(spark, sf):
    """UNT-1 over written forms: grouping, signs, brackets, decimals, text around."""
    return _dealt(spark, sf, NUMBERS, ["s"], ["string"]).select("o_orderkey", units.parse_number(F.col("s")).alias("value"))


_MONEY_WORDS = [(k, v) for k, v in units.CURRENCIES.items()] + [("CHF", "CHF"), ("sek.", "SEK"), ("mio", None), ("xyz", None), ("", None), (None, None), ("dollars?", None)]
_SCALE_WORDS = [(k, v) for k, v in units.SCALES.items()] + [("'000", 1000.0), ("Crores.", 1e7), ("250 boxes", 250.0), ("-3", None), ("many", None), (None, None)]
_UNIT_WORDS = [(k, *v) for k, v in units.SIMPLE_UNITS.items()] + [("hectares ", "sqm", "area", 10000.0), ("gwhs", "kwh", "energy", 1e6), ("furlong", None, None, None)]


@query(_known([(v,) for _, v in _MONEY_WORDS], ["currency"], ["VARCHAR"]))
def normalize_currency_all(spark, sf):
    """UNT-2 over every alias, in other letter case and with spaces around."""
    return _dealt(spark, sf, _MONEY_WORDS, ["s"], ["string"]).select("o_orderkey", units.normalize_currency(F.concat(F.lit(" "), F.initcap("s"), F.lit(" "))).alias("currency"))


@query(_known([(v,) for _, v in _SCALE_WORDS], ["scale"], ["DOUBLE"]))
def normalize_scale_all(spark, sf):
    """UNT-3 over every alias."""
    return _dealt(spark, sf, _SCALE_WORDS, ["s"], ["string"]).select("o_orderkey", units.normalize_scale(F.concat(F.lit(" "), F.upper("s"))).alias("scale"))


@query(_known([c[1:] for c in _UNIT_WORDS], ["canonical", "unit_class", "factor"], ["VARCHAR", "VARCHAR", "DOUBLE"]))
def normalize_units_all(spark, sf):
    """UNT-6 over every simple unit."""
    return _dealt(spark, sf, _UNIT_WORDS, ["s"], ["string"]).withColumn("u", units.simple_unit(F.upper("s"))).select("o_orderkey", "u.canonical", "u.unit_class", "u.factor")


#: unit, scale, currency → canonical, class, factor, currency, bare scale.
RESOLVED = [
    ("₹ crore", None, None, "INR crore", "currency", 1e7, "INR", False), ("Rs. in lakhs", None, None, "INR lakh", "currency", 1e5, "INR", False), ("million", None, "usd", "USD million", "currency", 1e6, "USD", False), ("Mn shipments", None, None, "shipment", "count", 1e6, None, False),
    ("'000 Tons", None, None, "kg", "mass", 1e6, None, False), ("facilities", None, None, "facility", "count", 1.0, None, False), ("branches", 1000.0, None, "branche", "count", 1000.0, None, False), ("teu", None, None, "teu", "other:teu", 1.0, None, False),
    ("lakh crore", None, "INR", "INR trillion", "currency", 1e12, "INR", False), ("million", None, None, "million", "count", 1e6, None, True), ("", None, None, None, None, None, None, False), (None, None, "eur", "EUR", "currency", 1.0, "EUR", False),
    ("%", None, None, "%", "ratio", 1.0, None, False), ("percentage points", None, None, "pp", "ratio_change", 1.0, None, False), ("sq m", None, None, "sqm", "area", 1.0, None, False), ("(in days)", None, None, "day", "duration", 1.0, None, False), ("ratio", None, None, "ratio", "ratio", 100.0, None, False),
    ("250 boxes", None, None, "boxes", "other:boxe", 250.0, None, False), ("k hundred", None, None, "lakh", "count", 1e5, None, True), ("hundred", 70.0, None, "x7000", "count", 7000.0, None, True), ("units", None, None, "unit", "count", 1.0, None, False), ("people", 1e6, None, "people", "count", 1e6, None, False),
]


@query(_known([c[3:] for c in RESOLVED], ["canonical", "unit_class", "factor", "currency", "bare"], ["VARCHAR", "VARCHAR", "DOUBLE", "VARCHAR", "BOOLEAN"]))
def resolve_unit_forms(spark, sf):
    """UNT-5, UNT-7..9."""
    rows = _dealt(spark, sf, RESOLVED, ["s", "f", "m"], ["string", "double", "string"]).withColumn("u", unittext.resolve_unit(F.col("s"), F.col("f"), F.col("m")))
    return rows.select("o_orderkey", "u.canonical", "u.unit_class", "u.factor", "u.currency", units.is_bare_scale(F.col("u")).alias("bare"))


#: two units → comparable, key of the first, base value of 2.5 in the first.
COMPARED = [("₹ crore", "Rs lakh", True, "currency:INR", 2.5e7), ("US$ mn", "₹ mn", False, "currency:USD", 2.5e6), ("km", "miles", True, "distance", 2500.0), ("days", "%", False, "duration", 2.5), ("teu", "teus", True, "other:teu", 2.5), ("", "%", False, "", None), ("bps", "pp", True, "ratio_change", 0.025)]


@query(_known([c[2:] for c in COMPARED], ["same", "key", "base"], ["BOOLEAN", "VARCHAR", "DOUBLE"]))
def units_comparable(spark, sf):
    """UNT-14."""
    rows = _dealt(spark, sf, COMPARED, ["a", "b"], ["string", "string"]).select("o_orderkey", unittext.resolve_unit(F.col("a")).alias("a"), unittext.resolve_unit(F.col("b")).alias("b"))
    return rows.select("o_orderkey", units.comparable(F.col("a"), F.col("b")).alias("same"), units.comparison_key(F.col("a")).alias("key"), units.to_base(F.lit(2.5), F.col("a")).alias("base"))


DECLARED = [
    ("(All sums are in Indian Rupees in million, unless said otherwise)", "INR", 1e6), ("(₹ in crore)", "INR", 1e7), ("Rs. in lakhs", "INR", 1e5), ("Table 4 (US$ billion)", "USD", 1e9), ("all figures in thousands", None, 1e3), ("a total of 5,000 was done", None, None),
    ("in thousands here, but (€ in crore) there", "EUR", 1e7), ("Rs '000", "INR", 1e3), ("Notes to the accounts", None, None), ("", None, None), (None, None, None), ("x" * 2100 + " ₹ in crore", None, None),
]


@query(_known([c[1:] for c in DECLARED], ["currency", "scale"], ["VARCHAR", "DOUBLE"]))
def unit_declaration(spark, sf):
    """UNT-4."""
    return _dealt(spark, sf, DECLARED, ["s"], ["string"]).withColumn("u", unittext.declared_unit(F.col("s"))).select("o_orderkey", "u.currency", "u.scale")


# Periods: labels written from y, q, h and a date; the SQL builds the interval from the same numbers.
_CONVENTIONS = ("india", "calendar", "us_federal", "uk")
_FS = "make_date({0} - CASE WHEN cm = 1 THEN 0 ELSE 1 END, cm, 1)"
_FE = "CAST(" + _FS + " + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE)"
_QUARTER = ("'quarter'", f"CAST({_FS.format('y')} + to_months(3 * (q - 1)) AS DATE)", f"CAST({_FS.format('y')} + to_months(3 * q) - INTERVAL 1 DAY AS DATE)")
_HALF = ("'half'", f"CAST({_FS.format('y')} + to_months(6 * (h - 1)) AS DATE)", f"CAST({_FS.format('y')} + to_months(6 * h) - INTERVAL 1 DAY AS DATE)")
_YEAR = ("'fiscal_year'", _FS.format("y"), _FE.format("y"))
_DAY, _MONTH_OF = ("'point'", "d", "d"), ("'month'", "CAST(date_trunc('month', d) AS DATE)", "last_day(d)")
_CALENDAR = ("'calendar_year'", "make_date(y, 1, 1)", "make_date(y, 12, 31)")
_ENDED = lambda kind, n: (f"'{kind}'", f"CAST(date_trunc('month', d) - INTERVAL {n - 1} MONTH AS DATE)", "d")
FORMS = [
    ("concat('Q', q, ' FY', y)", *_QUARTER), ("concat('q', q, 'fy', yy)", *_QUARTER), ("concat('FY', yy, ' Q', q)", *_QUARTER), ("concat('Q', q, ' ', y - 1, '-', yy)", *_QUARTER), ("concat('Q', q, '/', y)", *_QUARTER),
    ("concat(element_at(array('first', 'second', '3rd', 'Fourth'), q), ' quarter of the  FY', yy)", *_QUARTER), ("concat('H', h, ' ', y - 1, '-', yy)", *_HALF), ("concat('H', h, ' fiscal ', yy)", *_HALF), ("concat('FY ', y - 1, '-', yy)", *_YEAR),
    ("concat('Financial Year ', y)", *_YEAR), ("concat('fiscal year: ', y - 1, '/', y)", *_YEAR), ("concat('F.Y. ', yy)", *_YEAR),
    ("concat(y - 1, '/', yy)", "CASE WHEN cm = 1 THEN 'range' ELSE 'fiscal_year' END", f"CASE WHEN cm = 1 THEN make_date(y - 1, 1, 1) ELSE {_FS.format('y')} END", f"CASE WHEN cm = 1 THEN make_date(y, 12, 31) ELSE {_FE.format('y')} END"),
    ("concat(y - 1, '-', y + 4)", "'range'", "make_date(y - 1, 1, 1)", "make_date(y + 4, 12, 31)"), ("concat('CY', yy)", *_CALENDAR), ("concat('calendar year ', y)", *_CALENDAR), ("concat('revenue in ', y, ' alone')", *_CALENDAR),
    ("concat('as at ', day(d), ' ', date_format(d, 'MMMM'), ' ', y)", *_DAY), ("concat('As of ', date_format(d, 'MMM d, yyyy'))", *_DAY), ("date_format(d, 'yyyy-MM-dd')", *_DAY), ("date_format(d, 'MMMM d, yyyy')", *_DAY), ("concat('as on ', date_format(d, 'MMM'), ' 31, ', y)", "'point'", "last_day(d)", "last_day(d)"),
    ("concat('year ended ', date_format(d, 'MMMM d, yyyy'))", *_ENDED("fiscal_year", 12)), ("concat('twelve months period ended ', day(d), ' ', date_format(d, 'MMMM yyyy'))", *_ENDED("fiscal_year", 12)),
    ("concat('nine months ended ', day(d), ' ', date_format(d, 'MMM'), ' ', y)", *_ENDED("range", 9)), ("concat('3-month period ended on ', date_format(d, 'MMMM d, yyyy'))", *_ENDED("quarter", 3)), ("concat('six months ended ', date_format(d, 'MMMM yyyy'))", "'half'", "CAST(date_trunc('month', d) - INTERVAL 5 MONTH AS DATE)", "last_day(d)"),
    ("date_format(d, 'MMM yyyy')", *_MONTH_OF), ("concat(date_format(d, 'MMMM'), '-', yy)", *_MONTH_OF), ("concat('FY', y - 2, ' to FY', yy)", "'range'", _FS.format("y - 2"), _FE.format("y")),
    ("concat(date_format(d, 'MMMM'), ' ', y - 1, ' until ', date_format(d, 'MMMM yyyy'))", "'range'", "CAST(date_trunc('month', d) - INTERVAL 12 MONTH AS DATE)", "last_day(d)"), ("concat('FY', y - 3, ' through FY', y - 1, ' – FY', y)", "'range'", _FS.format("y - 3"), _FE.format("y")),
    ("'no period in it'", "'unknown'", "NULL", "NULL"), ("concat('sales to ', y)", *_CALENDAR), ("''", "'unknown'", "NULL", "NULL"),
]


def _cases(i: int) -> str:
    return "CASE o_orderkey % " + str(len(FORMS)) + " " + " ".join(f"WHEN {n} THEN {f[i]}" for n, f in enumerate(FORMS)) + " END"


_PERIODS_SQL = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, CAST(o_orderkey % 4 + 1 AS INT) AS q, CAST(o_orderkey % 2 + 1 AS INT) AS h, CASE o_custkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 4 END AS cm FROM orders)
SELECT o_orderkey, {_cases(1)} AS kind, {_cases(2)} AS period_start, {_cases(3)} AS period_end FROM o"""


def _labels(spark, sf) -> DataFrame:
    o = rows_of(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.get(F.array(*map(F.lit, _CONVENTIONS)), (F.col("o_custkey") % 4).cast("int")).alias("convention"))
    o = o.withColumns({"y": F.year("d"), "yy": F.lpad((F.year("d") % 100).cast("string"), 2, "0"), "q": (F.col("o_orderkey") % 4 + 1).cast("int"), "h": (F.col("o_orderkey") % 2 + 1).cast("int")})
    return o.withColumn("label", F.expr(_cases(0)))


@query(_PERIODS_SQL)
def parse_period_forms(spark, sf):
    """PER-1..16 over every form of label and every fiscal convention."""
    return _labels(spark, sf).select("o_orderkey", periods.parse_period(F.col("label"), F.col("convention")).alias("p")).select("o_orderkey", "p.kind", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


@query(f"""WITH p AS ({_PERIODS_SQL}) SELECT o_orderkey, CASE WHEN period_start IS NULL THEN 0 ELSE period_end - period_start + 1 END AS days, coalesce(period_start <= d AND d <= period_end, false) AS has_day, coalesce(period_start <= make_date(year(d), 12, 31) AND make_date(year(d), 7, 1) <= period_end, false) AS second_half,
CASE WHEN kind = 'point' THEN strftime(period_start, '%Y-%m-%d') WHEN kind <> 'unknown' THEN strftime(period_start, '%Y-%m-%d') || ' to ' || strftime(period_end, '%Y-%m-%d') ELSE CASE WHEN o_orderkey % {len(FORMS)} = {len(FORMS) - 1} THEN 'unspecified period' ELSE 'no period in it' END END AS words,
CASE WHEN kind = 'unknown' THEN 'unresolved:' || CASE WHEN o_orderkey % {len(FORMS)} = {len(FORMS) - 1} THEN '' ELSE 'no period in it' END ELSE strftime(period_start, '%Y-%m-%d') || '/' || strftime(period_end, '%Y-%m-%d') END AS key FROM p JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) USING (o_orderkey)""")
def period_properties(spark, sf):
    """PER-18, PER-19: days, contains, overlaps, key and description."""
    p = _labels(spark, sf).withColumn("p", periods.parse_period(F.col("label"), F.col("convention"))).select("*", F.col("p.start").alias("s"), F.col("p.end").alias("e"), F.col("p.kind").alias("kind"))
    s, e, d = F.col("s"), F.col("e"), F.col("d")
    return p.select("o_orderkey", periods.days(s, e).alias("days"), periods.contains(s, e, d, d).alias("has_day"), periods.overlaps(s, e, F.make_date("y", F.lit(7), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31))).alias("second_half"), periods.describe(F.col("label"), F.col("kind"), s, e).alias("words"), periods.key(F.col("label"), s, e).alias("key"))


CONVENTIONS = [("Accounts to 31 March 1999", "india"), ("in ₹ Lakh", "india"), ("The SEBI rules", "india"), ("Fiscal year to September 30", "us_federal"), ("September 30", "calendar"), ("plain words", "calendar"), (None, "calendar"), ("", "calendar"), ("under the Companies Act, 2013", "india")]


@query(_known([(c,) for _, c in CONVENTIONS], ["convention"], ["VARCHAR"]))
def infer_convention(spark, sf):
    """PER-19."""
    return _dealt(spark, sf, CONVENTIONS, ["s"], ["string"]).select("o_orderkey", periods.infer_convention(F.col("s")).alias("convention"))


#: value_number, value_text, kind → number.
READ = [
    ("12.5", "about 99", "quantitative", 12.5), (None, "about 99 units", "quantitative", 99.0), ("n/a", "(40)", "quantitative", -40.0), (None, "Plot 5, Sector 44", "categorical", None), ("7", "May 10", "temporal", 7.0), (None, "May 10", "temporal", None),
    (None, None, None, None), ("", "3,000", None, 3000.0), ("US$ 8", "9", "relational", 8.0), (None, "none", "quantitative", None), (None, "4 of them", "definitional", None),
]


@query(_known([c[3:] for c in READ], ["value"], ["DOUBLE"]))
def nrm_read_number(spark, sf):
    """NRM-2."""
    return _dealt(spark, sf, READ, ["n", "t", "k"], ["string"] * 3).select("o_orderkey", normalize.read_number(F.col("n"), F.col("t"), F.col("k")).alias("value"))


#: text → per unit, money, counted noun, predicate and period, scale, currency, unit of the value, cleaned unit.
WORDS = [
    ("fy24 ebitda margin", False, True, None, "ebitda margin", "fy24", None, None, "ebitda margin", "fy24 ebitda margin"), ("face value per share", True, True, "share", "face value per share", None, None, None, "value per share", "face value per share"), ("express parcel shipments", False, False, "shipments", "express parcel shipments", None, None, None, "parcel shipments", "express parcel shipments"),
    ("q3 fy2024 up", False, False, None, "q3 fy2024 up", None, None, None, "fy2024 up", "q3 fy2024 up"), ("2023-24 revenue from operations", False, True, None, "revenue from operations", "2023-24", None, None, "revenue from operations", "2023-24 revenue from operations"), ("₹ 8,142 crore", False, False, None, "₹ 8,142 crore", None, 1e7, "INR", "crore", "₹ 8,142 crore"),
    ("(in '000)", False, False, None, "(in '000)", None, 1e3, None, "'000)", "in '000"), ("us$ 40 bn)", False, False, None, "us$ 40 bn)", None, 1e9, "USD", "bn)", "us$ 40 bn"), ("12%", False, False, None, "12%", None, None, None, "%", "12%"), ("number of stores open", False, False, "stores", "number of stores open", None, None, None, "of stores open", "number of stores open"),
    ("h1 fy25 capital expenditure", False, True, None, "capital expenditure", "h1 fy25", None, None, "fy25 capital expenditure", "h1 fy25 capital expenditure"), ("million rs. paid", False, False, None, "million rs. paid", None, 1e6, "INR", "rs. paid", "million rs. paid"), ("", False, False, None, "", None, None, None, None, None), ("cy 2024 headcount", False, False, "headcount", "headcount", "cy 2024", None, None, "headcount", "cy 2024 headcount"),
]


@query(_known([c[1:] for c in WORDS], ["per_unit", "money", "counted", "predicate", "period", "scale", "currency", "of_value", "cleaned"], ["BOOLEAN", "BOOLEAN", "VARCHAR", "VARCHAR", "VARCHAR", "DOUBLE", "VARCHAR", "VARCHAR", "VARCHAR"]))
def nrm_words(spark, sf):
    """NRM-5..12."""
    s, n = F.col("s"), normalize
    rows = _dealt(spark, sf, WORDS, ["s"], ["string"]).withColumn("p", n.split_period(s))
    return rows.select(
        "o_orderkey", n.per_unit(s).alias("per_unit"), n.names_money(s).alias("money"), n.counted_noun(s).alias("counted"), "p.predicate", "p.period", n.explicit_scale(s).alias("scale"), n.currency_in(s).alias("currency"), n.unit_of_value(s).alias("of_value"), n.clean_unit(s).alias("cleaned"),
    )


#: unit, currency, value_text, predicate; page and document currency and scale → class, factor, currency.
UNITS = [
    ("Cr", "INR", "8,142 Cr", "revenue", None, None, None, None, "currency", 1e7, "INR"), ("million", None, "8,142 million", "revenue from operations", "INR", 1e7, None, None, "currency", 1e6, "INR"), (None, None, "8,142", "revenue from operations", "INR", 1e7, "USD", 1e6, "currency", 1e7, "INR"),
    (None, None, "8,142", "revenue from operations", None, None, "USD", 1e6, "currency", 1e6, "USD"), (None, "INR", "8,142", "turnover", "USD", 1e6, None, None, "currency", 1e6, "INR"), ("%", None, "12.5%", "ebitda margin", "INR", 1e7, None, None, "ratio", 1.0, None), (None, None, "12.5%", "growth", "INR", 1e7, None, None, "ratio", 1.0, None),
    ("million", None, "740 million", "express parcel shipments", "INR", 1e7, None, None, "count", 1e6, None), (None, None, "18,793", "pin codes covered", "INR", 1e9, None, None, None, None, None), ("₹", None, "₹ 1", "face value per share", "INR", 1e6, None, None, "currency", 1.0, "INR"),
    ("₹", None, "₹ 55", "operating cost", "INR", 1e6, None, None, "currency", 1e6, "INR"), ("tonnes", None, "5 tonnes", "freight carried", "INR", 1e7, None, None, "mass", 1000.0, None), (None, None, "US$ 4.2 bn", "total debt", None, None, "INR", 1e7, "currency", 1e9, "USD"), (None, None, "30 days", "payment cycle", "INR", 1e7, None, None, "duration", 1.0, None),
    (None, None, "1,204", "number of employees", "INR", 1e7, None, None, "count", 1.0, None), ("bps", None, "40 bps", "margin expansion", "INR", 1e7, None, None, "ratio_change", 0.01, None),
]
_IN = ["unit", "currency", "value_text", "predicate", "page_currency", "page_scale", "default_currency", "default_scale"]


@query(_known([c[8:] for c in UNITS], ["unit_class", "factor", "currency"], ["VARCHAR", "DOUBLE", "VARCHAR"]))
def nrm_unit_precedence(spark, sf):
    """NRM-3: beside the number, then the page, then the document."""
    rows = _dealt(spark, sf, UNITS, _IN, ["string"] * 5 + ["double", "string", "double"])
    return normalize.with_unit(rows).select("o_orderkey", "unit_of.unit_class", "unit_of.factor", "unit_of.currency")


#: basis, quote, statement, predicate, confidence → basis, direction, confidence.
BASES = [
    ("Actuals", "", "It rose", "sales", "0.9", "actual", "increase", 0.9), ("unspecified", "(Revised Estimate) 12", "It fell after it grew", "x", "1.7", "revised", "increase", 1.0), ("pro-forma", "", "flat", "decline in sales", "-2", "pro_forma", "decrease", 0.0), (None, "pro forma sum", "upper floor", "x", None, "pro_forma", None, 0.6),
    ("BE", "", "went down", "x", "high", "budgeted", "decrease", 0.6), ("", "as forecasted", "", "", "", None, None, 0.6), ("audited", "restated", "lower", "higher", "0.25", "actual", "increase", 0.25), (None, "a restated sum", "narrowed", "x", "NaN", "restated", "decrease", 0.6), ("preliminary", None, None, None, "0.5", "provisional", None, 0.5),
]


@query(_known([c[5:] for c in BASES], ["basis", "direction", "confidence"], ["VARCHAR", "VARCHAR", "DOUBLE"]))
def nrm_basis_direction(spark, sf):
    """NRM-14..16."""
    rows = _dealt(spark, sf, BASES, ["b", "q", "s", "p", "c"], ["string"] * 5)
    return rows.select("o_orderkey", normalize.resolve_basis(F.col("b"), F.col("q")).alias("basis"), normalize.direction(F.col("s"), F.col("p")).alias("direction"), normalize.confidence(F.col("c")).alias("confidence"))


#: pairs "key=value;…" → the same, tidied and sorted.
QUALIFIERS = [("Business Segment= Retail  trade ;Region=None", "business_segment=Retail trade"), ("a=1;A=2", "a=2"), ("x=-;y=N/A;z= ", ""), ("", ""), (" scope =all;tenor=5y", "scope=all;tenor=5y"), ("b=unspecified;c=Null d", "c=Null d")]


@query(_known([c[1:] for c in QUALIFIERS], ["qualifiers"], ["VARCHAR"]))
def nrm_qualifiers(spark, sf):
    """NRM-13, JSN-5."""
    rows = _dealt(spark, sf, QUALIFIERS, ["s"], ["string"]).withColumn("m", normalize.clean_qualifiers(F.str_to_map("s", F.lit(";"), F.lit("="))))
    flat: Column = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("o_orderkey", flat.alias("qualifiers"))


#: convention, currency, scale, publisher → the same in normal form.
PROFILES = [("India", "rs.", "Crore", " Acme ", "india", "INR", 1e7, "Acme"), ("UK ", "pounds", "", "", "uk", None, None, None), ("lunar", "USD", "in millions", None, "calendar", "USD", None, None), (None, None, None, "x", "calendar", None, None, "x"), ("us_federal", "€", "'000", "y", "us_federal", "EUR", 1e3, "y")]


@query(_known([c[4:] for c in PROFILES], ["fiscal_convention", "default_currency", "default_scale", "publisher"], ["VARCHAR", "VARCHAR", "DOUBLE", "VARCHAR"]))
def nrm_document_context(spark, sf):
    """NRM-18."""
    return normalize.document_context(_dealt(spark, sf, PROFILES, ["fiscal_convention", "default_currency", "default_scale", "publisher"], ["string"] * 4))


@query("""WITH p AS (SELECT o_custkey AS document_id, CASE WHEN o_orderkey % 5 < 2 THEN 'INR' WHEN o_orderkey % 5 < 4 THEN 'USD' END AS c, CASE o_orderkey % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e7 END::DOUBLE AS s FROM orders),
c AS (SELECT document_id, c, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, c) AS r FROM p WHERE c IS NOT NULL GROUP BY 1, 2), s AS (SELECT document_id, s, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, s) AS r FROM p WHERE s IS NOT NULL GROUP BY 1, 2)
SELECT c_custkey AS document_id, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'EUR' END, c.c) AS default_currency, coalesce(CASE WHEN c_custkey % 6 = 0 THEN 1e3 END::DOUBLE, s.s) AS default_scale FROM customer LEFT JOIN c ON c.document_id = c_custkey AND c.r = 1 LEFT JOIN s ON s.document_id = c_custkey AND s.r = 1""")
def nrm_observed_defaults(spark, sf):
    """NRM-19, AGG-13: what most pages of a document declare fills the gaps of its profile."""
    k = F.col("o_orderkey")
    pages = rows_of(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.when(k % 5 < 2, "INR").when(k % 5 < 4, "USD").alias("page_currency"), F.when(k % 3 == 0, 1e6).when(k % 3 == 1, 1e7).alias("page_scale"))
    profile = rows_of(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 4 == 0, "EUR").alias("default_currency"), F.when(F.col("c_custkey") % 6 == 0, 1e3).alias("default_scale"))
    return normalize.observed_defaults(pages, profile)


_NORMALISED = """WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS n, year(o_orderdate) AS y FROM orders)
SELECT k, CASE k % 4 WHEN 3 THEN 'score reached' WHEN 1 THEN 'ebitda margin' ELSE 'revenue' END AS predicate, n::DOUBLE AS value_number, CASE k % 4 WHEN 0 THEN n * 1e7 WHEN 1 THEN n WHEN 2 THEN n * 1e6 ELSE n END::DOUBLE AS value_base,
  CASE k % 4 WHEN 0 THEN 'currency' WHEN 1 THEN 'ratio' WHEN 2 THEN 'currency' ELSE 'dimensionless' END AS unit_class, CASE k % 4 WHEN 0 THEN 'INR' WHEN 2 THEN 'USD' END AS currency, make_date(y - 1, 4, 1) AS period_start,
  CASE WHEN k % 4 = 3 THEN 'unit_unresolved' ELSE '' END AS issues, 'acme | ' || CASE k % 4 WHEN 3 THEN 'score reached' WHEN 1 THEN 'ebitda margin' ELSE 'revenue' END || ' | segment=retail | ' || CASE k % 4 WHEN 1 THEN 'fy' || y ELSE 'fy ' || (y - 1) || '-' || lpad((y % 100)::VARCHAR, 2, '0') END || ' | actual' AS claim_key FROM o"""


@query(_NORMALISED)
def normalize_candidates(spark, sf):
    """NRM-1, NRM-4, NRM-17: whole candidates, each with the context of its page and document."""
    k, n = F.col("o_orderkey") % 4, F.floor("o_totalprice").cast("string")
    by = lambda *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), k.cast("int"))
    y = F.year(F.col("o_orderdate").cast("date"))
    label = F.concat(F.lit("FY "), (y - 1).cast("string"), F.lit("-"), F.lpad((y % 100).cast("string"), 2, "0"))
    rows = rows_of(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit(" Acme ").alias("subject"), F.lit("It  was").alias("statement"), by("Revenue", F.concat(F.lit("FY"), y.cast("string"), F.lit(" EBITDA margin")), "Revenue", "Score reached").alias("predicate"), F.lit("quantitative").alias("kind"), n.alias("value_text"),
        by(n, None, None, n).cast("string").alias("value_number"), by("₹ (in crore)", "%", None, None).cast("string").alias("unit"), F.lit(None).cast("string").alias("currency"), by(label, None, label, label).cast("string").alias("period"),
        F.create_map(F.lit("Segment"), F.lit("retail"), F.lit("x"), F.lit("none")).alias("qualifiers"), F.lit("actual").alias("basis"), F.lit("").alias("quote"), F.lit("0.9").alias("confidence"),
        by("USD", "USD", "USD", None).cast("string").alias("page_currency"), by(1e6, 1e6, 1e6, None).cast("double").alias("page_scale"), F.lit("india").alias("fiscal_convention"), F.lit(None).cast("string").alias("default_currency"), F.lit(None).cast("double").alias("default_scale"),
    )
    return normalize.normalize(rows).select("k", "predicate", "value_number", "value_base", "unit_class", "currency", "period_start", F.array_join("issues", ",").alias("issues"), "claim_key")


#: Surfaces → slug, alias key.
NAMES = [("The Zürich Re-Insurance", "the-zurich-re-insurance", "zurich re insurance"), ("Ölmühle & Söhne", "olmuhle-sohne", "olmuhle sohne"), ("  An Apple  ", "an-apple", "apple"), ("É", "e", "e"), ("???", "unnamed", ""), ("A.B. (C) 9", "a-b-c-9", "a b c 9"), ("Čeďok žluťoučký", "cedok-zlutoucky", "cedok zlutoucky")]


@query(_known([c[1:] for c in NAMES], ["slug", "key"], ["VARCHAR", "VARCHAR"]))
def slugs_and_keys(spark, sf):
    """TXT-9, TXT-10, with accents folded."""
    return _dealt(spark, sf, NAMES, ["s"], ["string"]).select("o_orderkey", text.slugify(F.col("s")).alias("slug"), text.alias_key(F.col("s")).alias("key"))
