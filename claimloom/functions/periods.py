"""Reporting periods: parsing labels, fiscal bounds and interval algebra (PER-1..19) as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let, lookup

#: First month of the fiscal year by convention, and words that give a convention away.
FIRST_MONTH = {"india": 4, "uk": 4, "calendar": 1, "us_federal": 10}
INDIAN_WORDS = ("march 31", "31 march", "31st march", "april 1", "1 april", "companies act, 2013", "reserve bank of india", "sebi", "crore", "lakh", "₹")
#: Months and ordinals by name.
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ORDINALS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4}
SPANS = {"three": 3, "3": 3, "six": 6, "6": 6, "nine": 9, "9": 9}

_KIND = "struct<kind:string,start:date,end:date>"
_MONTH = "(" + "|".join(sorted({m for n in MONTH_NAMES for m in (n, n[:3])} | {"sept"}, key=len, reverse=True)) + ")"
_FY, _FY_LONG = r"(?:fy|f\.y\.?|fiscal)", r"(?:fy|f\.y\.?|fiscal(?: year)?|financial year)"
_YEARS = r"(\d{2,4})(?: ?[-/] ?(\d{2,4}))?\b"
_CENTURY = r"(?:19|20)\d\d"


def relate(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """PER-17: identical, contains, contained_by, partial, disjoint or unknown; intervals are closed."""
    return (
        F.when(ls.isNull() | le.isNull() | rs.isNull() | re.isNull(), "unknown")
        .when((ls == rs) & (le == re), "identical")
        .when((ls <= rs) & (le >= re), "contains")
        .when((rs <= ls) & (re >= le), "contained_by")
        .when((ls <= re) & (rs <= le), "partial")
        .otherwise("disjoint")
    )


def days(start: Column, end: Column) -> Column:
    """PER-18: days in the interval, 0 if it is unknown."""
    return F.coalesce(F.date_diff(end, start) + 1, F.lit(0))


def contains(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """PER-18: false if either is unknown."""
    return F.coalesce((ls <= rs) & (re <= le), F.lit(False))


def overlaps(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """PER-18: false if either is unknown."""
    return F.coalesce((ls <= re) & (rs <= le), F.lit(False))


def key(label: Column, start: Column, end: Column) -> Column:
    """PER-18: the interval, or the label where it couldn't be read."""
    known = F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"), F.date_format(end, "yyyy-MM-dd"))
    return F.coalesce(known, F.concat(F.lit("unresolved:"), F.lower(F.trim(F.coalesce(label, F.lit(""))))))


def describe(label: Column, kind: Column, start: Column, end: Column) -> Column:
    """PER-19: the interval in words."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    unread = F.coalesce(F.nullif(label, F.lit("")), F.lit("unspecified period"))
    return F.when(start.isNull() | end.isNull(), unread).when(kind == "point", day(start)).otherwise(F.concat(day(start), F.lit(" to "), day(end)))


def infer_convention(text: Column) -> Column:
    """PER-19: the fiscal convention that a document's own words suggest."""
    low = F.lower(F.coalesce(text, F.lit("")))
    indian = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in INDIAN_WORDS])
    return F.when(indian, "india").when(F.contains(low, F.lit("september 30")) & F.contains(low, F.lit("fiscal year")), "us_federal").otherwise("calendar")


def _date(year: Column, month: Column, day: Column | int = 1) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day if isinstance(day, Column) else F.lit(day)), "yyyy-MM-dd")


def fiscal_start(end_year: Column, convention: str | Column) -> Column:
    """PER-16: first day of the fiscal year that ends in end_year. convention: a name, or a column of names (unknown ones: April)."""
    if isinstance(convention, str):
        m = F.lit(FIRST_MONTH[convention])
    else:
        m = F.coalesce(*[F.when(convention == k, v) for k, v in FIRST_MONTH.items()], F.lit(4))
    return _date(end_year - F.when(m == 1, 0).otherwise(1), m)


def _interval(kind: str, start: Column, end: Column) -> Column:
    """struct(kind, start, end), null if either end is; both should be cheap to name twice."""
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))


def _months(kind: str, start: Column, months: int) -> Column:
    return let(start, lambda s: _interval(kind, s, F.last_day(F.add_months(s, months - 1))))


def _point(day: Column) -> Column:
    return let(day, lambda d: _interval("point", d, d))


def _year(two_or_four: Column) -> Column:
    return F.when(two_or_four >= 100, two_or_four).when(two_or_four < 70, two_or_four + 2000).otherwise(two_or_four + 1900)


def _last_year(first: Column, second: Column) -> Column:
    """The year a span ends in: its second year, completed by the first's century, a century later if that isn't after it."""

    def end(y: Column) -> Column:
        near = y - y % 100 + second
        return F.when(second.isNull(), y).when(second >= 100, second).when(near > y, near).otherwise(near + 100)

    return let(_year(first), end)


def _matched(text: Column, pattern: str, use) -> Column:
    """use(x) of the first match's groups, x["1"] and so on, each found once; null without a match."""
    n = re.compile(pattern).groups
    groups = F.struct(*[F.regexp_extract(text, pattern, i).alias(str(i)) for i in range(n + 1)])
    return F.when(text.rlike(pattern), let(groups, use))


def _number(word: Column) -> Column:
    return word.try_cast("int")


def _month(name: Column) -> Column:
    place = F.instr(F.lit("".join(m[:3] for m in MONTH_NAMES)), F.nullif(F.left(name, F.lit(3)), F.lit("")))
    return F.ceil(F.nullif(place, F.lit(0)) / 3).cast("int")


_ISO = rf"\b({_CENTURY})-(\d\d)-(\d\d)\b"
_WRITTEN = rf"\b(\d{{1,2}})? ?\b{_MONTH}\.? ?(\d{{1,2}})?,? ?({_CENTURY})\b"


def _day(text: Column) -> Column:
    """The first date written in a text: 2024-03-31, March 31, 2024 or 31 March 2024; the month's end without a (valid) day."""

    def written(x: Column) -> Column:
        day = F.coalesce(_number(x["3"]), _number(x["1"]), F.lit(0))
        return F.coalesce(_date(_number(x["4"]), _month(x["2"]), day), F.last_day(_date(_number(x["4"]), _month(x["2"]))))

    return F.when(text.rlike(_ISO), F.try_to_date(F.regexp_extract(text, _ISO, 0), "yyyy-MM-dd")).otherwise(_matched(text, _WRITTEN, written))


def _simple(text: Column, convention: str | Column) -> Column:
    """struct(kind, start, end) of a label that names one period, null if no rule reads it. The first rule that does wins."""
    rules, none = [], F.lit(None).cast("int")

    def rule(pattern: str, build) -> None:
        rules.append(_matched(text, pattern, build))

    def part(kind: str, months: int, number, first: str, last: str):
        """A quarter or half, by number, of the fiscal year that groups first and last name."""
        return lambda x: _months(kind, F.add_months(fiscal_start(_last_year(_number(x[first]), _number(x[last])), convention), (number(x) - 1) * months), months)

    def fiscal(x: Column, last: Column) -> Column:
        return _months("fiscal_year", fiscal_start(_last_year(_number(x["1"]), last), convention), 12)

    rule(rf"\bq ?([1-4]) ?[-/]? ?{_FY}? ?{_YEARS}", part("quarter", 3, lambda x: _number(x["1"]), "2", "3"))
    rule(rf"\b{_FY} ?(\d{{2,4}})(?: ?[-/] ?(\d{{2,4}}))? ?q ?([1-4])\b", part("quarter", 3, lambda x: _number(x["3"]), "1", "2"))
    rule(rf"\b({'|'.join(ORDINALS)}) quarter (?:of )?(?:the )?{_FY_LONG}? ?{_YEARS}", part("quarter", 3, lambda x: lookup(ORDINALS, x["1"]), "2", "3"))
    rule(rf"\bh ?([12]) ?[-/]? ?{_FY}? ?{_YEARS}", part("half", 6, lambda x: _number(x["1"]), "2", "3"))

    # a span that ends on a stated day begins with the first of its first month
    ended = r"(?: period)? ended (.{1,34})"

    def until(kind: str, months: int):
        return lambda x: let(_day(x["1"]), lambda end: _interval(kind, F.add_months(F.trunc(end, "month"), 1 - months), end))

    for words, months, kind in (("three|3", 3, "quarter"), ("six|6", 6, "half"), ("nine|9", 9, "range")):
        rule(rf"\b(?:{words})[ -]+months?{ended}", until(kind, months))
    rule(rf"\b(?:year|(?:twelve|12)[ -]+months?){ended}", until("fiscal_year", 12))
    rule(rf"\b{_FY_LONG} ?[:\-]? ?(\d{{4}}|\d\d) ?[-/] ?(\d{{4}}|\d\d)\b", lambda x: fiscal(x, _number(x["2"])))
    rule(rf"\b{_FY_LONG} ?[:\-]? ?(\d{{4}}|\d\d)\b", lambda x: fiscal(x, none))

    def bare_span(x: Column) -> Column:
        first = _number(x["1"])
        calendar = F.lit(convention == "calendar") if isinstance(convention, str) else convention == "calendar"

        def until_year(last: Column) -> Column:
            years = _interval("range", _date(first, F.lit(1)), _date(last, F.lit(12), 31))
            return F.when((last - first > 1) | calendar, years).otherwise(_months("fiscal_year", fiscal_start(last, convention), 12))

        return let(_last_year(first, _number(x["2"])), until_year)

    rule(rf"\b({_CENTURY}) ?[-/] ?(\d{{4}}|\d\d)\b(?!-\d)", bare_span)
    rule(r"\b(?:cy|calendar year) ?[:\-]? ?((?:19|20)?\d\d)\b", lambda x: _months("calendar_year", _date(_year(_number(x["1"])), F.lit(1)), 12))
    rule(r"\bas (?:at|of|on) (.{1,40})", lambda x: _point(_day(x["1"])))
    rule(rf"\b{_CENTURY}-\d\d-\d\d\b", lambda x: _point(F.try_to_date(x["0"], "yyyy-MM-dd")))
    # a month beside its year; a further number means that the first one was a day
    rule(rf"\b{_MONTH} ?[-, ] ?({_CENTURY}|\d\d)\b(?!(?:st|nd|rd|th|[ ,])*\d)", lambda x: _months("month", _date(_year(_number(x["2"])), _month(x["1"])), 1))
    rule(rf"\b(?:{_MONTH})\b", lambda x: _point(_day(text)))
    rule(rf"\b({_CENTURY})\b", lambda x: _months("calendar_year", _date(_number(x["1"]), F.lit(1)), 12))
    return F.coalesce(*rules).cast(_KIND)


_BETWEEN = " (?:to|through|until|till|-|–) "


def parse_period(label: Column, convention: str | Column = "india") -> Column:
    """PER-1: struct(kind, start, end); kind unknown where no rule reads the label.

    PER-2: a label of several periods ("2021-22 to 2024-25") is the range from the least start to the greatest end, if
    both sides of its first separator can be read and the left one isn't that range already. The sides are
    taken from the last to the first, each with what its right side amounts to.
    """
    text = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    parts = F.split(text, _BETWEEN)
    # where the k-th separator stands, everything from there on: the k-th right side
    rests = F.transform(parts, lambda p, i: F.regexp_replace(text, F.concat(F.lit("^(?:.*?"), F.lit(_BETWEEN), F.lit("){"), i.cast("string"), F.lit("}")), F.lit("")))
    # most labels are one piece; the rules stand in the plan once, whatever a label needs
    pieces = F.when(text.rlike(_BETWEEN), F.concat(F.transform(parts, lambda p: F.trim(p)), rests)).otherwise(F.array(text))

    def folded(read: Column) -> Column:
        n = F.floor(F.size(read) / 2).cast("int")

        def widen(right: Column, i: Column) -> Column:
            own, whole = F.element_at(read, i), F.element_at(read, i + n)
            start, end = F.least(own["start"], right["start"]), F.greatest(own["end"], right["end"])
            both = own.isNotNull() & right.isNotNull() & ~((start == own["start"]) & (end == own["end"]))
            return F.when(both, F.struct(F.lit("range").alias("kind"), start.alias("start"), end.alias("end"))).otherwise(whole)

        several = F.aggregate(F.sequence(n - 1, F.lit(1)), F.element_at(read, n), widen)
        return F.when(F.size(read) == 1, F.element_at(read, 1)).otherwise(several)

    found = let(F.transform(pieces, lambda p: _simple(p, convention)), folded)
    return F.coalesce(found, F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end")).cast(_KIND))
