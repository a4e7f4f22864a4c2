"""From a grounded candidate to a comparable fact (NRM-1..19, AGG-13). Everything is a Column; nothing leaves the JVM.

A candidate has subject, predicate, statement, kind, value_text, value_number, unit, currency, period, qualifiers (map),
basis, quote and confidence; what its page declares (page_currency, page_scale) and its document (fiscal_convention,
default_currency, default_scale). Missing values may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import periods, text, units, unittext
from claimloom.functions.binding import lookup
from claimloom.functions.units import COUNT_NOUNS

# Words that give a direction, in order of precedence; bases by name; what names money.
DIRECTIONS = {
    "increase": "increase", "increased": "increase", "rose": "increase", "grew": "increase", "growth": "increase", "up": "increase", "higher": "increase", "expanded": "increase",
    "decrease": "decrease", "decreased": "decrease", "fell": "decrease", "declined": "decrease", "decline": "decrease", "down": "decrease", "lower": "decrease", "contracted": "decrease", "narrowed": "decrease",
}
BASES = {
    "actual": "actual", "actuals": "actual", "reported": "actual", "audited": "actual", "estimate": "estimate", "estimated": "estimate", "est": "estimate", "advance estimate": "estimate",
    "projection": "projection", "projected": "projection", "proj": "projection", "forecast": "projection", "forecasted": "projection", "revised": "revised", "revised estimate": "revised", "re": "revised", "restated": "restated",
    "pro forma": "pro_forma", "proforma": "pro_forma", "pro_forma": "pro_forma", "budget": "budgeted", "budgeted": "budgeted", "budget estimate": "budgeted", "be": "budgeted", "target": "target", "provisional": "provisional", "preliminary": "provisional",
}
BASES_IN_QUOTES = ("pro forma", "proforma", "restated", "revised estimate", "revised", "budget estimate", "budgeted", "provisional", "preliminary", "projected", "projection", "forecast", "estimated", "estimate")
MONEY_STEMS = (
    "revenue sales turnover income earning profit loss ebitda ebit margin cost expense expenditure capex opex price fee tariff salary wage remuneration compensation tax duty levy subsidy grant debt"
    " borrowing loan advance deposit equity capital asset liability provision reserve cash fund investment valuation value worth budget spend outlay payment receipt payable receivable dividend interest"
    " premium discount amount balance proceeds consideration gdp gva surplus deficit exports imports remittance"
).split()
NO_VALUE = ("none", "n/a", "null", "-", "unspecified")
#: Kinds whose value is no quantity: their text is never scanned for digits.
UNMEASURED = ("categorical", "relational", "definitional", "temporal")
SCALE_WORDS = ("hundred", "thousand", "lakh", "lakhs", "lac", "lacs", "million", "millions", "mn", "crore", "crores", "cr", "billion", "billions", "bn", "trillion", "trillions", "tn")

_SCALE = rf"(?i)\b({units.longest(SCALE_WORDS)})\b|['’](000)"
_SYMBOL = rf"(?i)[{''.join(k for k in units.CURRENCIES if len(k) == 1)}]|\b({units.longest(k for k in units.CURRENCIES if k.isalpha() and len(k) < 4)})\b"
_PER = r"\b(?:per|(?:face|nominal) value)\b"
#: A period in front: a quarter, a half, a fiscal year or a span of years, or a calendar year.
_PREFIX = r"^((?=q[1-4]|h[12]|fy|\d{4} ?-)(?:[qh]\d ?)?(?:fy ?)?\d{2,4}(?: ?- ?\d{2,4})?|cy ?\d{4}) "


def _filled(c: Column) -> Column:
    """Whitespace collapsed, null for nothing."""
    return F.nullif(text.collapse(c), F.lit(""))


def read_number(value_number: Column, value_text: Column, kind: Column) -> Column:
    """NRM-2: the stated number, else the first one of the text, if the kind is a quantity."""
    stated = F.coalesce(value_number.cast("string").try_cast("double"), units.parse_number(value_number.cast("string")))
    return F.coalesce(stated, F.when(~F.coalesce(kind, F.lit("quantitative")).isin(*UNMEASURED), units.parse_number(value_text)))


def clean_unit(unit: Column) -> Column:
    """NRM-12: without brackets around it."""
    return F.nullif(F.regexp_replace(text.collapse(unit), r"^[\s(\[]+|[\s)\]]+$", ""), F.lit(""))


def explicit_scale(phrase: Column) -> Column:
    """NRM-9: the scale that a word of the phrase names."""
    word = F.lower(F.regexp_extract(phrase, _SCALE, 1))
    return F.coalesce(lookup(units.SCALES, word), F.when(F.regexp_extract(phrase, _SCALE, 2) != "", 1000.0))


def currency_in(phrase: Column) -> Column:
    """NRM-10: the currency of the first symbol or code in the phrase."""
    return units.normalize_currency(F.nullif(F.regexp_extract(phrase, _SYMBOL, 0), F.lit("")))


def unit_of_value(value_text: Column) -> Column:
    """NRM-11: what is written behind the digits of a value."""
    whole = F.trim(value_text)
    return F.when(whole.endswith("%"), "%").otherwise(F.nullif(F.trim(F.regexp_extract(whole, r"[\d,.\s](?=[A-Za-z%°'’/])(.*)$", 1)), F.lit("")))


def per_unit(predicate: Column) -> Column:
    """NRM-7: an amount for one share, unit or item."""
    return F.coalesce(F.lower(predicate).rlike(_PER), F.lit(False))


def names_money(predicate: Column) -> Column:
    """NRM-6: the measure is an amount of money, by the stem of one of its words."""
    return F.coalesce(F.lower(predicate).rlike("|".join(MONEY_STEMS)), F.lit(False))


def counted_noun(predicate: Column) -> Column:
    """NRM-8: the countable thing that the measure's last word names, or the one before it."""
    words = F.regexp_extract_all(F.lower(predicate), F.lit("[a-z]+"), F.lit(0))
    return F.element_at(F.concat(F.filter(F.reverse(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))), lambda w: w.isin(*COUNT_NOUNS)), F.array(F.lit(None).cast("string"))), 1)


def split_period(predicate: Column) -> Column:
    """NRM-5: struct(predicate, period): a period in front of a measure's name, unless hardly anything is left without it."""
    prefix = F.regexp_extract(predicate, _PREFIX, 1)
    rest = F.trim(F.substring(predicate, F.length(prefix) + 1, F.length(predicate)))
    cut = (prefix != "") & (F.length(rest) >= 3)
    return F.struct(F.when(cut, rest).otherwise(predicate).alias("predicate"), F.when(cut, F.trim(prefix)).alias("period"))


def clean_qualifiers(qualifiers: Column) -> Column:
    """NRM-13: names in lower case with underscores, without values that say nothing; of equal names the last wins."""
    pairs = F.transform(F.map_entries(qualifiers), lambda e: F.struct(F.replace(F.lower(text.collapse(e["key"])), F.lit(" "), F.lit("_")).alias("key"), text.collapse(e["value"]).alias("value")))
    kept = F.filter(pairs, lambda e: (e["key"] != "") & (F.coalesce(e["value"], F.lit("")) != "") & ~F.lower(e["value"]).isin(*NO_VALUE))
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def resolve_basis(basis: Column, quote: Column) -> Column:
    """NRM-14: the declared basis by its synonyms, else the first one that the quote names."""
    declared = lookup(BASES, F.replace(F.lower(F.trim(basis)), F.lit("-"), F.lit(" ")))
    named = F.lower(F.regexp_extract(quote, r"(?i)\b(pro\s?forma|" + units.longest(BASES_IN_QUOTES) + r")\b", 1))
    return F.coalesce(declared, lookup(BASES, F.regexp_replace(named, r"\s+", " ")))


def direction(statement: Column, predicate: Column) -> Column:
    """NRM-15: increase or decrease, by the first of the listed words that occurs."""
    words = F.split(F.lower(F.concat_ws(" ", statement, predicate)), r"[^\p{L}\p{N}_]+")
    out = F.lit(None).cast("string")
    for word, way in reversed(DIRECTIONS.items()):
        out = F.when(F.array_contains(words, word), way).otherwise(out)
    return out


def confidence(stated: Column) -> Column:
    """NRM-16: between 0 and 1, 0.6 where none is stated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(stated.cast("string").try_cast("double"), F.lit(None).cast("double")), F.lit(0.6))))


def document_context(profile: DataFrame) -> DataFrame:
    """NRM-18: a document's profile with its convention, currency, scale and texts in normal form, others dropped."""
    convention = F.lower(F.trim("fiscal_convention"))
    tidy = {c: F.nullif(F.trim(c), F.lit("")) for c in ("reporting_basis", "as_of_date", "publisher", "title", "doc_type") if c in profile.columns}
    return profile.withColumns({
        "fiscal_convention": F.when(convention.isin(*periods.FIRST_MONTH), convention).otherwise("calendar"), "default_currency": units.normalize_currency(F.col("default_currency")),
        "default_scale": units.normalize_scale(F.nullif(F.trim(F.col("default_scale").cast("string")), F.lit(""))), **tidy,
    })


def observed_defaults(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """NRM-19, AGG-13: gaps of a profile filled with what most of the document's pages declare (ties: the first in order).

    pages: document_id, page_currency, page_scale. A profile's own values win.
    """

    def most(column: str) -> DataFrame:
        n = pages.where(F.col(column).isNotNull()).groupBy("document_id", column).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("document_id").agg(F.min_by(column, F.struct(-F.col("n"), column)).alias(column))

    joined = profile.join(most("page_currency"), "document_id", "left").join(most("page_scale"), "document_id", "left")
    return joined.withColumns({"default_currency": F.coalesce("default_currency", "page_currency"), "default_scale": F.coalesce("default_scale", "page_scale")}).drop("page_currency", "page_scale")


def with_unit(df: DataFrame) -> DataFrame:
    """NRM-3: candidates with unit_of: struct(canonical, unit_class, factor, currency), from the most specific evidence.

    First what stands beside the number. A noun that the measure counts comes before any currency. Money inherits the
    currency of its page or document if nothing else names one, and their scale if no scale is stated; amounts per unit
    inherit no scale, other measures nothing.
    """
    c = F.col
    df = df.withColumns({
        "_unit": clean_unit(c("unit")), "_counts": counted_noun(c("predicate")), "_money": F.coalesce(units.normalize_currency(c("currency")), currency_in(clean_unit(c("unit"))), currency_in(c("value_text"))),
        "_unit_scale": explicit_scale(clean_unit(c("unit"))), "_value_scale": explicit_scale(c("value_text")),
    })
    # a scale inside the unit's text is found by resolve_unit itself, and must not count twice
    beside = F.when(c("_unit_scale").isNull(), c("_value_scale"))
    own = F.coalesce(unittext.resolve_unit(c("_unit"), beside, c("_money")), unittext.resolve_unit(unit_of_value(c("value_text")), F.when(c("_unit_scale").isNull() & explicit_scale(unit_of_value(c("value_text"))).isNull(), c("_value_scale")), c("_money")))
    df = df.withColumn("_own", own)
    unresolved = c("_own").isNull() | units.is_bare_scale(c("_own"))
    stated = F.coalesce("_unit_scale", "_value_scale")
    df = df.withColumns({
        "_counted": F.when(unresolved & c("_counts").isNotNull(), unittext.resolve_unit(c("_counts"), F.coalesce(c("_own")["factor"], stated, F.lit(1.0)))),
        "_amount": c("_money").isNotNull() | names_money(c("predicate")), "_open": unresolved,
    })
    takes_currency = c("_open") & c("_amount")
    takes_scale = stated.isNull() & c("_amount") & ~per_unit(c("predicate")) & (c("_open") | (c("_own")["unit_class"] == "currency"))
    money = F.coalesce(c("_money"), F.when(takes_currency, F.coalesce("page_currency", "default_currency")))
    scale = F.when(c("_unit_scale").isNull(), F.coalesce(stated, F.when(takes_scale, F.coalesce("page_scale", "default_scale"))))
    df = df.withColumns({"_inherits": (takes_currency | takes_scale) & (money.isNotNull() | scale.isNotNull()), "_final": unittext.resolve_unit(c("_unit"), scale, money)})
    chosen = F.coalesce("_counted", F.when(c("_inherits"), c("_final")), "_own")
    return df.withColumn("unit_of", chosen).drop("_unit", "_counts", "_money", "_unit_scale", "_value_scale", "_own", "_counted", "_amount", "_open", "_inherits", "_final")


def normalize(candidates: DataFrame) -> DataFrame:
    """NRM-1, NRM-4: one fact per candidate. A number without a unit has factor 1, no dimension and the issue unit_unresolved."""
    c = F.col
    rows = candidates.withColumns({"subject": text.collapse(c("subject")), "statement": text.collapse(c("statement")), "_split": split_period(F.lower(text.collapse(c("predicate")))), "value_text": _filled(c("value_text")), "kind": F.coalesce(F.nullif("kind", F.lit("")), F.lit("quantitative"))})
    rows = with_unit(rows).withColumn("value_number", read_number(c("value_number"), c("value_text"), c("kind")))
    label = F.coalesce(_filled(c("period")), c("_split")["period"])
    rows = rows.withColumns({"predicate": c("_split")["predicate"], "period_label": label, "unit_of": F.when(c("value_number").isNotNull(), c("unit_of")), "_bare": c("value_number").isNotNull() & c("unit_of").isNull()})
    rows = rows.withColumns({"_period": periods.parse_period(c("period_label"), c("fiscal_convention")), "basis": resolve_basis(c("basis"), c("quote")), "direction": direction(c("statement"), c("predicate")), "confidence": confidence(c("confidence")), "qualifiers": clean_qualifiers(c("qualifiers"))})
    issues = F.array_compact(F.array(F.when(c("_bare"), "unit_unresolved"), F.when(c("period_label").isNotNull() & c("_period")["start"].isNull(), "period_unresolved")))
    named = text.claim_key(c("subject"), c("predicate"), c("qualifiers"), c("period_label"), c("basis"))
    out = rows.withColumns({
        "value_base": F.when(c("_bare"), c("value_number")).otherwise(units.to_base(c("value_number"), c("unit_of"))), "unit_class": F.when(c("_bare"), "dimensionless").otherwise(c("unit_of")["unit_class"]), "currency": c("unit_of")["currency"], "unit_scale": F.when(c("_bare"), 1.0).otherwise(c("unit_of")["factor"]),
        "unit_surface": clean_unit(c("unit")), "period_kind": c("_period")["kind"], "period_start": c("_period")["start"], "period_end": c("_period")["end"], "issues": issues, "claim_key": named,
    })
    return out.drop("_split", "_bare", "_period", "unit_of", "unit", "period")
