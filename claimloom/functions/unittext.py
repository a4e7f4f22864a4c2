"""Units read from text as Column expressions: declarations of a page, units beside a number (UNT-4, UNT-5, UNT-7, SNK-10).

Two habits of looser readers are left out on purpose: a scale must be a word of its own (so digits grouped by
commas declare none), and a whole tail that names a unit is taken as that unit before scales are looked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let, lookup
from claimloom.functions.units import COUNT_NOUNS, CURRENCIES, SCALES, known_unit, longest, normalize_currency, normalize_scale, scale_label

_DECLARABLE = [k for k in SCALES if k not in ("one", "unit", "units", "000", "b", "m", "k", "hundred", "hundreds")]
_MONEY = rf"(?<![a-z])({longest(CURRENCIES)})"
_SCALE = rf"(\b(?:{longest(_DECLARABLE)})\b|'000\b)"
_MONEY_AND_SCALE = rf"(?i){_MONEY}\s*\(?\s*(?:in\s+)?{_SCALE}"
#: Characters of a text in which a declaration is looked for.
DECLARED_WITHIN = 2000


def declared_unit(text: Column) -> Column:
    """UNT-4: struct(currency, scale) that a page declares; the first with a currency wins, else the first scale."""
    start = F.left(text, F.lit(DECLARED_WITHIN))
    money = F.lower(F.regexp_extract(start, _MONEY_AND_SCALE, 1))
    word = F.when(money != "", F.regexp_extract(start, _MONEY_AND_SCALE, 2)).otherwise(F.regexp_extract(start, rf"(?i){_SCALE}", 1))
    return F.struct(lookup(CURRENCIES, money).alias("currency"), lookup(SCALES, F.ltrim(F.lower(word), F.lit("'"))).alias("scale"))


def _unit(canonical: Column, kind: Column, factor: Column, currency: Column | None = None) -> Column:
    money = F.lit(None).cast("string") if currency is None else currency
    return F.struct(canonical.alias("canonical"), kind.alias("unit_class"), factor.cast("double").alias("factor"), money.alias("currency"))


def resolve_unit(text: Column, scale: Column | None = None, currency: Column | None = None) -> Column:
    """UNT-5: struct(canonical, unit_class, factor, currency) of a unit's text, null if there is nothing to read.

    scale: a factor stated elsewhere; currency: a currency stated elsewhere, which wins over one in the text.
    """
    none = F.lit(None).cast("string")
    stated = none if currency is None else normalize_currency(currency)
    base = F.coalesce(F.nullif(scale, F.lit(0.0)), F.lit(1.0)) if scale is not None else F.lit(1.0)
    clean = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[()]", " "), r"\s+", " "), F.lit(" .,;:"))
    lead = F.regexp_extract(clean, rf"^({longest(CURRENCIES)})(?=[ .]|$)", 1)

    def money_apart(x: Column) -> Column:
        rest = F.btrim(F.substring(x["clean"], F.length(x["lead"]) + 1, F.length(x["clean"])), F.lit(" ."))
        return F.struct(x["clean"].alias("clean"), F.coalesce(x["stated"], lookup(CURRENCIES, x["lead"])).alias("money"), rest.alias("rest"), x["base"].alias("base"))

    def scales_apart(x: Column) -> Column:
        words = F.transform(F.filter(F.split(F.replace(x["rest"], F.lit("lakh crore"), F.lit("lakh_crore")), r"[\s/]+"), lambda w: w != ""), lambda w: F.replace(F.btrim(w, F.lit("'’\".,")), F.lit("_"), F.lit(" ")))
        parts = F.transform(words, lambda w: F.struct(w.alias("w"), F.nullif(normalize_scale(w), F.lit(1.0)).alias("f")))
        return let(parts, lambda ps: F.struct(
            x["clean"].alias("clean"), x["money"].alias("money"), known_unit(x["rest"]).alias("whole"), x["base"].alias("base"),
            F.aggregate(ps, x["base"], lambda a, p: a * F.coalesce(p["f"], F.lit(1.0))).alias("factor"),
            F.array_join(F.transform(F.filter(ps, lambda p: p["f"].isNull() & ~p["w"].isin("in", "of", "per")), lambda p: p["w"]), " ").alias("tail"),
        ))

    def chosen(x: Column) -> Column:
        tail, factor, whole, known = x["tail"], x["factor"], x["whole"], x["known"]
        single = F.when(tail.endswith("ies"), F.regexp_replace(tail, "ies$", "y")).otherwise(F.regexp_replace(tail, "s$", ""))
        counted = tail.isin(*COUNT_NOUNS) | single.isin(*COUNT_NOUNS)
        return (
            F.when((x["clean"] == "") & x["money"].isNull(), F.lit(None))
            .when(x["money"].isNotNull(), _unit(F.trim(F.concat(x["money"], F.lit(" "), scale_label(factor))), F.lit("currency"), factor, x["money"]))
            .when(whole.isNotNull(), _unit(whole["canonical"], whole["unit_class"], whole["factor"] * x["base"]))
            .when((tail == "") & (factor != 1.0), _unit(scale_label(factor), F.lit("count"), factor))
            .when(tail == "", F.lit(None))
            .when(known.isNotNull(), _unit(known["canonical"], known["unit_class"], known["factor"] * factor))
            .when(counted, _unit(single, F.lit("count"), factor))
            .otherwise(_unit(tail, F.concat(F.lit("other:"), single), factor))
        )

    start = F.struct(clean.alias("clean"), lead.alias("lead"), stated.alias("stated"), base.alias("base"))
    read = let(let(start, money_apart), scales_apart)
    return let(let(read, lambda x: F.struct(*[x[c].alias(c) for c in ("clean", "money", "whole", "base", "factor", "tail")], known_unit(x["tail"]).alias("known"))), chosen)


def unit_note(currency: Column, scale: Column) -> Column:
    """SNK-10: a declared unit in words for a prompt, such as "INR, million"; null if nothing is declared."""
    word = F.coalesce(F.nullif(scale_label(scale), F.lit("")), F.lit(None).cast("string"))
    return F.nullif(F.concat_ws(", ", currency, word), F.lit(""))
