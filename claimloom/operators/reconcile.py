"""Candidate pairs and their deterministic classification (JON-6, FLT-14, CND-1, CND-2, REC-1..12, FLT-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import units
from claimloom.functions.binding import let, lookup, pinned

# Bases by rank in the reporting cycle, and by outlook; qualifiers that tell claims apart, in order.
RANK = {"projection": 0, "forecast": 0, "budgeted": 0, "target": 0, "estimate": 1, "provisional": 1, "actual": 2, "revised": 3, "restated": 3}
FORWARD = ("estimate", "projection", "forecast", "budgeted", "target", "provisional")
BACKWARD = ("actual", "revised", "restated")
QUALIFIERS = ("segment", "scope", "geography", "definition", "counterparty", "product", "channel", "category", "sector", "instrument", "maturity", "tenor")
#: Dimension of a differing qualifier, where it isn't scope.
QUALIFIER_DIMENSION = {"segment": "segment", "definition": "definition"}
#: Relation type, dimension, subtype and confidence of each rule.
OUTCOMES = {
    "not-comparable": ("dropped", None, None, None), "no-measure": ("escalate", None, None, None), "textual": ("escalate", None, None, None), "period-unknown": ("escalate", None, None, None), "too-far-apart": ("escalate", None, None, None),
    "period-differs-textual": ("reconciled", "period", "different_period", 0.8), "currency-differs": ("reconciled", "currency", "different_currency", 0.9), "unit-class-differs": ("reconciled", "definition", "different_unit_class", 0.85),
    "period-containment": ("refines", "period", "sub_period", 0.9), "period-differs": ("reconciled", "period", "different_period", 0.92), "qualifier-differs": ("reconciled", None, None, 0.88),
    "basis-supersedes": ("supersedes", "vintage", "later_statement", 0.88), "basis-differs": ("reconciled", None, "basis_differs", 0.87), "values-agree": ("corroborates", "none", None, 0.9), "values-disagree": ("contradicts", "none", "value_conflict", 0.82),
}
#: A rule's number is its place in OUTCOMES; period relations by number, and the day that stands for none.
NUMBER, RULES = {k: i for i, k in enumerate(OUTCOMES)}, tuple(OUTCOMES)
PERIOD_RELATIONS, NO_DAY = ("unknown", "identical", "contains", "contained_by", "partial", "disjoint"), -(2**31)
#: CND-2: partners that a fact is compared with at most; neighbours of the vector and lexical routes; least cosine.
MOST_PARTNERS, VECTOR_NEIGHBOURS, LEXICAL_NEIGHBOURS, LEAST_COSINE = 40, 12, 8, 0.82
#: Ids that one task ranks within a measure.
RANK_IDS = 65_536


def prepared(facts: DataFrame) -> DataFrame:
    """What depends on one fact alone, computed once a fact instead of once a pair, as numbers and keys that compare cheaply.

    own_key is the qualifiers in order, unit_key what units must share; outlook has a bit each for forward, backward and restating bases.
    """
    c, lit = F.col, F.lit
    own = F.array(*[F.lower(F.trim(F.coalesce(F.try_element_at("qualifiers", lit(k)), lit("")))) for k in QUALIFIERS])
    # a separator within a value is written as two other characters, so that equal keys are equal values
    plain = F.array_join("own", "\x01")
    escaped = F.array_join(F.transform("own", lambda x: F.replace(F.replace(x, lit("\x02"), lit("\x02b")), lit("\x01"), lit("\x02a"))), "\x01")
    own_key = F.when(plain.contains("\x02") | (F.length(plain) - F.length(F.replace(plain, lit("\x01"), lit(""))) >= len(QUALIFIERS)), escaped).otherwise(plain)
    label = F.coalesce(F.nullif("period_label", lit("")), F.concat(F.date_format("period_start", "yyyy-MM-dd"), lit(" to "), F.date_format("period_end", "yyyy-MM-dd")), lit("an unstated period"))
    basis = F.lower(F.trim(F.coalesce("basis", lit(""))))
    lu, lc = F.nullif("unit_class", lit("")), F.nullif("currency", lit(""))
    outlook = {b: 1 for b in FORWARD} | {b: 2 for b in BACKWARD} | {"revised": 6, "restated": 6}
    day = lambda name: F.coalesce(F.unix_date(name), lit(NO_DAY))
    # of one class, and of one currency if the class is known
    unit = F.when(lu.isNull(), "").otherwise(F.concat(F.length(lu).cast("string"), lit(":"), lu, F.coalesce(F.concat(lit("="), lc), lit(""))))
    return facts.withColumns({"places": units.decimal_places(c("value_base")), "own": own}).withColumns({
        "step": units.rounding_step(c("value_base"), c("places")), "basis": basis, "rank": F.coalesce(lookup(RANK, basis), lit(-1)), "outlook": F.coalesce(lookup(outlook, basis), lit(0)),
        "own_key": own_key, "unit_key": unit, "money": lc, "flat": units.tolerance_for(c("unit_class")), "scale": F.coalesce(F.nullif("unit_scale", lit(0.0)), lit(1.0)),
        "first_day": day("period_start"), "last_day": day("period_end"), "doubtful": F.coalesce(c("confidence") < 0.7, lit(False)), "period_text": label,
    })


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns]) for p in "lr")


_APART = "l_id < r_id and not (l_document_id = r_document_id and l_page_id = r_page_id)"


def measure_pairs(facts: DataFrame, new: Column | None = None, cap: int | None = None) -> DataFrame:
    """JON-6: pairs with one measure, l the smaller id, not of one page; with `new`, at least one of them new.

    An equi-join: period and page conditions stay residual, and adaptive execution splits a hot measure. With `cap`, a
    measure's facts are cut into runs of cap + 1 in the order of their ids and only pairs within a run are made: what
    taking pairs in order while both ends have room comes to, and linear in the facts of a measure.
    """
    rows = prepared(facts if new is None else facts.withColumn("is_new", new))
    rows = rows if cap is None else in_runs(rows, cap + 1)
    left, right = _sides(rows)
    same = F.col("l_measure_id") == F.col("r_measure_id")
    pairs = left.join(right, same if cap is None else same & (F.col("l_run") == F.col("r_run"))).where(_APART)
    return pairs if new is None else pairs.where("l_is_new or r_is_new")


def in_runs(facts: DataFrame, size: int) -> DataFrame:
    """facts with run: the number of each run of so many facts of a measure, by id.

    Facts are ranked within stretches of ids, and stretches by their counts, so no task ranks a whole hot measure.
    """
    rows = facts.where("measure_id is not null").withColumn("stretch", F.floor(F.col("id") / RANK_IDS))
    before = F.sum("n").over(Window.partitionBy("measure_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("measure_id", "stretch").agg(F.count(F.lit(1)).alias("n")).select("measure_id", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("measure_id", "stretch").orderBy("id")) - 1
    ranked = rows.withColumn("place", place).join(counts, ["measure_id", "stretch"])
    return ranked.withColumn("run", F.floor((F.col("place") + F.col("before")) / size)).drop("stretch", "place", "before")


def united(facts: DataFrame, routes: list[DataFrame], cap: int = MOST_PARTNERS) -> DataFrame:
    """CND-1, WIN-4, SRT-9: pairs of several routes (l_id, r_id, similarity, source), the first route that has a pair names it.

    Pairs of one page drop out. Of the others a fact keeps `cap` at either end, by similarity, then the measure route.
    """
    every = None
    for i, route in enumerate(routes):
        part = route.select(F.least("l_id", "r_id").alias("l_id"), F.greatest("l_id", "r_id").alias("r_id"), F.struct(F.lit(i).alias("route"), "similarity", "source").alias("first")).where("l_id <> r_id")
        every = part if every is None else every.unionByName(part)
    named = every.groupBy("l_id", "r_id").agg(F.min("first").alias("f")).select("l_id", "r_id", "f.similarity", "f.source")
    place = facts.select("id", "document_id", "page_id")
    left, right = (place.select(*[F.col(c).alias(f"{p}_{c}") for c in place.columns]) for p in "lr")
    apart = named.join(left, "l_id").join(right, "r_id").where(_APART).select("l_id", "r_id", "similarity", "source")
    order = (F.desc("similarity"), F.col("source") != "measure", "l_id", "r_id")
    for side in ("l_id", "r_id"):
        apart = apart.withColumn("place", F.row_number().over(Window.partitionBy(side).orderBy(*order))).where(F.col("place") <= cap).drop("place")
    return apart


def with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (l_id, r_id, …) with both facts' columns, ready for classify()."""
    left, right = _sides(prepared(facts))
    return pairs.join(left, "l_id").join(right, "r_id")


def _among(number: Column, names) -> Column:
    """Whether a rule's number is one of the named rules'."""
    return F.call_function("shiftright", F.lit(sum(1 << NUMBER[k] for k in names)), number).bitwiseAND(1) == 1


def classify(pairs: DataFrame) -> DataFrame:
    """REC-1: one ordered chain of conditions gives each pair its verdict; no row leaves the JVM.

    The chain yields the rule's number and is pinned there: a filter on what follows from it stays behind it. Its conditions are few
    and compare numbers or keys, because a compiled stage whose code is long is never optimised by the JVM.
    """
    c, n = F.col, lambda k: F.lit(NUMBER[k])
    ls, le, rs, re = (c(x) for x in ("l_first_day", "l_last_day", "r_first_day", "r_last_day"))
    relation = F.when(F.least(ls, le, rs, re) == NO_DAY, 0).when((ls == rs) & (le == re), 1).when((ls <= rs) & (le >= re), 2).when((rs <= ls) & (re >= le), 3).when((ls <= re) & (rs <= le), 4).otherwise(5)
    df = pairs.withColumns({
        "period_no": relation, "delta": units.relative_difference(c("l_value_base"), c("r_value_base")),
        "tolerance": units.rounding_tolerance(c("l_value_base"), c("r_value_base"), c("l_unit_class"), (c("l_step"), c("r_step")), F.least("l_flat", "r_flat")),
    })
    agrees = c("delta") <= c("tolerance")
    at_odds = F.when((c("l_rank") != c("r_rank")) & (c("l_rank") >= 0) & (c("r_rank") >= 0), n("basis-supersedes")).otherwise(n("basis-differs"))
    rule = (
        F.when(c("l_measure_id").isNull() | c("r_measure_id").isNull(), n("no-measure"))
        .when((c("l_measure_id") != c("r_measure_id")) | (c("l_entity") != c("r_entity")), n("not-comparable"))
        .when(c("delta").isNull(), F.when(c("period_no") >= 4, n("period-differs-textual")).otherwise(n("textual")))
        .when(c("l_unit_key") != c("r_unit_key"), F.when(c("l_money") != c("r_money"), n("currency-differs")).otherwise(n("unit-class-differs")))
        .when(c("period_no") == 0, n("period-unknown"))
        .when(c("period_no").isin(2, 3), n("period-containment"))
        .when(c("period_no") >= 4, n("period-differs"))
        .when(c("l_own_key") != c("r_own_key"), n("qualifier-differs"))
        .when(agrees, n("values-agree"))
        .when(c("l_basis") != c("r_basis"), at_odds)
        .when((c("delta") >= 0.5) | c("l_doubtful") | c("r_doubtful"), n("too-far-apart"))
        .otherwise(n("values-disagree"))
    )
    df = df.withColumn("rule_no", pinned(rule))  # the verdict's other parts follow from the rule that fired
    no = c("rule_no")
    by_rule = lambda i, kind: F.get(F.array(*[F.lit(v[i]) for v in OUTCOMES.values()]).cast(f"array<{kind}>"), no)
    differs = F.array_position(F.zip_with(F.split("l_own_key", "\x01"), F.split("r_own_key", "\x01"), lambda a, b: a != b), F.lit(True)).cast("int")
    df = df.withColumns({
        "rule_id": F.get(F.array(*map(F.lit, RULES)), no), "period_relation": F.get(F.array(*map(F.lit, PERIOD_RELATIONS)), c("period_no")),
        "basis_differs": c("l_basis") != c("r_basis"), "agrees": agrees, "cross_document": c("l_document_id") != c("r_document_id"), "scale_differs": c("l_scale") != c("r_scale"),
        "vintage": (c("l_outlook").bitwiseOR(c("r_outlook")).bitwiseAND(4) > 0) | (c("l_outlook").bitwiseOR(c("r_outlook")).bitwiseAND(3) == 3),
        "qualifier": F.when(no == NUMBER["qualifier-differs"], F.get(F.array(*map(F.lit, QUALIFIERS)), differs - 1)),
    })
    agree, bases = no == NUMBER["values-agree"], F.when(c("vintage"), "vintage").otherwise("basis")
    across, exact = agree & c("basis_differs"), c("delta") == 0
    by_qualifier = F.coalesce(lookup(QUALIFIER_DIMENSION, c("qualifier")), F.lit("scope"))
    severity = F.least(F.lit(1.0), (F.least(c("delta"), F.lit(1.0)) * 0.55 + (c("l_evidence_score") + c("r_evidence_score")) / 200 * 0.2 + (c("l_confidence") + c("r_confidence")) / 2 * 0.25)) * F.when(c("cross_document"), 1.0).otherwise(0.75)
    judged = _among(no, [k for k in OUTCOMES if k not in ("textual", "no-measure", "not-comparable", "period-differs-textual", "currency-differs", "unit-class-differs")])
    return df.withColumns({
        "relation_type": by_rule(0, "string"),
        "dimension": F.when(c("qualifier").isNotNull(), by_qualifier).when(across | (no == NUMBER["basis-differs"]), bases).when(agree & c("scale_differs"), "unit_scale").otherwise(by_rule(1, "string")),
        "subtype": F.when(c("qualifier").isNotNull(), F.concat(c("qualifier"), F.lit("_differs"))).when(~agree, by_rule(2, "string")).when(c("basis_differs"), "agrees_across_basis").when(c("scale_differs"), "scale_equivalent").when(exact, "exact").otherwise("within_rounding"),
        "rule_confidence": F.when(agree & exact, 0.95).otherwise(by_rule(3, "double")),
        "delta_relative": F.when(judged, c("delta")), "delta_absolute": F.when(judged, F.abs(c("l_value_base") - c("r_value_base"))),
        "severity": F.when(no == NUMBER["values-disagree"], F.round(severity, 3)).otherwise(0.0),
        "superseded_id": F.when(no == NUMBER["basis-supersedes"], F.when(c("l_rank") < c("r_rank"), c("l_id")).otherwise(c("r_id"))),
    })


def explained(relations: DataFrame) -> DataFrame:
    """REC-11, REC-12: classify()'s rows with explanation, for verdicts, and note, for escalations; in words of our own."""
    c, lit = F.col, F.lit
    l_value, r_value, l_time, r_time = (F.coalesce(c(x), lit("no value")) for x in ("l_value_text", "r_value_text", "l_period_text", "r_period_text"))
    say = lambda *parts: F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])
    named = lambda b: F.coalesce(F.nullif(b, lit("")), lit("not stated"))
    share = percent(c("delta_relative"))
    stale_left = c("superseded_id") == c("l_id")
    quoted = lambda side: F.coalesce(F.nullif(F.try_element_at(f"{side}_qualifiers", "qualifier"), lit("")), lit("not stated"))
    newer = lambda one, other: F.when(stale_left, c(f"r_{one}")).otherwise(c(f"l_{one}")) if other else F.when(stale_left, c(f"l_{one}")).otherwise(c(f"r_{one}"))
    value = lambda x: F.coalesce(x, lit("no value"))
    same = F.when(c("scale_differs"), say(l_value, " and ", r_value, " for ", l_time, " are one amount at two scales.")).when(c("delta_relative") == 0, say("Both give ", l_value, " for ", l_time, ".")).otherwise(say(l_value, " and ", r_value, " for ", l_time, " agree to the precision given."))
    texts = {
        "period-differs-textual": say("The periods differ: ", l_time, " and ", r_time, "."),
        "currency-differs": say("One value is in ", c("l_currency"), ", the other in ", c("r_currency"), "; nothing is converted."),
        "unit-class-differs": say("Different kinds of unit: ", F.coalesce(c("l_unit_class"), lit("unknown")), " and ", F.coalesce(c("r_unit_class"), lit("unknown")), "."),
        "period-containment": say("One period lies within the other: ", l_time, " and ", r_time, "."),
        "period-differs": say("The periods differ: ", l_time, " and ", r_time, "."),
        "qualifier-differs": say("For ", l_time, ", ", c("qualifier"), " is '", quoted("l"), "' in one and '", quoted("r"), "' in the other."),
        "basis-supersedes": say("For ", l_time, ", ", value(newer("value_text", True)), " (", newer("basis", True), ") replaces ", value(newer("value_text", False)), " (", newer("basis", False), ")."),
        "basis-differs": say("For ", l_time, ", one value is ", named(c("l_basis")), " and the other ", named(c("r_basis")), "."),
        "values-agree": F.concat(same, F.when(c("basis_differs"), say(" Their bases differ: ", named(c("l_basis")), " and ", named(c("r_basis")), ".")).otherwise("")),
        "values-disagree": say("For ", l_time, " on one basis, ", l_value, " and ", r_value, " differ by ", share, "."),
    }
    notes = {"no-measure": lit("a fact has no measure"), "textual": lit("no values to compare"), "period-unknown": lit("a period is unknown"), "too-far-apart": say("one measure, entity and period, but the values differ by ", share)}

    def pick(table):
        out = F
        for k, v in table.items():
            out = out.when(c("rule_no") == NUMBER[k], v)
        return out

    return relations.withColumns({"explanation": pick(texts), "note": pick(notes)})


def percent(share: Column) -> Column:
    """A share in per cent with one decimal: the nearest to the number's exact value in binary, the even one of two as near."""
    # twenty times x is the sum of two exact numbers: twice and the rest tell exactly on which side of a half it lies
    def tenths(x: Column, twice: Column, low: Column) -> Column:
        over, rest = twice - (low * 2 + 1), x * 4 - (twice - x * 16)
        return low + F.when((over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (low % 2 == 1)))), 1).otherwise(0)

    said = lambda n: F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("%"))
    exact = lambda x: let(x * 16 + x * 4, lambda twice: let(F.floor(twice / 2), lambda low: let(tenths(x, twice, low), said)))
    return let(share * 100, lambda x: F.when(F.isnan(x), "nan%").when(x > 1e12, "inf%").otherwise(exact(x)))


def informative(classified: DataFrame) -> DataFrame:
    """FLT-13: decided relations, without those of a single document that only differ in period.

    Both follow from the rule.
    """
    decided = {k: v for k, v in OUTCOMES.items() if v[0] not in ("escalate", "dropped")}
    across = [k for k, v in decided.items() if (v[0], v[1]) != ("reconciled", "period")]
    return classified.where(_among(F.col("rule_no"), decided) & (F.col("cross_document") | _among(F.col("rule_no"), across)))


def relations(facts: DataFrame, cap: int | None = MOST_PARTNERS, where: str | None = None) -> DataFrame:
    """Decided relations of every fact with up to `cap` others of its measure; `where`: a condition on the facts' own columns (l_…, r_…)

    that is tried before pairs are judged. A filter on the result is tried behind that.
    """
    pairs = measure_pairs(facts, cap=cap)
    return informative(classify(pairs if where is None else pairs.where(where)))
