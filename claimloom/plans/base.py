"""Registration of queries with their SQL, and the SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.operators import reconcile
from claimloom.sources import claims

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def sql_of() -> dict[str, str]:
    return dict(_SQL)


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _step(v: str) -> str:
    whole, dec = f"floor(abs({v}))", f"length(rtrim(split_part(printf('%.10f', abs({v}) - floor(abs({v}))), '.', 2), '0'))"
    zeros = f"CASE WHEN printf('%.0f', {whole}) = '0' THEN 0 ELSE length(printf('%.0f', {whole})) - length(rtrim(printf('%.0f', {whole}), '0')) END"
    return f"CASE WHEN {dec} > 0 THEN CAST('5e-' || ({dec} + 1) AS DOUBLE) ELSE CAST('5e' || ({zeros} - 1) AS DOUBLE) END"


_FWD, _BWD = ", ".join(f"'{x}'" for x in reconcile.FORWARD), ", ".join(f"'{x}'" for x in reconcile.BACKWARD)


def _rank(b: str) -> str:
    return "CASE " + b + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in reconcile.RANK.items()) + " END"


def _differs(column: str) -> str:
    return f"lower(trim(coalesce(l_{column}, ''))) <> lower(trim(coalesce(r_{column}, '')))"


#: Facts with their place in their measure; every pair of a measure; those of one run of facts.
FACTS = f"facts AS (SELECT *, row_number() OVER (PARTITION BY measure_id ORDER BY id) AS place FROM ({claims.FACTS_SQL}))"
_SIDES = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "lr" for c in [*claims.COLUMNS, "place"])
PAIRS = FACTS + f""", every AS (SELECT {_SIDES} FROM facts l JOIN facts r ON l.measure_id = r.measure_id
  WHERE l.id < r.id AND NOT (l.document_id = r.document_id AND l.page_id = r.page_id)),
pairs AS (SELECT * FROM every WHERE (l_place - 1) // {reconcile.MOST_PARTNERS + 1} = (r_place - 1) // {reconcile.MOST_PARTNERS + 1})"""
#: The same over every pair of a measure.
EVERY_PAIR = PAIRS[: PAIRS.index(" WHERE (l_place")] + ")"
_VERDICTS = f""", p1 AS (SELECT *,
  CASE WHEN l_period_start IS NULL OR r_period_start IS NULL OR l_period_end IS NULL OR r_period_end IS NULL THEN 'unknown'
       WHEN l_period_start = r_period_start AND l_period_end = r_period_end THEN 'identical'
       WHEN l_period_start <= r_period_start AND l_period_end >= r_period_end THEN 'contains'
       WHEN r_period_start <= l_period_start AND r_period_end >= l_period_end THEN 'contained_by'
       WHEN l_period_start <= r_period_end AND r_period_start <= l_period_end THEN 'partial' ELSE 'disjoint' END AS pr,
  CASE WHEN l_value_base = r_value_base THEN 0.0 ELSE abs(l_value_base - r_value_base) / CASE WHEN l_value_base IS NULL OR r_value_base IS NULL THEN NULL ELSE greatest(abs(l_value_base), abs(r_value_base)) END END AS delta,
  greatest(CASE WHEN l_unit_class IN ('currency', 'count') THEN CAST(5e-4 AS DOUBLE) ELSE CAST(1e-3 AS DOUBLE) END, least(greatest({_step("l_value_base")}, {_step("r_value_base")}) / greatest(abs(l_value_base), abs(r_value_base)), CAST(0.05 AS DOUBLE))) AS tol,
  lower(trim(coalesce(l_basis, ''))) AS lb, lower(trim(coalesce(r_basis, ''))) AS rb,
  l_unit_class IS NOT DISTINCT FROM r_unit_class AND (l_unit_class IS NULL OR l_currency IS NOT DISTINCT FROM r_currency) AS comparable,
  CASE WHEN {_differs("segment")} THEN 'segment' WHEN {_differs("geography")} THEN 'geography' WHEN {_differs("definition")} THEN 'definition' END AS qd FROM pairs),
p2 AS (SELECT *, lb <> rb AS bd, delta <= tol AS agrees, {_rank("lb")} AS lk, {_rank("rb")} AS rk,
  ((lb IN ({_FWD}) AND rb IN ({_BWD})) OR (rb IN ({_FWD}) AND lb IN ({_BWD})) OR lb IN ('revised', 'restated') OR rb IN ('revised', 'restated')) AS vint FROM p1),
verdicts AS (SELECT *, l_document_id <> r_document_id AS cross_document,
  CASE WHEN l_entity <> r_entity THEN 'not-comparable' WHEN l_value_base IS NULL OR r_value_base IS NULL THEN CASE WHEN pr IN ('disjoint', 'partial') THEN 'period-differs-textual' ELSE 'textual' END
       WHEN NOT comparable THEN CASE WHEN l_currency <> r_currency THEN 'currency-differs' ELSE 'unit-class-differs' END WHEN pr = 'unknown' THEN 'period-unknown'
       WHEN pr IN ('contains', 'contained_by') THEN 'period-containment' WHEN pr IN ('disjoint', 'partial') THEN 'period-differs' WHEN qd IS NOT NULL THEN 'qualifier-differs'
       WHEN bd AND NOT agrees AND lk <> rk THEN 'basis-supersedes' WHEN bd AND NOT agrees THEN 'basis-differs' WHEN agrees THEN 'values-agree'
       WHEN delta >= 0.5 OR l_confidence < 0.7 OR r_confidence < 0.7 THEN 'too-far-apart' ELSE 'values-disagree' END AS rule_id FROM p2),
relations AS (SELECT *, CASE rule_id WHEN 'not-comparable' THEN 'dropped' WHEN 'textual' THEN 'escalate' WHEN 'period-unknown' THEN 'escalate' WHEN 'too-far-apart' THEN 'escalate' WHEN 'period-containment' THEN 'refines'
       WHEN 'basis-supersedes' THEN 'supersedes' WHEN 'values-agree' THEN 'corroborates' WHEN 'values-disagree' THEN 'contradicts' ELSE 'reconciled' END AS relation_type,
  CASE WHEN rule_id IN ('period-differs-textual', 'period-containment', 'period-differs') THEN 'period' WHEN rule_id = 'currency-differs' THEN 'currency' WHEN rule_id = 'unit-class-differs' THEN 'definition' WHEN rule_id = 'qualifier-differs' THEN CASE qd WHEN 'geography' THEN 'scope' ELSE qd END
       WHEN rule_id = 'basis-supersedes' THEN 'vintage' WHEN rule_id = 'basis-differs' OR (rule_id = 'values-agree' AND bd) THEN CASE WHEN vint THEN 'vintage' ELSE 'basis' END
       WHEN rule_id = 'values-agree' THEN CASE WHEN l_unit_scale <> r_unit_scale THEN 'unit_scale' ELSE 'none' END WHEN rule_id = 'values-disagree' THEN 'none' END AS dimension,
  CASE WHEN rule_id IN ('period-differs-textual', 'period-differs') THEN 'different_period' WHEN rule_id = 'period-containment' THEN 'sub_period' WHEN rule_id = 'currency-differs' THEN 'different_currency' WHEN rule_id = 'unit-class-differs' THEN 'different_unit_class'
       WHEN rule_id = 'qualifier-differs' THEN qd || '_differs' WHEN rule_id = 'basis-supersedes' THEN 'later_statement' WHEN rule_id = 'basis-differs' THEN 'basis_differs' WHEN rule_id = 'values-disagree' THEN 'value_conflict'
       WHEN rule_id = 'values-agree' THEN CASE WHEN bd THEN 'agrees_across_basis' WHEN l_unit_scale <> r_unit_scale THEN 'scale_equivalent' WHEN delta = 0 THEN 'exact' ELSE 'within_rounding' END END AS subtype,
  CASE rule_id WHEN 'period-differs-textual' THEN 0.8 WHEN 'currency-differs' THEN 0.9 WHEN 'unit-class-differs' THEN 0.85 WHEN 'period-containment' THEN 0.9 WHEN 'period-differs' THEN 0.92 WHEN 'qualifier-differs' THEN 0.88
       WHEN 'basis-supersedes' THEN 0.88 WHEN 'basis-differs' THEN 0.87 WHEN 'values-agree' THEN CASE WHEN delta = 0 THEN 0.95 ELSE 0.9 END WHEN 'values-disagree' THEN 0.82 END::DOUBLE AS rule_confidence,
  CASE WHEN rule_id = 'values-disagree' THEN round(least(1.0, least(delta, 1.0) * 0.55::DOUBLE + (l_evidence_score + r_evidence_score) / 200 * 0.2::DOUBLE + (l_confidence + r_confidence) / 2 * 0.25::DOUBLE) * CASE WHEN l_document_id <> r_document_id THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END, 3) ELSE 0.0::DOUBLE END AS severity,
  CASE WHEN rule_id NOT IN ('not-comparable', 'textual', 'period-differs-textual', 'currency-differs', 'unit-class-differs') THEN delta END AS delta_relative,
  CASE WHEN rule_id NOT IN ('not-comparable', 'textual', 'period-differs-textual', 'currency-differs', 'unit-class-differs') THEN abs(l_value_base - r_value_base) END AS delta_absolute FROM verdicts),
decided AS (SELECT * FROM relations WHERE relation_type NOT IN ('escalate', 'dropped') AND (cross_document OR NOT (relation_type = 'reconciled' AND dimension = 'period')))"""
VERDICTS, ALL_VERDICTS = PAIRS + _VERDICTS, EVERY_PAIR + _VERDICTS
