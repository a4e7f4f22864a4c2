"""Grounding: candidates are kept only with evidence found in their page (GRD-1..9, GRD-11, WIN-3).

Exact work is Columns; only candidates whose quote isn't found exactly go through the fuzzy search,
an Arrow-batched function.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import fuzzy, units
from claimloom.functions import text as T

# Subjects and predicates that name nothing, and words that carry no meaning alone.
VAGUE_SUBJECTS = ("it", "the company", "the group", "company", "group", "they", "this", "the document", "n/a", "unknown", "-")
NO_MEASURES = (
    "was", "were", "is", "are", "has", "have", "had", "increased to", "decreased to", "increased by", "decreased by", "rose to", "fell to", "grew to", "amounted to", "stood at", "as at", "as of",
    "total", "value", "amount", "number", "figure", "data", "item", "line item", "particulars", "details", "description", "name", "type", "category", "status", "note", "notes", "other", "others", "misc", "n/a",
)
FUNCTION_WORDS = ("the", "a", "an", "of", "in", "for", "to", "at", "on", "by", "and", "or", "as", "was", "were", "is", "are", "with", "from")
NEAR = 24


def names_a_measure(predicate: Column) -> Column:
    """GRD-3: none of the phrases above, and something is left without function words and single letters."""
    phrase = F.lower(T.collapse(predicate))
    words = F.filter(F.regexp_extract_all(phrase, F.lit("[a-z0-9%]+"), F.lit(0)), lambda w: ~w.isin(*FUNCTION_WORDS) & (F.length(w) > 1))
    return ~phrase.isin(*NO_MEASURES) & (F.length(F.trim(predicate)) >= 3) & (F.size(words) > 0)


def value_supported(page: Column, start: Column, end: Column, value: Column, number: Column | None = None) -> Column:
    """GRD-7: the value, literally or as a number, within NEAR characters of the quote."""
    first = F.greatest(start - NEAR, F.lit(0))
    around = F.substring(page, first + 1, end - first + NEAR)
    wanted = units.parse_number(value) if number is None else F.coalesce(number, units.parse_number(value))
    close = lambda x: F.abs(x - F.abs(wanted)) <= 1e-6 * F.greatest(x, F.abs(wanted))  # noqa: E731  a sign may stand apart
    near = F.exists(F.regexp_extract_all(around, F.lit(r"\d(?:[\d,.\s]*\d)?"), F.lit(0)), lambda m: close(units.parse_number(m)))
    return F.contains(F.lower(T.collapse(around)), F.lower(T.collapse(value))) | F.coalesce(near, F.lit(False))


def shape(candidates: DataFrame, least: float = 0.25) -> Column:
    """GRD-2..4: the first reason against a candidate's form, else null."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    subject = F.trim("subject")
    return (
        F.when(blank("statement") | blank("subject") | blank("predicate") | blank("value_text") | blank("evidence_quote"), "missing_required_fields")
        .when(F.length(F.trim("evidence_quote")) < 2, "quote_too_short")
        .when((F.length(subject) < 2) | F.lower(subject).isin(*VAGUE_SUBJECTS), "subject_unresolved")
        .when(~names_a_measure(F.col("predicate")), "predicate_unresolved")
        .when(F.coalesce(F.col("confidence"), F.lit(0.6)) < least, "low_confidence")
    )


def ground(candidates: DataFrame) -> DataFrame:
    """GRD-1: candidates (page_id, position, page_text and the candidate's fields) with reason (null: kept), start, end, score, exact.

    period and qualifiers are used if present: facts of one quote and value for different periods or scopes are no copies.
    """
    df = candidates.withColumn("reason", shape(candidates))
    quote, page = F.trim("evidence_quote"), F.col("page_text")
    folded = lambda c: F.lower(T.collapse(c))
    times = T.occurrences(folded(page), folded(quote))
    short = F.size(F.split(quote, r"\s+")) < 2
    df = df.withColumn("reason", F.coalesce("reason", F.when(short, F.when(times == 0, "quote_not_found").when(times > 1, "ambiguous_short_quote"))))
    at = F.instr(page, quote)
    df = df.withColumns({"start": F.when(at > 0, at - 1), "end": F.when(at > 0, at - 1 + F.length(quote)), "score": F.when(at > 0, 100.0), "exact": at > 0})
    fine, rest = df.where("reason is not null or start is not null"), df.where("reason is null and start is null")
    names = df.columns

    def search(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_text", "evidence_quote", "value_text")))
            found = [fuzzy.locate(p or "", q or "") or fuzzy.locate_cell(p or "", q or "", v or "") for p, q, v in rows]
            new = {
                "reason": pa.array([None if f else "quote_not_found" for f in found], pa.string()), "start": pa.array([f and f[0] for f in found], pa.int32()), "end": pa.array([f and f[1] for f in found], pa.int32()),
                "score": pa.array([f and f[2] for f in found], pa.float64()), "exact": pa.array([bool(f and f[3]) for f in found], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in names], names=names)

    df = fine.unionByName(rest.mapInArrow(search, df.schema))
    df = df.withColumn("reason", F.coalesce("reason", F.when(~value_supported(page, F.col("start"), F.col("end"), F.col("value_text")), "value_absent_from_quote")))
    scope = [F.to_json(F.array_sort(F.map_entries("qualifiers")))] if "qualifiers" in names else []
    alike = [folded(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "predicate", "value_text", "period") if c in names]
    same = Window.partitionBy("page_id", F.col("reason").isNull(), *alike, *scope, "start").orderBy("position")
    return df.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(same) > 1, "duplicate_of_existing_fact")))


def unattributed(pages: DataFrame) -> DataFrame:
    """GRD-9: rejections of values that an extractor reported without a subject; pages: page_id, entries: array of (value_text, reason)."""
    rows = pages.select("page_id", F.explode("entries").alias("e")).where(F.coalesce(F.trim("e.value_text"), F.lit("")) != "")
    return rows.select("page_id", F.trim("e.value_text").alias("value_text"), F.lit("unattributed_by_model").alias("reason"), F.coalesce(F.nullif(F.trim("e.reason"), F.lit("")), F.lit("no subject and measure could be attached")).alias("detail"))


def audited(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """GRD-11: stored facts (page_id, evidence_quote, start, end, value_text) with finding: ok, page_missing, moved or value_absent."""
    rows = facts.join(pages.select("page_id", "page_text"), "page_id", "left")
    there = F.substring(F.col("page_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    supported = value_supported(F.col("page_text"), F.col("start"), F.col("end"), F.col("value_text"))
    return rows.withColumn("finding", F.when(F.col("page_text").isNull(), "page_missing").when(there != F.col("evidence_quote"), "moved").when(~supported, "value_absent").otherwise("ok")).drop("page_text")
