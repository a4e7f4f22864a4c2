"""What readers of facts, relations and documents get: projections, counterparts, exports, cases and metrics (PRJ, JON-5, SNK, CAS, AGG, SRT).

Dimensions (documents, pages, measures) are joined on their keys; the optimiser broadcasts them while they are small.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Facts of a case pool, by kind of relation; examples that a case shows (CAS-1..5, SRT-11).
POOL, OTHER_POOL, EXAMPLES = 300, 100, 3


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """AGG-2: a rounded share, 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole, places)).otherwise(0.0)


def titled(documents: DataFrame) -> DataFrame:
    """PRJ-1: documents with title, which falls back to the file's name."""
    return documents.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "filename"))


def _per_document(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("document_id").agg((F.sum("n") if "n" in rows.columns else F.count(F.lit(1))).alias(name))


def relation_ends(relations: DataFrame) -> DataFrame:
    """JON-1: how many (n) relations touch a document, by their other document: counted before they are doubled."""
    both = relations.groupBy("l_document_id", "r_document_id").agg(F.count(F.lit(1)).alias("n"))
    return both.select("n", F.explode(F.array_distinct(F.array("l_document_id", "r_document_id"))).alias("document_id"))


def document_summaries(documents: DataFrame, facts: DataFrame, relations: DataFrame, rejections: DataFrame) -> DataFrame:
    """PRJ-1, AGG-9: documents with what they have of each; every side is counted before it is joined."""
    out = titled(documents)
    for rows, name in ((facts, "fact_count"), (relation_ends(relations), "relation_count"), (rejections, "rejection_count")):
        out = out.join(_per_document(rows, name), "document_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def document_details(summaries: DataFrame, pages: DataFrame) -> DataFrame:
    """PRJ-2: summaries with pages: array of structs, by number."""
    own = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "printed_label", "page_type", "extracted"))).alias("pages"))
    return summaries.join(own, "document_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(own.schema["pages"].dataType)))


def fact_summaries(facts: DataFrame, documents: DataFrame, pages: DataFrame, measures: DataFrame) -> DataFrame:
    """PRJ-3, JON-3: facts with measure's name, evidence and source as structs; a missing dimension leaves nulls."""
    source = titled(documents).select("document_id", F.col("title").alias("document_title"), "publisher")
    named = measures.select(F.col("id").alias("measure_id"), F.col("name").alias("measure"))
    rows = facts.join(source, "document_id", "left").join(pages.select("document_id", "page_id", "page_number", "printed_label"), ["document_id", "page_id"], "left").join(named, "measure_id", "left")
    evidence = F.struct(F.round("evidence_score", 1).alias("score"), (F.col("evidence_score") >= 100).alias("exact"), F.col("value_text").alias("quote"))
    return rows.withColumns({"confidence": F.round("confidence", 3), "evidence": evidence, "source": F.struct("document_id", "document_title", "publisher", "page_number", "printed_label")})


def counterparts(relations: DataFrame) -> DataFrame:
    """JON-5: each relation from either side: fact_id, other_id and the relation's columns."""
    turned = lambda a, b: F.struct(F.col(f"{a}_id").alias("fact_id"), F.col(f"{b}_id").alias("other_id"))
    kept = ("relation_type", "dimension", "rule_confidence", "severity")
    return relations.select("l_id", "r_id", *kept).select(F.explode(F.array(turned("l", "r"), turned("r", "l"))).alias("e"), *kept).select("e.fact_id", "e.other_id", *kept)


def fact_details(summaries: DataFrame, relations: DataFrame) -> DataFrame:
    """PRJ-4: summaries with relations: array of structs, the most severe first."""
    own = counterparts(relations).groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("order"), "other_id", "relation_type", "dimension"))).alias("relations"))
    return summaries.join(own, "id", "left").withColumn("relations", F.coalesce("relations", F.array().cast(own.schema["relations"].dataType)))


def relation_summaries(relations: DataFrame, summaries: DataFrame) -> DataFrame:
    """PRJ-5, JON-4: relations with both facts' summaries; rows that lack a side drop out."""
    side = lambda p, name: summaries.select(F.col("id").alias(f"{p}_id"), F.struct("id", "measure", "value_text", "source").alias(name))
    return relations.join(side("l", "left"), "l_id").join(side("r", "right"), "r_id")


def measure_summaries(measures: DataFrame, facts: DataFrame) -> DataFrame:
    """PRJ-6, AGG-10, AGG-11: measures with their facts, documents and first document."""
    own = facts.groupBy(F.col("measure_id").alias("id")).agg(F.count(F.lit(1)).alias("fact_count"), F.count_distinct("document_id").alias("document_count"), F.min_by("document_id", "id").alias("first_document"))
    return measures.join(own, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fact_count", "document_count")})


#: SRT-4: orders of measures by name.
MEASURE_ORDERS = {"facts": ("-fact_count", "name"), "documents": ("-document_count", "-fact_count"), "recent": ("-id",), "name": ("name",)}


def ordered(df: DataFrame, order: tuple[str, ...], limit: int, *tie: str) -> DataFrame:
    """The first rows by columns (a minus: descending) and then by tie."""
    by = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in (*order, *tie)]
    return df.orderBy(*by).limit(limit)


#: SRT-1: keys of facts; any other sorts by id.
FACT_ORDERS = {"confidence": "confidence", "value": "value_base", "period": "period_start", "page": "page_id", "id": "id"}


def fact_page(facts: DataFrame, sort: str = "id", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """SRT-1: a page of facts, 1 to 500 of them; nulls come first, as the least values."""
    key = F.col(FACT_ORDERS.get(sort, "id"))
    return facts.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "id").offset(max(0, offset)).limit(min(500, max(1, limit)))


def sampled(facts: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """SRT-10: n facts that look drawn at random, the same on every run and cluster."""
    return facts.orderBy(F.md5(F.concat_ws("/", "id", F.lit(seed)).cast("binary")), "id").limit(n)


def adjudication_text(facts: DataFrame, page_text: str, start: str, reach: int = 420, most: int = 1200) -> DataFrame:
    """PRJ-9, ADJ-3: facts as a model would read them: what is claimed, and the text around its evidence."""
    q = F.array_join(F.transform(F.array_sort(F.map_entries("qualifiers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    lines = {"value": F.col("value_text"), "period": F.coalesce("period_label", F.lit("not stated")), "basis": F.coalesce(F.nullif("basis", F.lit("")), F.lit("not stated")), "qualifiers": F.coalesce(F.nullif(q, F.lit("")), F.lit("none"))}
    first = F.greatest(F.lit(1), F.col(start) - reach)
    around = F.left(F.substring(F.col(page_text), first, F.col(start) + reach - first), F.lit(most))
    return facts.withColumns({"claim": F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in lines.items()]), "context": around})


class Part(NamedTuple):
    """The first `most` rows by `order` (columns without nulls, a minus: descending), of those whose `column` is `name` if a column is given."""

    name: str
    order: tuple[str, ...]
    most: int
    column: str | None = None


def _first(table: pa.Table, part: Part) -> pa.Table:
    return table.sort_by([(c.lstrip("-"), "descending" if c[0] == "-" else "ascending") for c in part.order]).slice(0, part.most) if table.num_rows else table


def _ahead(rows: pa.RecordBatch, held: pa.Table, part: Part) -> np.ndarray:
    """Which rows come before the last one that is held."""
    before, level = np.zeros(rows.num_rows, bool), np.ones(rows.num_rows, bool)
    for c in part.order:
        v, w = rows.column(c.lstrip("-")).to_numpy(zero_copy_only=False), held.column(c.lstrip("-"))[-1].as_py()
        before |= level & (v > w if c[0] == "-" else v < w)
        level &= v == w
    return before


def leading(rows: DataFrame, *parts: Part) -> DataFrame:
    """SET-5, SRT-11: the first rows of every part, with its name as `part`, in one pass over rows that are dear to make.

    A task holds the first rows of each part; those of tasks meet in lots, and lots in a task a part.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.StringType()), T.StructField("lot", T.IntegerType())])
    names = schema.names

    def run(batches):
        held: dict[str, pa.Table] = {}
        for b in batches:
            for p in parts:
                own = b if p.column is None else b.filter(pa.compute.equal(b.column(p.column), p.name))
                if p.name in held and held[p.name].num_rows == p.most:
                    own = own.filter(pa.array(_ahead(own, held[p.name], p)))
                if own.num_rows:
                    new = pa.Table.from_batches([own])
                    held[p.name] = _first(pa.concat_tables([held[p.name], new]) if p.name in held else new, p).combine_chunks()
        lot = TaskContext.get().partitionId() % 64
        for name, t in held.items():
            t = t.append_column("part", pa.array([name] * t.num_rows, pa.string())).append_column("lot", pa.array([lot] * t.num_rows, pa.int32()))
            yield from t.to_batches()

    by_name = {p.name: p for p in parts}
    fold = lambda t: _first(t.select(names), by_name[t.column("part")[0].as_py()])
    return rows.mapInArrow(run, schema).groupBy("part", "lot").applyInArrow(fold, schema).groupBy("part").applyInArrow(fold, schema).drop("lot")


def case_pool(relations: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """SET-5, SRT-11: the strongest relations of each kind, in one table: cross-document first, then by confidence."""
    return leading(relations, *[Part(kind, ("-cross_document", "-rule_confidence", "l_id", "r_id"), n, "relation_type") for kind, n in kinds.items()])


def _score(*terms: tuple[Column | None, Column | float, str | None]) -> tuple[Column, Column]:
    """(sum, reasons) of terms: condition (none: always), what it adds, and what it is called."""
    total, reasons = F.lit(0.0), []
    for when, adds, why in terms:
        value = adds if isinstance(adds, Column) else F.lit(float(adds))
        total = total + (value if when is None else F.when(when, value).otherwise(0.0))
        if why:
            reasons.append(F.lit(why) if when is None else F.when(when, why))
    return F.round(total, 6), F.array_compact(F.array(*reasons))


def cases(relations: DataFrame, kind: str) -> DataFrame:
    """CAS-1..3, CAS-5, WIN-5: the three best examples of a kind, with case_score and why each was taken (selected_because).

    kind: corroborates, contradicts or reconciled (which refining and superseding pairs belong to).
    """
    c = F.col
    needed = {"corroborates": ("scale_differs", "wording", "predicates_differ"), "contradicts": ("severity", "l_evidence_score", "r_evidence_score"), "reconciled": ("dimension", "delta_relative")}
    relations = relations.select("l_id", "r_id", "relation_type", "cross_document", "rule_confidence", *needed[kind])
    cross = (c("cross_document"), 1.5 if kind != "reconciled" else 1.0, "two documents")
    if kind == "corroborates":
        pool = case_pool(relations, {kind: POOL})
        score, why = _score((None, c("rule_confidence"), None), cross, (c("scale_differs"), 1.2, "two scales"), (c("wording") < 70, 0.8, "other words"), (c("predicates_differ"), 0.5, "other names"))
    elif kind == "contradicts":
        pool = case_pool(relations, {kind: POOL})
        score, why = _score((None, c("severity") + c("rule_confidence"), None), cross, ((c("l_evidence_score") >= 100) & (c("r_evidence_score") >= 100), 0.4, "both quoted exactly"))
    else:
        pool = case_pool(relations, {"reconciled": POOL, "refines": OTHER_POOL, "supersedes": OTHER_POOL}).where("dimension <> 'none'")
        score, why = _score((None, c("rule_confidence"), None), (c("delta_relative").isNotNull(), 2 * F.least("delta_relative", F.lit(1.0)), "values far apart"), (c("relation_type") == "supersedes", 0.5, "one replaces the other"), cross)
    return ordered(pool.withColumns({"case_score": score, "selected_because": why}), ("-case_score", "-cross_document", "-rule_confidence"), EXAMPLES, "l_id", "r_id")


def failures(rejections: DataFrame, kept: int) -> DataFrame:
    """CAS-4, WIN-6: the four most frequent reasons, each with its newest rejection, and the share of proposals that passed."""
    by = rejections.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("newest"), F.max_by("document_id", "id").alias("document_id"))
    total = by.agg(F.sum("n")).first()[0] or 0
    return ordered(by, ("-n",), 4, "reason").withColumn("pass_rate", rate(F.lit(kept), F.lit(kept + total), 3))


def cross_check(verdicts: DataFrame) -> DataFrame:
    """AGG-19: of pairs asked in both orders: agreed, order sensitive, dropped, and the share that agreed."""
    lost = F.col("first").isin("unrelated") | F.col("second").isin("unrelated")
    n = verdicts.agg(F.count_if(~lost & (F.col("first") == F.col("second"))).alias("agreed"), F.count_if(~lost & (F.col("first") != F.col("second"))).alias("order_sensitive"), F.count_if(lost).alias("dropped"))
    return n.withColumn("agreement_rate", rate(F.col("agreed"), F.col("agreed") + F.col("order_sensitive")))


def usage(calls: DataFrame) -> DataFrame:
    """AGG-7, AGG-21: calls by purpose: all, cached, billed, failed, tokens in and out."""
    return calls.groupBy("purpose").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"), F.count_if(~F.col("cached") & ~F.col("failed")).alias("billed"), F.count_if("failed").alias("failed"), F.sum(F.when(~F.col("cached"), F.col("tokens_in"))).alias("tokens_in"), F.sum(F.when(~F.col("cached"), F.col("tokens_out"))).alias("tokens_out"),
    )


def ingest_stats(facts: DataFrame, rejections: DataFrame) -> DataFrame:
    """AGG-20: per document proposed, kept, rejected and the share kept."""
    both = _per_document(facts, "kept").join(_per_document(rejections, "rejected"), "document_id", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kept", "rejected")})
    return both.withColumn("proposed", F.col("kept") + F.col("rejected")).withColumn("pass_rate", rate(F.col("kept"), F.col("proposed"), 3))


def scan_warnings(documents: DataFrame) -> DataFrame:
    """DUP-2: shares of scanned and OCR pages; a warning from half on."""
    share = rate(F.col("scanned_pages"), F.col("page_count"))
    return documents.withColumns({"scanned_share": share, "ocr_share": rate(F.col("ocr_pages"), F.col("page_count")), "warn": share >= 0.5})
