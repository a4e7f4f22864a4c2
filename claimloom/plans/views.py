"""Queries of projections, exports, cases, sorts and metrics, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import reconcile
from claimloom.operators import views as V
from claimloom.plans.base import ALL_VERDICTS, FACTS, VERDICTS, query, rows_of
from claimloom.sources import claims

_DIMENSIONS = f"d AS ({claims.DOCUMENTS_SQL}), pg AS ({claims.PAGES_SQL}), m AS ({claims.MEASURES_SQL}), rej AS ({claims.REJECTIONS_SQL})"
_ALL = f"WITH {VERDICTS}, {_DIMENSIONS}"
_SOME = f"WITH {FACTS}, {_DIMENSIONS}"


def _relations(spark, sf):
    return reconcile.relations(claims.facts(spark, sf))


def _summaries(spark, sf):
    return V.fact_summaries(claims.facts(spark, sf), claims.documents(spark, sf), claims.pages(spark, sf), claims.measures(spark, sf))


@query(f"""{_ALL}, e AS (SELECT l_document_id AS document_id FROM decided UNION ALL SELECT r_document_id FROM decided WHERE r_document_id <> l_document_id)
SELECT document_id, coalesce(title, filename) AS title, publisher, (SELECT count(*) FROM facts f WHERE f.document_id = d.document_id) AS fact_count, (SELECT count(*) FROM e WHERE e.document_id = d.document_id) AS relation_count, (SELECT count(*) FROM rej WHERE rej.document_id = d.document_id) AS rejection_count FROM d""")
def document_summaries(spark, sf):
    """PRJ-1, JON-1, AGG-9, SRT-7: newest first."""
    rows = V.document_summaries(claims.documents(spark, sf), claims.facts(spark, sf), _relations(spark, sf), claims.rejections(spark, sf))
    return rows.orderBy(F.desc("created"), "document_id").select("document_id", "title", "publisher", "fact_count", "relation_count", "rejection_count")


@query(f"""WITH {_DIMENSIONS} SELECT d.document_id, coalesce(title, filename) AS title, string_agg(page_number || ':' || page_type || ':' || coalesce(printed_label, '-'), ' ' ORDER BY page_number) AS pages FROM d JOIN pg ON pg.document_id = d.document_id GROUP BY ALL""")
def document_details(spark, sf):
    """PRJ-2."""
    rows = V.document_details(V.titled(claims.documents(spark, sf)), claims.pages(spark, sf))
    return rows.select("document_id", "title", F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page_number"].cast("string"), p["page_type"], F.coalesce(p["printed_label"], F.lit("-")))), " ").alias("pages"))


_SUMMARY = "f.id, m.name AS measure, round(f.confidence, 3) AS confidence, f.value_text AS quote, round(f.evidence_score, 1) AS score, f.evidence_score >= 100 AS exact, coalesce(d.title, d.filename) AS document_title, d.publisher, pg.page_number, pg.printed_label"
_JOINED = "FROM facts f LEFT JOIN d ON d.document_id = f.document_id LEFT JOIN pg ON pg.document_id = f.document_id AND pg.page_id = f.page_id LEFT JOIN m ON m.id = f.measure_id"


@query(f"{_SOME} SELECT {_SUMMARY} {_JOINED}")
def fact_summaries(spark, sf):
    """PRJ-3, JON-3."""
    return _summaries(spark, sf).select("id", "measure", "confidence", "evidence.quote", "evidence.score", "evidence.exact", "source.document_title", "source.publisher", "source.page_number", "source.printed_label")


@query(f"""{_ALL}, c AS (SELECT l_id AS id, r_id AS other, relation_type, severity FROM decided UNION ALL SELECT r_id, l_id, relation_type, severity FROM decided)
SELECT f.id, m.name AS measure, coalesce((SELECT string_agg(other || ':' || relation_type, ' ' ORDER BY severity DESC, other) FROM c WHERE c.id = f.id), '') AS relations FROM facts f LEFT JOIN m ON m.id = f.measure_id""")
def fact_details(spark, sf):
    """PRJ-4."""
    rows = V.fact_details(_summaries(spark, sf), _relations(spark, sf))
    return rows.select("id", "measure", F.array_join(F.transform("relations", lambda r: F.concat_ws(":", r["other_id"].cast("string"), r["relation_type"])), " ").alias("relations"))


@query(f"""{_ALL}, c AS (SELECT l_id AS fact_id, r_id AS other_id, relation_type FROM decided UNION ALL SELECT r_id, l_id, relation_type FROM decided) SELECT * FROM c""")
def counterparts(spark, sf):
    """JON-5."""
    return V.counterparts(_relations(spark, sf)).select("fact_id", "other_id", "relation_type")


_TIME = "coalesce(nullif({0}_period_label, ''), strftime({0}_period_start, '%Y-%m-%d') || ' to ' || strftime({0}_period_end, '%Y-%m-%d'), 'an unstated period')"
_L, _R = _TIME.format("l"), _TIME.format("r")
_Q = "coalesce(CASE qd WHEN 'segment' THEN {0}_segment WHEN 'geography' THEN {0}_geography ELSE {0}_definition END, 'not stated')"
_B = "coalesce(nullif({0}b, ''), 'not stated')"
_SAME = f"CASE WHEN l_unit_scale <> r_unit_scale THEN l_value_text || ' and ' || r_value_text || ' for ' || {_L} || ' are one amount at two scales.' WHEN delta = 0 THEN 'Both give ' || l_value_text || ' for ' || {_L} || '.' ELSE l_value_text || ' and ' || r_value_text || ' for ' || {_L} || ' agree to the precision given.' END"
_EXPLANATION = f"""CASE rule_id WHEN 'period-differs-textual' THEN 'The periods differ: ' || {_L} || ' and ' || {_R} || '.' WHEN 'period-differs' THEN 'The periods differ: ' || {_L} || ' and ' || {_R} || '.' WHEN 'currency-differs' THEN 'One value is in ' || l_currency || ', the other in ' || r_currency || '; nothing is converted.'
 WHEN 'unit-class-differs' THEN 'Different kinds of unit: ' || coalesce(l_unit_class, 'unknown') || ' and ' || coalesce(r_unit_class, 'unknown') || '.' WHEN 'period-containment' THEN 'One period lies within the other: ' || {_L} || ' and ' || {_R} || '.'
 WHEN 'qualifier-differs' THEN 'For ' || {_L} || ', ' || qd || ' is ''' || {_Q.format("l")} || ''' in one and ''' || {_Q.format("r")} || ''' in the other.'
 WHEN 'basis-supersedes' THEN 'For ' || {_L} || ', ' || CASE WHEN lk < rk THEN r_value_text || ' (' || rb || ') replaces ' || l_value_text || ' (' || lb ELSE l_value_text || ' (' || lb || ') replaces ' || r_value_text || ' (' || rb END || ').'
 WHEN 'basis-differs' THEN 'For ' || {_L} || ', one value is ' || {_B.format("l")} || ' and the other ' || {_B.format("r")} || '.' WHEN 'values-agree' THEN {_SAME} || CASE WHEN bd THEN ' Their bases differ: ' || {_B.format("l")} || ' and ' || {_B.format("r")} || '.' ELSE '' END
 WHEN 'values-disagree' THEN 'For ' || {_L} || ' on one basis, ' || l_value_text || ' and ' || r_value_text || ' differ by ' || printf('%.1f', delta * 100) || '%.' END"""


@query(f"""{_ALL} SELECT l_id, r_id, relation_type, dimension, subtype, rule_confidence, severity, delta_absolute, delta_relative, CASE WHEN rule_id = 'basis-supersedes' THEN CASE WHEN lk < rk THEN l_id ELSE r_id END END AS superseded_id, {_EXPLANATION} AS explanation,
coalesce(a.title, a.filename) AS left_title, coalesce(b.title, b.filename) AS right_title FROM decided JOIN d a ON a.document_id = l_document_id JOIN d b ON b.document_id = r_document_id""")
def relation_summaries(spark, sf):
    """PRJ-5, JON-4, REC-6, REC-11, REC-12."""
    rows = reconcile.explained(V.relation_summaries(_relations(spark, sf), _summaries(spark, sf)))
    return rows.select("l_id", "r_id", "relation_type", "dimension", "subtype", "rule_confidence", "severity", "delta_absolute", "delta_relative", "superseded_id", "explanation", F.col("left.source.document_title").alias("left_title"), F.col("right.source.document_title").alias("right_title"))


@query(f"""WITH {VERDICTS} SELECT note, count(*) AS n FROM (SELECT CASE rule_id WHEN 'textual' THEN 'no values to compare' WHEN 'period-unknown' THEN 'a period is unknown' WHEN 'too-far-apart' THEN 'one measure, entity and period, but the values differ by ' || printf('%.1f', delta * 100) || '%' END AS note FROM relations WHERE relation_type = 'escalate') GROUP BY 1""")
def escalation_notes(spark, sf):
    """REC-9, REC-12: why pairs are left to a reader."""
    pairs = reconcile.classify(reconcile.measure_pairs(claims.facts(spark, sf), cap=reconcile.MOST_PARTNERS)).where("relation_type = 'escalate'")
    return reconcile.explained(pairs).groupBy("note").agg(F.count(F.lit(1)).alias("n"))


_MEASURES = f"{_SOME}, s AS (SELECT m.*, count(f.id) AS fact_count, count(DISTINCT f.document_id) AS document_count, arg_min(f.document_id, f.id) AS first_document FROM m LEFT JOIN facts f ON f.measure_id = m.id GROUP BY ALL)"


def _measures(spark, sf):
    return V.measure_summaries(claims.measures(spark, sf), claims.facts(spark, sf))


@query(f"{_MEASURES} SELECT id, slug, name, unit_class, alias_count, fact_count, document_count, first_document FROM s")
def measure_summaries(spark, sf):
    """PRJ-6, AGG-10, AGG-11."""
    return _measures(spark, sf).select("id", "slug", "name", "unit_class", "alias_count", "fact_count", "document_count", "first_document")


@query(f"""{_MEASURES} SELECT 'facts' AS sort, id FROM (SELECT id FROM s WHERE name ILIKE '%er#00%' AND document_count >= 2 ORDER BY fact_count DESC, name, id LIMIT 40) UNION ALL SELECT 'documents', id FROM (SELECT id FROM s WHERE unit_class = 'count' ORDER BY document_count DESC, fact_count DESC, id LIMIT 40)
UNION ALL SELECT 'recent', id FROM (SELECT id FROM s ORDER BY id DESC LIMIT 40) UNION ALL SELECT 'name', id FROM (SELECT id FROM s ORDER BY name, id LIMIT 40)""")
def measures_sorted(spark, sf):
    """SRT-4, FLT-8: the four orders of the measures' list, two of them filtered."""
    rows = _measures(spark, sf)
    asked = {"facts": rows.where(F.col("name").ilike("%er#00%") & (F.col("document_count") >= 2)), "documents": rows.where("unit_class = 'count'"), "recent": rows, "name": rows}
    parts = [V.ordered(df, V.MEASURE_ORDERS[k], 40, "id").select(F.lit(k).alias("sort"), "id") for k, df in asked.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"WITH {FACTS} SELECT entity, count(*) AS fact_count FROM facts WHERE entity ILIKE '%u%' GROUP BY 1 ORDER BY 2 DESC, 1")
def entities_list(spark, sf):
    """SRT-5, FLT-9, AGG-11."""
    return claims.facts(spark, sf).where(F.col("entity").ilike("%u%")).groupBy("entity").agg(F.count(F.lit(1)).alias("fact_count")).orderBy(F.desc("fact_count"), "entity")


@query(f"WITH {_DIMENSIONS} SELECT rej.id, rej.document_id, coalesce(title, filename) AS document_title, page_number, reason FROM rej LEFT JOIN d ON d.document_id = rej.document_id WHERE reason = 'quote_not_found' OR rej.document_id = 3 ORDER BY rej.id DESC")
def rejections_list(spark, sf):
    """PRJ-7, FLT-10, SRT-7."""
    rows = claims.rejections(spark, sf).where("reason = 'quote_not_found' or document_id = 3").join(V.titled(claims.documents(spark, sf)).select("document_id", F.col("title").alias("document_title")), "document_id", "left")
    return rows.select("id", "document_id", "document_title", "page_number", "reason").orderBy(F.desc("id"))


@query(f"SELECT id, document_id, stage, round(progress, 4) AS progress FROM ({claims.JOBS_SQL}) WHERE document_id = 4 AND stage NOT IN ('done', 'failed') ORDER BY started DESC, id")
def jobs_active(spark, sf):
    """PRJ-7, FLT-11, SRT-7: jobs of a document that still run, the newest first."""
    rows = claims.jobs(spark, sf).where("document_id = 4 and stage not in ('done', 'failed')")
    return rows.orderBy(F.desc("started"), "id").select("id", "document_id", "stage", F.round("progress", 4).alias("progress"))


@query(f"""{_ALL}, e AS (SELECT l_id AS id FROM decided UNION ALL SELECT r_id FROM decided), n AS (SELECT id, count(*) AS degree FROM e GROUP BY 1) SELECT n.id, degree, coalesce(nullif(m.name, ''), f.entity, f.value_text[1:60]) AS label FROM n JOIN facts f ON f.id = n.id LEFT JOIN m ON m.id = f.measure_id""")
def graph_labelled(spark, sf):
    """PRJ-8, AGG-18: nodes with degree and label."""
    degrees = V.counterparts(_relations(spark, sf)).groupBy(F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return degrees.join(_summaries(spark, sf), "id").select("id", "degree", F.coalesce(F.nullif("measure", F.lit("")), "entity", F.left("value_text", F.lit(60))).alias("label"))


_SORTS = {"confidence": "confidence", "value": "value_base", "period": "period_start", "page": "page_id", "id": "id", "unknown": "id"}


@query("WITH " + FACTS + " " + " UNION ALL ".join(f"SELECT '{k}{x}' AS sort, id FROM (SELECT id FROM facts ORDER BY {c} {o}, id LIMIT 25 OFFSET 5)" for k, c in _SORTS.items() for x, o in (("", "ASC NULLS FIRST"), (" desc", "DESC NULLS LAST"))))
def facts_sorted(spark, sf):
    """SRT-1: a page in each order of facts, both ways."""
    facts, out = claims.facts(spark, sf), None
    for k in _SORTS:
        for name, down in ((k, False), (f"{k} desc", True)):
            part = V.fact_page(facts, k, down, 25, 5).select(F.lit(name).alias("sort"), "id")
            out = part if out is None else out.union(part)
    return out


@query(f"""WITH {VERDICTS} SELECT 'severity' AS sort, l_id, r_id FROM (SELECT l_id, r_id FROM decided ORDER BY severity DESC, rule_confidence DESC, l_id, r_id LIMIT 200) UNION ALL SELECT 'confidence', l_id, r_id FROM (SELECT l_id, r_id FROM decided ORDER BY rule_confidence DESC, l_id, r_id LIMIT 200) UNION ALL SELECT 'id', l_id, r_id FROM (SELECT l_id, r_id FROM decided ORDER BY l_id, r_id LIMIT 200)""")
def relations_sorted(spark, sf):
    """SRT-2, SRT-3: by severity, confidence or id, 200 at most."""
    rows = _relations(spark, sf).select("l_id", "r_id", "severity", "rule_confidence")
    orders = {"severity": ("-severity", "-rule_confidence"), "confidence": ("-rule_confidence",), "id": ()}
    return V.leading(rows, *[V.Part(k, (*order, "l_id", "r_id"), 200) for k, order in orders.items()]).select(F.col("part").alias("sort"), "l_id", "r_id")


@query(f"WITH {FACTS} SELECT id FROM facts ORDER BY md5(id || '/7'), id LIMIT 40")
def facts_sample(spark, sf):
    """SRT-10: the feature is a sample of forty."""
    return V.sampled(claims.facts(spark, sf), 40).select("id")


@query(f"""{_SOME} SELECT f.id AS fact_id, coalesce(d.title, d.filename) AS document, d.publisher, pg.page_number AS page, pg.printed_label AS printed_page, f.kind, f.entity AS subject, f.slug_free AS measure, m.name AS measure_canonical, f.value_text, f.value_base / f.unit_scale AS value_number, f.value_base, f.currency AS unit, f.unit_class, f.currency,
f.period_label, strftime(f.period_start, '%Y-%m-%d') AS period_start, strftime(f.period_end, '%Y-%m-%d') AS period_end, f.basis, concat_ws('; ', 'definition=' || definition, 'geography=' || geography, 'segment=' || segment) AS qualifiers, round(f.confidence, 3) AS confidence, round(f.evidence_score, 1) AS evidence_score, f.evidence_score >= 100 AS evidence_exact, f.value_text AS evidence_quote
FROM (SELECT *, 'measure ' || measure_id AS slug_free FROM facts) f LEFT JOIN d ON d.document_id = f.document_id LEFT JOIN pg ON pg.document_id = f.document_id AND pg.page_id = f.page_id LEFT JOIN m ON m.id = f.measure_id""")
def export_facts(spark, sf):
    """SNK-1: 24 columns, in order of document, page and id."""
    rows = _summaries(spark, sf).orderBy("document_id", "page_id", "id")
    q = F.array_join(F.transform(F.array_sort(F.map_entries("qualifiers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select(
        F.col("id").alias("fact_id"), F.col("source.document_title").alias("document"), "source.publisher", F.col("source.page_number").alias("page"), F.col("source.printed_label").alias("printed_page"), "kind", F.col("entity").alias("subject"), F.concat(F.lit("measure "), F.col("measure_id").cast("string")).alias("measure"),
        F.col("measure").alias("measure_canonical"), "value_text", (F.col("value_base") / F.col("unit_scale")).alias("value_number"), "value_base", F.col("currency").alias("unit"), "unit_class", "currency", "period_label", day("period_start"), day("period_end"), "basis", q.alias("qualifiers"), "confidence",
        F.col("evidence.score").alias("evidence_score"), F.col("evidence.exact").alias("evidence_exact"), F.col("evidence.quote").alias("evidence_quote"),
    )


@query(f"""{_ALL} SELECT l_id || '-' || r_id AS relation_id, relation_type AS type, subtype, dimension, 'rule' AS decided_by, rule_id, round(rule_confidence, 3) AS confidence, severity, cross_document, false AS order_sensitive, delta_relative, {_EXPLANATION} AS explanation, l_id AS left_fact_id, coalesce(a.title, a.filename) AS left_document, l_value_text AS left_value, l_period_label AS left_period,
r_id AS right_fact_id, coalesce(b.title, b.filename) AS right_document, r_value_text AS right_value, r_period_label AS right_period, CASE WHEN rule_id = 'basis-supersedes' THEN CASE WHEN lk < rk THEN l_id ELSE r_id END END AS superseded_fact_id FROM decided LEFT JOIN d a ON a.document_id = l_document_id LEFT JOIN d b ON b.document_id = r_document_id""")
def export_relations(spark, sf):
    """SNK-2, JON-4: 21 columns, by severity and id; a document's filter would keep a relation with either side in it."""
    titles = V.titled(claims.documents(spark, sf)).select("document_id", "title")
    one, two = (titles.select(F.col("document_id").alias(f"{p}_document_id"), F.col("title").alias(f"{s}_document")) for p, s in (("l", "left"), ("r", "right")))
    # sorted before it is put into words: a sort makes its rows twice, to find its ranges and to deal them
    rows = reconcile.explained(_relations(spark, sf).join(one, "l_document_id", "left").join(two, "r_document_id", "left").orderBy(F.desc("severity"), "l_id", "r_id"))
    return rows.select(
        F.concat_ws("-", F.col("l_id").cast("string"), F.col("r_id").cast("string")).alias("relation_id"), F.col("relation_type").alias("type"), "subtype", "dimension", F.lit("rule").alias("decided_by"), "rule_id", F.round("rule_confidence", 3).alias("confidence"), "severity", "cross_document", F.lit(False).alias("order_sensitive"), "delta_relative", "explanation",
        F.col("l_id").alias("left_fact_id"), "left_document", F.col("l_value_text").alias("left_value"), F.col("l_period_label").alias("left_period"), F.col("r_id").alias("right_fact_id"), "right_document", F.col("r_value_text").alias("right_value"), F.col("r_period_label").alias("right_period"), F.col("superseded_id").alias("superseded_fact_id"),
    )


@query(f"""{_ALL} SELECT 'documents' AS list, count(*) AS n FROM d UNION ALL SELECT 'pages', count(*) FROM pg UNION ALL SELECT 'measures', count(*) FROM m UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'relations', count(*) FROM decided UNION ALL SELECT 'rejections', count(*) FROM rej UNION ALL SELECT 'jobs', count(*) FROM ({claims.JOBS_SQL})""")
def snapshot_counts(spark, sf):
    """SNK-4: the lists of a snapshot with their sizes."""
    lists = {"documents": claims.documents(spark, sf), "pages": claims.pages(spark, sf), "measures": claims.measures(spark, sf), "facts": claims.facts(spark, sf), "relations": _relations(spark, sf), "rejections": claims.rejections(spark, sf), "jobs": claims.jobs(spark, sf)}
    out = None
    for name, df in lists.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("list"), "n")
        out = part if out is None else out.union(part)
    return out


# Cases: relations with two judgements on wording that the facts' columns stand for.
_WORDING, _PREDICATES = "CASE WHEN (l_id + r_id) % 4 = 0 THEN 60 ELSE 90 END", "l_id % 7 = r_id % 3"
_POOL_SQL = "(SELECT *, l_unit_scale <> r_unit_scale AS scale_differs, {w} AS wording, {p} AS predicates_differ FROM decided WHERE relation_type = '{k}' ORDER BY cross_document DESC, rule_confidence DESC, l_id, r_id LIMIT {n})"
_pool = lambda k, n: "SELECT * FROM " + _POOL_SQL.format(w=_WORDING, p=_PREDICATES, k=k, n=n)
_WHY = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL), ',')"
_BEST = "ORDER BY case_score DESC, cross_document DESC, rule_confidence DESC, l_id, r_id LIMIT 3"


def _case_rows(spark, sf, cap=reconcile.MOST_PARTNERS):
    return reconcile.relations(claims.facts(spark, sf), cap).withColumns({"wording": F.expr(_WORDING), "predicates_differ": F.expr(_PREDICATES)})


def _shown(rows):
    return rows.select("l_id", "r_id", "case_score", F.array_join("selected_because", ",").alias("selected_because"))


@query(f"""WITH {VERDICTS}, p AS ({_pool("corroborates", 300)}) SELECT l_id, r_id, round(rule_confidence + CASE WHEN cross_document THEN 1.5 ELSE 0 END::DOUBLE + CASE WHEN scale_differs THEN 1.2 ELSE 0 END::DOUBLE + CASE WHEN wording < 70 THEN 0.8 ELSE 0 END::DOUBLE + CASE WHEN predicates_differ THEN 0.5 ELSE 0 END::DOUBLE, 6) AS case_score,
{_WHY.format("CASE WHEN cross_document THEN 'two documents' END, CASE WHEN scale_differs THEN 'two scales' END, CASE WHEN wording < 70 THEN 'other words' END, CASE WHEN predicates_differ THEN 'other names' END")} AS selected_because FROM p {_BEST}""")
def cases_corroboration(spark, sf):
    """CAS-1, CAS-5, WIN-5, SRT-11."""
    return _shown(V.cases(_case_rows(spark, sf), "corroborates"))


@query(f"""WITH {VERDICTS}, p AS ({_pool("contradicts", 300)}) SELECT l_id, r_id, round(severity + rule_confidence + CASE WHEN cross_document THEN 1.5 ELSE 0 END::DOUBLE + CASE WHEN l_evidence_score >= 100 AND r_evidence_score >= 100 THEN 0.4 ELSE 0 END::DOUBLE, 6) AS case_score,
{_WHY.format("CASE WHEN cross_document THEN 'two documents' END, CASE WHEN l_evidence_score >= 100 AND r_evidence_score >= 100 THEN 'both quoted exactly' END")} AS selected_because FROM p {_BEST}""")
def cases_contradiction(spark, sf):
    """CAS-2, CAS-5."""
    return _shown(V.cases(_case_rows(spark, sf), "contradicts"))


@query(f"""WITH {ALL_VERDICTS}, p AS ({_pool("reconciled", 300)} UNION ALL {_pool("refines", 100)} UNION ALL {_pool("supersedes", 100)}) SELECT l_id, r_id, round(rule_confidence + CASE WHEN delta_relative IS NULL THEN 0 ELSE 2 * least(delta_relative, 1.0) END::DOUBLE + CASE WHEN relation_type = 'supersedes' THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN cross_document THEN 1.0 ELSE 0 END::DOUBLE, 6) AS case_score,
{_WHY.format("CASE WHEN delta_relative IS NOT NULL THEN 'values far apart' END, CASE WHEN relation_type = 'supersedes' THEN 'one replaces the other' END, CASE WHEN cross_document THEN 'two documents' END")} AS selected_because FROM p WHERE dimension <> 'none' {_BEST}""")
def cases_reconciled(spark, sf):
    """CAS-3, CAS-5, SET-5: every pair of a measure takes part."""
    return _shown(V.cases(_case_rows(spark, sf, None), "reconciled"))


@query(f"{_SOME}, b AS (SELECT reason, count(*) AS n, max(id) AS newest, arg_max(document_id, id) AS document_id FROM rej GROUP BY 1 ORDER BY n DESC, reason LIMIT 4) SELECT b.*, round((SELECT count(*) FROM facts) / ((SELECT count(*) FROM facts) + (SELECT sum(n) FROM b)), 3) AS pass_rate FROM b")
def cases_failure(spark, sf):
    """CAS-4, WIN-6, AGG-3: rejections by reason with the newest, and the pass rate."""
    return V.failures(claims.rejections(spark, sf), claims.facts(spark, sf).count())


@query(f"WITH {FACTS} SELECT count(*) AS facts, count(*) FILTER (evidence_score >= 100) AS exact, count(value_base) AS numeric_facts, count(*) FILTER (unit_class IS NOT NULL) AS with_unit, count(*) FILTER (period_start IS NOT NULL) AS with_period, count(*) FILTER (len(value_text) > 3) AS located, round(count(*) FILTER (evidence_score >= 100) / count(*), 4) AS exact_rate, round(count(*) FILTER (unit_class IS NOT NULL) / count(*), 4) AS unit_rate FROM facts")
def evaluation_counts(spark, sf):
    """AGG-1, AGG-2, FLT-16: one pass."""
    n, exact, unit = F.count(F.lit(1)), F.count_if(F.col("evidence_score") >= 100), F.count("unit_class")
    return claims.facts(spark, sf).agg(n.alias("facts"), exact.alias("exact"), F.count("value_base").alias("numeric_facts"), unit.alias("with_unit"), F.count("period_start").alias("with_period"), F.count_if(F.length("value_text") > 3).alias("located"), V.rate(exact, n).alias("exact_rate"), V.rate(unit, n).alias("unit_rate"))


@query(f"WITH {_DIMENSIONS} SELECT unit_class, count(*) AS n FROM m GROUP BY 1")
def unit_class_histogram(spark, sf):
    """AGG-17: null is a class of its own."""
    return claims.measures(spark, sf).groupBy("unit_class").agg(F.count(F.lit(1)).alias("n"))


_ASKED = "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'reconciled' WHEN 2 THEN 'corroborates' ELSE 'unrelated' END AS first, CASE o_orderkey % 3 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'reconciled' ELSE 'corroborates' END AS second FROM orders"


@query(f"WITH v AS ({_ASKED}), t AS (SELECT count(*) FILTER (first <> 'unrelated' AND first = second) AS agreed, count(*) FILTER (first <> 'unrelated' AND first <> second) AS order_sensitive, count(*) FILTER (first = 'unrelated') AS dropped FROM v) SELECT *, round(agreed / (agreed + order_sensitive), 4) AS agreement_rate FROM t")
def cross_check(spark, sf):
    """AGG-5, AGG-19, FLT-15."""
    return V.cross_check(spark.sql(_ASKED.replace("FROM orders", "FROM {orders}"), orders=rows_of(spark, sf, "orders")))


_CALLS = "SELECT event_type AS purpose, event_id % 3 = 0 AS cached, event_id % 11 = 1 AS failed, event_id % 700 AS tokens_in, user_id % 90 AS tokens_out FROM events"


@query(f"WITH c AS ({_CALLS}) SELECT purpose, count(*) AS calls, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached AND NOT failed) AS billed, count(*) FILTER (failed) AS failed, CAST(sum(tokens_in) FILTER (NOT cached) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) FILTER (NOT cached) AS BIGINT) AS tokens_out FROM c GROUP BY 1")
def usage(spark, sf):
    """AGG-7, AGG-21, SNK-9."""
    return V.usage(spark.sql(_CALLS.replace("FROM events", "FROM {events}"), events=rows_of(spark, sf, "events")))


@query(f"{_SOME}, k AS (SELECT document_id, count(*) AS kept FROM facts GROUP BY 1), r AS (SELECT document_id, count(*) AS rejected FROM rej GROUP BY 1) SELECT document_id, coalesce(kept, 0) AS kept, coalesce(rejected, 0) AS rejected, coalesce(kept, 0) + coalesce(rejected, 0) AS proposed, round(coalesce(kept, 0) / (coalesce(kept, 0) + coalesce(rejected, 0)), 3) AS pass_rate FROM k FULL JOIN r USING (document_id)")
def ingest_stats(spark, sf):
    """AGG-4, AGG-20."""
    return V.ingest_stats(claims.facts(spark, sf), claims.rejections(spark, sf))


@query(f"WITH {VERDICTS} SELECT count(*) AS total FROM decided WHERE relation_type = 'corroborates' AND rule_confidence >= 0.9 AND (l_measure_id = 7 OR l_document_id = 7 OR r_document_id = 7)")
def page_total(spark, sf):
    """AGG-22, FLT-7: how many rows a page is cut from."""
    rows = reconcile.relations(claims.facts(spark, sf), where="l_measure_id = 7 or l_document_id = 7 or r_document_id = 7")
    return rows.where("relation_type = 'corroborates' and rule_confidence >= 0.9").agg(F.count(F.lit(1)).alias("total"))


@query(f"WITH {_DIMENSIONS} SELECT document_id, round(scanned_pages / 7.0, 4) AS scanned_share, round(ocr_pages / 7.0, 4) AS ocr_share, scanned_pages / 7.0 >= 0.5 AS warn FROM d")
def scan_warnings(spark, sf):
    """DUP-2."""
    return V.scan_warnings(claims.documents(spark, sf)).select("document_id", "scanned_share", "ocr_share", "warn")


@query(f"""WITH {FACTS}, x AS (SELECT f.*, dc.text, 1 + (f.id % 600) AS spot FROM facts f JOIN documents dc ON dc.doc_id = f.id % 200) SELECT id, 'value: ' || value_text || chr(10) || 'period: ' || coalesce(period_label, 'not stated') || chr(10) || 'basis: ' || coalesce(nullif(basis, ''), 'not stated') || chr(10) || 'qualifiers: ' || coalesce(nullif(concat_ws(', ', 'definition=' || definition, 'geography=' || geography, 'segment=' || segment), ''), 'none') AS claim,
substring(text, greatest(1, spot - 420)::INT, (spot + 420 - greatest(1, spot - 420))::INT)[1:1200] AS context FROM x""")
def adjudication_text(spark, sf):
    """PRJ-9, ADJ-3."""
    texts = rows_of(spark, sf, "documents").select(F.col("doc_id").alias("at"), "text")
    rows = claims.facts(spark, sf).withColumns({"at": F.col("id") % 200, "place": (1 + F.col("id") % 600).cast("int")}).join(texts, "at")
    return V.adjudication_text(rows, "text", "place").select("id", "claim", "context")
