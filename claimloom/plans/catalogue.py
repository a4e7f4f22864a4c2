"""Catalogue of the engine's queries, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import periods, text, units
from claimloom.operators import read, reconcile
from claimloom.plans.base import FACTS, PAIRS, VERDICTS, Query, query, registered, rows_of, sql_of
from claimloom.sources import claims

_t = rows_of


def _facts(spark, sf):
    return claims.facts(spark, sf)


def _classified(spark, sf):
    return reconcile.classify(reconcile.measure_pairs(_facts(spark, sf), cap=reconcile.MOST_PARTNERS))


def _decided(spark, sf):
    return reconcile.relations(_facts(spark, sf))


def _count():
    return F.count(F.lit(1)).alias("n")


@query(f"WITH {VERDICTS} SELECT relation_type, dimension, rule_id, count(*) AS n FROM relations GROUP BY ALL")
def reconcile_verdicts(spark, sf):
    """REC-1..9, AGG-3, AGG-16: every pair of one measure, counted by outcome."""
    return _classified(spark, sf).groupBy("relation_type", "dimension", "rule_id").agg(_count())


@query(f"WITH {VERDICTS} SELECT l_id, r_id, relation_type, dimension, rule_id, rule_confidence, cross_document FROM decided")
def relations_decided(spark, sf):
    """REC-1, FLT-13: decided, informative relations."""
    return _decided(spark, sf).select("l_id", "r_id", "relation_type", "dimension", "rule_id", "rule_confidence", "cross_document")


@query(f"WITH {VERDICTS} SELECT l_id, r_id, CASE WHEN lk < rk THEN l_id ELSE r_id END AS superseded_id FROM decided WHERE relation_type = 'supersedes'")
def supersedes(spark, sf):
    """REC-7: which fact is superseded."""
    return _decided(spark, sf).where("relation_type = 'supersedes'").select("l_id", "r_id", "superseded_id")


@query(f"""WITH {VERDICTS} SELECT l_id, r_id, round(least(1.0, least(delta, 1.0) * 0.55::DOUBLE + (l_evidence_score + r_evidence_score) / 200 * 0.2::DOUBLE + (l_confidence + r_confidence) / 2 * 0.25::DOUBLE) * CASE WHEN cross_document THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END, 3) AS severity
FROM decided WHERE relation_type = 'contradicts'""")
def reconcile_severity(spark, sf):
    """REC-10."""
    return _decided(spark, sf).where("relation_type = 'contradicts'").select("l_id", "r_id", "severity")


@query(f"WITH {PAIRS} SELECT l_id, r_id, l_measure_id AS measure_id FROM every")
def measure_pairs(spark, sf):
    """JON-6, FLT-14."""
    return reconcile.measure_pairs(_facts(spark, sf)).select("l_id", "r_id", F.col("l_measure_id").alias("measure_id"))


@query(f"WITH {PAIRS} SELECT l_id, r_id FROM every WHERE l_document_id IN (3, 4) OR r_document_id IN (3, 4)")
def incremental_pairs(spark, sf):
    """STR-1: only pairs that a newly ingested document takes part in."""
    return reconcile.measure_pairs(_facts(spark, sf), F.col("document_id").isin(3, 4)).select("l_id", "r_id")


@query(f"WITH {PAIRS} SELECT l_id, r_id FROM every WHERE (l_place - 1) // 6 = (r_place - 1) // 6")
def pair_cap(spark, sf):
    """WIN-2 on the pairs of a measure: runs of cap + 1 facts, so that a fact has at most so many partners."""
    return reconcile.measure_pairs(_facts(spark, sf), cap=5).select("l_id", "r_id")


@query(f"""WITH {PAIRS}, u AS (SELECT l_id, r_id, 0 AS p, 1.0::DOUBLE AS similarity, 'measure' AS source FROM every UNION ALL SELECT l.id, r.id, 1, 0.9::DOUBLE, 'vector' FROM facts l JOIN facts r ON l.id % 2 = 0 AND r.id = l.id + 1
  UNION ALL SELECT l.id, r.id, 2, 0.0::DOUBLE, 'lexical' FROM facts l JOIN facts r ON l.id > 3 AND r.id = l.id - 3),
f AS (SELECT least(l_id, r_id) AS l_id, greatest(l_id, r_id) AS r_id, arg_min(similarity, p) AS similarity, arg_min(source, p) AS source FROM u GROUP BY 1, 2),
k AS (SELECT f.* FROM f JOIN facts l ON l.id = f.l_id JOIN facts r ON r.id = f.r_id WHERE NOT (l.document_id = r.document_id AND l.page_id = r.page_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY similarity DESC, source <> 'measure', l_id, r_id) AS x FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY similarity DESC, source <> 'measure', l_id, r_id) AS y FROM a WHERE x <= 40)
SELECT l_id, r_id, similarity, source FROM b WHERE y <= 40""")
def pair_union_first_wins(spark, sf):
    """CND-1, SET-2, WIN-4: three routes united, the first one that has a pair names it, capped at either end.

    The vector and lexical routes stand for neighbours of an original and its restatement."""
    facts = _facts(spark, sf)
    one = reconcile.measure_pairs(facts).select("l_id", "r_id", F.lit(1.0).alias("similarity"), F.lit("measure").alias("source"))
    own = facts.select(F.col("id").alias("l_id"))
    two = own.where("l_id % 2 = 0").select("l_id", (F.col("l_id") + 1).alias("r_id"), F.lit(0.9).alias("similarity"), F.lit("vector").alias("source"))
    three = own.where("l_id > 3").select("l_id", (F.col("l_id") - 3).alias("r_id"), F.lit(0.0).alias("similarity"), F.lit("lexical").alias("source"))
    return reconcile.united(facts, [one, two, three])


@query(f"WITH {FACTS} SELECT id, measure_id, value_base FROM facts WHERE currency = 'USD' AND period_end >= DATE '1997-01-01' AND period_start <= DATE '1997-06-30' AND confidence >= 0.7")
def fact_filter_period_overlap(spark, sf):
    """FLT-1, FLT-2, FLT-3."""
    return read.filter_facts(_facts(spark, sf), "1997-01-01", "1997-06-30", 0.7, currency="USD", basis="").select("id", "measure_id", "value_base")


@query(f"WITH {VERDICTS} SELECT id FROM facts WHERE id IN (SELECT l_id FROM decided UNION SELECT r_id FROM decided)")
def fact_has_relations_semi(spark, sf):
    """FLT-4, SET-1."""
    return read.with_relations(_facts(spark, sf), _decided(spark, sf)).select("id")


@query(f"WITH {VERDICTS} SELECT id FROM facts WHERE id NOT IN (SELECT l_id FROM decided UNION SELECT r_id FROM decided)")
def fact_no_relations_anti(spark, sf):
    """FLT-4."""
    return read.with_relations(_facts(spark, sf), _decided(spark, sf), False).select("id")


@query("SELECT doc_id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[^a-z0-9]+'), ['the', 'tion', 'and'])")
def fact_search_fts_and(spark, sf):
    """FLT-5."""
    return read.search_all(_t(spark, sf, "documents"), "text", "The, tion AND").select("doc_id")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%tioning%' OR source ILIKE '%src1%'")
def fact_search_like(spark, sf):
    """FLT-6, FLT-8, FLT-9."""
    return _t(spark, sf, "documents").where(F.col("text").ilike("%tioning%") | F.col("source").ilike("%src1%")).select("doc_id")


@query(f"WITH {FACTS} SELECT id, value_base FROM facts WHERE value_base IS NOT NULL ORDER BY value_base DESC, id LIMIT 50 OFFSET 20")
def fact_sort_page(spark, sf):
    """SRT-1, a page of 50."""
    return _facts(spark, sf).where("value_base is not null").select("id", "value_base").orderBy(F.desc("value_base"), "id").offset(20).limit(50)


@query(f"WITH {VERDICTS} SELECT l_id, r_id, relation_type FROM decided WHERE rule_confidence >= 0.88 AND cross_document AND (l_document_id = 7 OR r_document_id = 7)")
def relations_filter_either_side(spark, sf):
    """FLT-7."""
    rows = reconcile.relations(_facts(spark, sf), where="l_document_id <> r_document_id and (l_document_id = 7 or r_document_id = 7)")
    return rows.where("rule_confidence >= 0.88 and cross_document").select("l_id", "r_id", "relation_type")


@query(f"""WITH {VERDICTS}, e AS (SELECT l_document_id AS document_id FROM decided UNION ALL SELECT r_document_id FROM decided WHERE r_document_id <> l_document_id), f AS (SELECT document_id, count(*) AS facts, count(value_base) AS numeric_facts FROM facts GROUP BY 1)
SELECT f.document_id, f.facts, f.numeric_facts, (SELECT count(*) FROM e WHERE e.document_id = f.document_id) AS relations, round(f.facts / 7.0::DOUBLE, 2) AS facts_per_page FROM f""")
def coverage_by_document(spark, sf):
    """JON-1, JON-2, AGG-4, AGG-9: pre-aggregated sides, so nothing fans out."""
    own = _facts(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"), F.count("value_base").alias("numeric_facts"))
    both = _decided(spark, sf).groupBy("l_document_id", "r_document_id").agg(_count())
    ends = both.select("n", F.explode(F.array_distinct(F.array("l_document_id", "r_document_id"))).alias("document_id")).groupBy("document_id").agg(F.sum("n").alias("relations"))
    return own.join(ends, "document_id", "left").select("document_id", "facts", "numeric_facts", F.coalesce("relations", F.lit(0)).alias("relations"), F.round(F.col("facts") / 7.0, 2).alias("facts_per_page"))


@query(f"WITH {FACTS} SELECT count(*) AS facts, count(value_base) AS numeric_facts, count(*) FILTER (period_start IS NOT NULL) AS with_period, round(count(value_base) / count(*), 4) AS numeric_rate, round(count(*) FILTER (evidence_score >= 100) / count(*), 4) AS exact_rate FROM facts")
def evaluation_rates(spark, sf):
    """AGG-1, AGG-2, one pass."""
    n = F.count(F.lit(1))
    return _facts(spark, sf).agg(n.alias("facts"), F.count("value_base").alias("numeric_facts"), F.count_if(F.col("period_start").isNotNull()).alias("with_period"), F.round(F.count("value_base") / n, 4).alias("numeric_rate"), F.round(F.count_if(F.col("evidence_score") >= 100) / n, 4).alias("exact_rate"))


@query("SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median_value, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1")
def median_latency_upper(spark, sf):
    """AGG-3, AGG-7, AGG-8."""
    return _t(spark, sf, "events").groupBy("event_type").agg(read.upper_median("value").alias("median_value"), F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH p AS (SELECT DISTINCT source, sha256(text) AS h FROM documents WHERE n_chars >= 400), s AS (SELECT source, count(*) AS size FROM p GROUP BY 1),
j AS (SELECT a.source, b.source AS other, count(*) AS shared FROM p a JOIN p b ON a.h = b.h AND b.source < a.source GROUP BY ALL), r AS (SELECT j.source, other, shared, size, round(shared / size, 4) AS overlap, row_number() OVER (PARTITION BY j.source ORDER BY round(shared / size, 4) DESC, other) AS rn FROM j JOIN s ON s.source = j.source)
SELECT source, other, shared, size, overlap FROM r WHERE rn = 1""")
def near_duplicate_containment(spark, sf):
    """FLT-12, JON-9, SET-4, AGG-15, DUP-1."""
    return read.containment(_t(spark, sf, "documents").where("n_chars >= 400").select("source", F.sha2("text", 256).alias("h")), "source", "h")


@query(f"WITH {VERDICTS}, e AS (SELECT l_id AS id FROM decided UNION ALL SELECT r_id FROM decided) SELECT id, count(*) AS degree FROM e GROUP BY 1")
def graph_nodes(spark, sf):
    """PRJ-8, AGG-18."""
    return _decided(spark, sf).select(F.explode(F.array("l_id", "r_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {VERDICTS} SELECT l_id, r_id, relation_type FROM decided ORDER BY rule_confidence DESC, l_id, r_id LIMIT 200")
def graph_edges(spark, sf):
    """SRT-2, SRT-3: the strongest edges."""
    return _decided(spark, sf).orderBy(F.desc("rule_confidence"), "l_id", "r_id").limit(200).select("l_id", "r_id", "relation_type")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN -o_totalprice ELSE floor(o_totalprice) END AS value FROM orders""")
def parse_number(spark, sf):
    """UNT-1 on surface strings derived from typed values."""
    k, v = F.col("o_orderkey") % 4, F.col("o_totalprice")
    s = F.call_function("format_number", v, F.lit("#,##0.00"))
    surface = F.when(k == 0, F.concat(F.lit("USD "), s, F.lit(" total"))).when(k == 1, F.concat(F.lit("( "), s, F.lit(" )"))).when(k == 2, F.concat(F.lit("−"), s)).otherwise(F.call_function("format_number", F.floor(v), F.lit("#,##0")))
    return _t(spark, sf, "orders").select("o_orderkey", units.parse_number(surface).alias("value"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'CHF' END AS currency, CASE o_orderkey % 5 WHEN 0 THEN 1e7 WHEN 1 THEN 1e9 WHEN 2 THEN 1e6 WHEN 3 THEN 250.0 END::DOUBLE AS scale, CASE o_orderkey % 3 WHEN 0 THEN 'ratio' WHEN 1 THEN 'mass' ELSE 'duration' END AS unit_class FROM orders")
def normalize_units(spark, sf):
    """UNT-2, UNT-3, UNT-6."""
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % n).cast("int"))
    return _t(spark, sf, "orders").select("o_orderkey", units.normalize_currency(pick([" Rs. ", "US$", "euros", "chf", "??"], 5)).alias("currency"), units.normalize_scale(pick(["Crore", "bn", "Mn", "250 boxes", "none"], 5)).alias("scale"), units.simple_unit(pick(["%", "Tons", "days"], 3))["unit_class"].alias("unit_class"))


@query(f"WITH {VERDICTS} SELECT l_id, r_id, pr AS period_relation FROM p1")
def interval_relate(spark, sf):
    """PER-17, JON-12."""
    return _classified(spark, sf).select("l_id", "r_id", "period_relation")


@query(f"WITH {VERDICTS} SELECT l_id, r_id, delta AS delta_relative, tol AS tolerance FROM p1 WHERE l_value_base IS NOT NULL AND r_value_base IS NOT NULL")
def rounding_tolerance(spark, sf):
    """UNT-10..13."""
    pairs = reconcile.measure_pairs(_facts(spark, sf), cap=reconcile.MOST_PARTNERS).where("l_value_base is not null and r_value_base is not null")
    a, b = F.col("l_value_base"), F.col("r_value_base")
    return pairs.select("l_id", "r_id", units.relative_difference(a, b).alias("delta_relative"), units.rounding_tolerance(a, b, F.col("l_unit_class")).alias("tolerance"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, CAST((month(o_orderdate) + 8) % 12 // 3 + 1 AS INT) AS q FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'quarter' WHEN 1 THEN 'fiscal_year' WHEN 2 THEN 'point' ELSE 'month' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(make_date(fy - 1, 4, 1) + to_months(3 * (q - 1)) AS DATE) WHEN 1 THEN make_date(fy - 1, 4, 1) WHEN 2 THEN d ELSE CAST(date_trunc('month', d) AS DATE) END AS period_start,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(make_date(fy - 1, 4, 1) + to_months(3 * q) - INTERVAL 1 DAY AS DATE) WHEN 1 THEN make_date(fy, 3, 31) WHEN 2 THEN d ELSE last_day(d) END AS period_end FROM d""")
def parse_period(spark, sf):
    """PER-1, PER-3, PER-7, PER-13, PER-14, PER-16 on labels derived from dates."""
    d = F.col("o_orderdate").cast("date")
    fy = F.year(d) + F.when(F.month(d) >= 4, 1).otherwise(0)
    q = F.floor((F.month(d) + 8) % 12 / 3) + 1
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, F.format_string("Q%d FY%d", q.cast("int"), fy)).when(k == 1, F.format_string("FY %d-%02d", fy - 1, fy % 100)).when(k == 2, F.date_format(d, "'as at' MMMM d, yyyy")).otherwise(F.date_format(d, "MMM yyyy"))
    return _t(spark, sf, "orders").select("o_orderkey", periods.parse_period(label).alias("p")).select("o_orderkey", "p.kind", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


@query(f"""WITH {FACTS} SELECT id, lower(concat_ws(' | ', nullif(entity, ''), CAST(measure_id AS VARCHAR), nullif(concat_ws(' ', 'definition=' || definition, 'geography=' || geography, 'segment=' || segment), ''), period_label, nullif(basis, ''))) AS claim_key FROM facts""")
def claim_key(spark, sf):
    """NRM-17."""
    return _facts(spark, sf).select("id", text.claim_key(F.col("entity"), F.col("measure_id").cast("string"), F.col("qualifiers"), F.col("period_label"), F.col("basis")).alias("claim_key"))


@query("""SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS alias_key, true AS same FROM supplier""")
def same_organisation(spark, sf):
    """TXT-10..12, SET-3: legal forms and articles don't tell organisations apart."""
    n = F.col("s_name")
    return _t(spark, sf, "supplier").select("s_suppkey", text.entity_alias_key(F.concat(F.lit("The "), n, F.lit(" Pvt. Ltd"))).alias("alias_key"), text.same_organisation(F.concat(n, F.lit(" Limited")), F.concat(n, F.lit(", Inc."))).alias("same"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws FROM documents), m AS (SELECT doc_id, len(ws) AS words, coalesce(round(len(list_filter(ws, lambda x: regexp_matches(x, '^[(+-]?[$€£₹]?[0-9][0-9,.]*[%)]?$'))) / nullif(len(ws), 0), 3), 0.0) AS ns,
 coalesce(round(len(regexp_extract_all(text, '[.!?]([ \t\n\r\f\v]|$)')) / nullif(len(ws), 0) * 100, 3), 0.0) AS sd FROM w)
SELECT CASE WHEN words < 6 THEN 'empty' WHEN words < 25 AND sd < 1.0 AND ns < 0.25 THEN 'boilerplate' WHEN ns >= 0.15 AND sd >= 1.2 THEN 'mixed' ELSE 'prose' END AS page_type, count(*) AS n FROM m GROUP BY 1""")
def classify_page(spark, sf):
    """CLS-1, CLS-2, AGG-3."""
    s = text.page_signals(F.col("text"))
    rows = _t(spark, sf, "documents").select(*[c.alias(k) for k, c in s.items()])
    return rows.groupBy(text.page_type({k: F.col(k) for k in s}).alias("page_type")).agg(_count())


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'reconciled' WHEN 2 THEN 'corroborates' ELSE 'unrelated' END AS f, CASE o_orderkey % 3 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'reconciled' ELSE 'corroborates' END AS s, (o_orderkey % 10)::DOUBLE / 10 AS c1, (o_orderkey % 7)::DOUBLE / 7 AS c2 FROM orders)
SELECT o_orderkey, CASE WHEN f = s THEN f WHEN f = 'contradicts' THEN s ELSE f END AS relation_type, round(CASE WHEN f = s THEN (c1 + c2) / 2 ELSE least(0.55, CASE WHEN f = 'contradicts' THEN c2 ELSE c1 END) END, 9) AS confidence, f <> s AS order_sensitive FROM v WHERE f <> 'unrelated'""")
def adjudication_merge(spark, sf):
    """ADJ-1, ADJ-2, AGG-5."""
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (k % n).cast("int"))
    rows = _t(spark, sf, "orders").select("o_orderkey", pick(["contradicts", "reconciled", "corroborates", "unrelated"], 4).alias("first"), pick(["contradicts", "reconciled", "corroborates"], 3).alias("second"), ((k % 10).cast("double") / 10).alias("c1"), ((k % 7).cast("double") / 7).alias("c2"))
    return read.merge_verdicts(rows).select("o_orderkey", "relation_type", F.round("confidence", 9).alias("confidence"), "order_sensitive")


@query(f"WITH {FACTS}, f AS (SELECT measure_id, min(document_id) AS document_id FROM facts GROUP BY 1) SELECT document_id, count(*) AS new_measures, CAST(sum(count(*)) OVER (ORDER BY document_id) AS BIGINT) AS running FROM f GROUP BY 1")
def running_measures(spark, sf):
    """AGG-14, WIN-7: the running total is over the aggregate, in stretches of document ids."""
    per = _facts(spark, sf).groupBy("measure_id").agg(F.min("document_id").alias("document_id")).groupBy("document_id").agg(F.count(F.lit(1)).alias("new_measures"))
    return read.running_total(per, "document_id", "new_measures", "running")


@query(f"WITH {FACTS}, m AS (SELECT measure_id, count(*) AS facts, count(DISTINCT document_id) AS documents FROM facts GROUP BY 1) SELECT count(*) AS measures, count(*) FILTER (documents > 1) AS shared, round(count(*) FILTER (documents > 1) / count(*), 4) AS shared_rate, max(facts) AS most_facts FROM m")
def registry_stats(spark, sf):
    """AGG-6, AGG-10, AGG-11."""
    m = _facts(spark, sf).groupBy("measure_id").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("document_id").alias("documents"))
    n = F.count(F.lit(1))
    return m.agg(n.alias("measures"), F.count_if(F.col("documents") > 1).alias("shared"), F.round(F.count_if(F.col("documents") > 1) / n, 4).alias("shared_rate"), F.max("facts").alias("most_facts"))


@query(f"""WITH {FACTS}, q AS (SELECT 'segment' AS key, segment AS value FROM facts UNION ALL SELECT 'geography', geography FROM facts UNION ALL SELECT 'definition', definition FROM facts)
SELECT key, count(*) AS facts, array_to_string(list_sort(list(DISTINCT value))[1:200], ', ') AS values, row_number() OVER (ORDER BY count(*) DESC, key) AS place FROM q WHERE value IS NOT NULL GROUP BY key""")
def qualifier_values(spark, sf):
    """AGG-11, AGG-12, JSN-5, JSN-6, SRT-6: each qualifier's facts and its sorted distinct values, 200 at most, most used first."""
    used = _facts(spark, sf).select(F.explode("qualifiers")).groupBy("key", "value").agg(_count())
    ranked = used.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("value")))
    keys = ranked.groupBy("key").agg(F.sum("n").alias("facts"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 200, F.col("value")))), ", ").alias("values"))
    return keys.withColumn("place", F.row_number().over(Window.orderBy(F.desc("facts"), "key"))).orderBy("place")


@query(f"WITH {VERDICTS}, o AS (SELECT l_id, r_id, 'old' AS relation_type FROM decided WHERE l_id % 3 = 0), n AS (SELECT l_id, r_id, relation_type FROM decided WHERE l_id % 2 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.l_id = o.l_id AND n.r_id = o.r_id)")
def upsert_relations(spark, sf):
    """SNK-6."""
    rows = lambda where: reconcile.relations(_facts(spark, sf), where=where).select("l_id", "r_id", "relation_type")
    return read.upsert(rows("l_id % 3 = 0").withColumn("relation_type", F.lit("old")), rows("l_id % 2 = 0"), ["l_id", "r_id"])


@query("SELECT CAST(p_partkey AS VARCHAR) || ' | ' || h || ' = ' || v AS line FROM (SELECT p_partkey, 'p_size' AS h, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part) WHERE v IS NOT NULL")
def unpivot_table(spark, sf):
    """LAY-6."""
    return read.unpivot(_t(spark, sf, "part"), "p_partkey", ["p_size", "p_brand", "p_type"])


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v), s AS (SELECT q.vec_id AS q_id, a.vec_id, round(list_inner_product(a.v, q.v) / (a.n * q.n), 6) AS score FROM n q JOIN n a ON a.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT q_id, vec_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk(spark, sf):
    """JON-7, WIN-1, SRT-8, LEX-3: every id divisible by 50 against all vectors."""
    return read.vector_topk(_t(spark, sf, "embeddings"))


_TERMS = ["thonti", "edthe", "anble"]


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w), p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM w) WHERE term IN ({", ".join(f"'{t}'" for t in _TERMS)}) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM p JOIN d USING (term) CROSS JOIN s GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 8""")
def bm25_topk(spark, sf):
    """JON-8, LEX-1, LEX-2."""
    return read.bm25(_t(spark, sf, "documents"), "doc_id", "text", _TERMS, 8)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_verdicts(spark, sf_dir)


def queries() -> dict[str, Query]:
    return registered()


def oracle_sql() -> dict[str, str]:
    return sql_of()


from claimloom.plans import matching, normalised, views  # noqa: E402, F401  they register their queries
