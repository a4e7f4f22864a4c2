"""Adapters from plain tables to the claim model: facts, their restatements, candidates and evidence (SRC-13, §7.3).

The expressions are portable SQL, so that the same derivation can be checked on another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "o_orderkey"
_START = f"CAST(CASE {_K} % 4 WHEN 0 THEN date_trunc('month', o_orderdate) WHEN 1 THEN date_trunc('quarter', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate) END AS DATE)"
_END = (
    f"CAST(CASE {_K} % 4 WHEN 0 THEN date_trunc('month', o_orderdate) + INTERVAL '1' MONTH WHEN 1 THEN date_trunc('quarter', o_orderdate) + INTERVAL '3' MONTH"
    " WHEN 2 THEN date_trunc('year', o_orderdate) + INTERVAL '12' MONTH END - INTERVAL '1' DAY AS DATE)"
)
_SHARED = {
    "measure_id": "o_custkey", "page_id": f"{_K} % 7", "kind": f"CASE WHEN {_K} % 17 = 0 THEN 'categorical' ELSE 'numeric' END",
    "period_start": _START, "period_end": _END, "period_label": f"CASE WHEN {_K} % 3 = 0 THEN 'label ' || CAST({_K} % 4 AS VARCHAR(9)) || '/' || CAST(year(o_orderdate) AS VARCHAR(9)) END",
    "segment": f"CASE WHEN {_K} % 5 = 0 THEN 'Retail' WHEN {_K} % 5 = 1 THEN 'wholesale' END", "evidence_score": f"CAST(80 + {_K} % 21 AS DOUBLE)", "confidence": f"CAST(50 + 5 * ({_K} % 10) AS DOUBLE) / 100",
}
_ORIGINAL = {
    "id": f"{_K} * 2", "document_id": f"{_K} % 25", "value_base": f"CASE WHEN {_K} % 17 <> 0 THEN o_totalprice END", "unit_scale": f"CAST(CASE {_K} % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS DOUBLE)",
    "basis": "CASE o_orderstatus WHEN 'F' THEN 'actual' WHEN 'O' THEN 'projection' ELSE 'provisional' END", "value_text": f"'v' || CAST({_K} AS VARCHAR(20))",
    "entity": f"CASE WHEN {_K} % 13 = 0 THEN NULL WHEN {_K} % 11 = 0 THEN 'subsidiary' ELSE c_mktsegment END", "unit_class": f"CASE WHEN {_K} % 19 = 0 THEN 'count' ELSE 'currency' END",
    "currency": f"CASE WHEN {_K} % 19 = 0 THEN NULL WHEN {_K} % 10 = 3 THEN 'EUR' ELSE 'USD' END", "geography": f"CASE WHEN {_K} % 8 = 2 THEN 'north' END", "definition": f"CASE WHEN {_K} % 9 = 4 THEN 'gross' END",
}
_RESTATED = {
    "id": f"{_K} * 2 + 1", "document_id": f"({_K} + 1) % 25",
    "value_base": f"CASE WHEN {_K} % 17 = 0 THEN NULL WHEN {_K} % 12 < 3 THEN o_totalprice WHEN {_K} % 12 < 6 THEN CAST(floor(o_totalprice / 1000) AS DOUBLE) * 1000 WHEN {_K} % 12 < 9 THEN o_totalprice * 1.03e0 ELSE o_totalprice * 3.0e0 END",
    "unit_scale": "CAST(1000 AS DOUBLE)", "basis": f"CASE WHEN {_K} % 12 IN (0, 3, 6) THEN NULL WHEN {_K} % 12 IN (1, 4, 7, 9) THEN ' Restated' ELSE 'estimate' END", "value_text": f"'w' || CAST({_K} AS VARCHAR(20))",
    "entity": f"CASE WHEN {_K} % 14 = 0 THEN NULL ELSE c_mktsegment END", "unit_class": f"CASE WHEN {_K} % 23 = 0 THEN 'ratio' WHEN {_K} % 41 = 0 THEN NULL ELSE 'currency' END",
    "currency": f"CASE WHEN {_K} % 23 = 0 OR {_K} % 41 = 0 THEN NULL WHEN {_K} % 10 = 3 THEN 'EUR' ELSE 'USD' END", "geography": f"CASE WHEN {_K} % 16 = 2 THEN 'North ' WHEN {_K} % 16 = 10 THEN 'south' END", "definition": f"CASE WHEN {_K} % 18 = 4 THEN 'Gross' END",
}
_QUALIFIERS = ("segment", "geography", "definition")
#: Columns of the SQL; facts() has qualifiers, a map, for the last ones as well.
COLUMNS = [
    "id", "document_id", "page_id", "measure_id", "entity", "kind", "value_text", "value_base", "unit_class", "currency", "unit_scale", "period_label", "period_start", "period_end", "basis", "confidence", "evidence_score", *_QUALIFIERS,
]


def _select(own: dict) -> str:
    return ", ".join(f"{(own | _SHARED)[c]} AS {c}" for c in COLUMNS)


#: The facts as a SQL query over orders and customer.
FACTS_SQL = f"SELECT {_select(_ORIGINAL)} FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT {_select(_RESTATED)} FROM orders JOIN customer ON o_custkey = c_custkey"


def qualifier_map(*names: str):
    """A map of the named columns, without nulls."""
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull())


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    joined = orders.join(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda own: joined.selectExpr(*[f"{(own | _SHARED)[c]} AS {c}" for c in COLUMNS])
    return pick(_ORIGINAL).unionByName(pick(_RESTATED)).withColumn("qualifiers", qualifier_map(*_QUALIFIERS))


# Fixed dimensions around the facts: 25 documents of seven pages, a measure per customer, rejections, jobs.
DOCUMENTS_SQL = (
    "SELECT n_nationkey AS document_id, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS title, lower(n_name) || '.pdf' AS filename, r_name AS publisher, 10000 - n_nationkey * 7 AS created,"
    " CASE WHEN n_nationkey % 5 = 0 THEN 'failed' ELSE 'ready' END AS status, 7 AS page_count, n_nationkey % 6 AS scanned_pages, n_nationkey % 4 AS ocr_pages FROM nation JOIN region ON n_regionkey = r_regionkey"
)
PAGES_SQL = (
    "SELECT n_nationkey AS document_id, p AS page_id, p + 1 AS page_number, CASE WHEN p > 1 THEN 'p-' || CAST(p - 1 AS VARCHAR(9)) END AS printed_label, CASE WHEN p = 0 THEN 'toc' WHEN p % 3 = 0 THEN 'table' ELSE 'prose' END AS page_type, p > 0 AS extracted"
    " FROM nation CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS v(p)"
)
MEASURES_SQL = (
    "SELECT c_custkey AS id, 'm-' || CAST(c_custkey AS VARCHAR(20)) AS slug, lower(c_name) AS name, CASE c_custkey % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'ratio' WHEN 2 THEN 'currency' END AS unit_class, c_mktsegment AS entity, 1 + c_custkey % 3 AS alias_count FROM customer"
)
REJECTIONS_SQL = (
    "SELECT l.doc_id AS id, l.doc_id % 25 AS document_id, 1 + l.doc_id % 7 AS page_number, CASE WHEN toxic = 1 THEN 'value_absent_from_quote' WHEN lang = 'en' THEN 'quote_not_found' ELSE 'low_confidence' END AS reason FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 0"
)
JOBS_SQL = "SELECT event_id AS id, user_id % 25 AS document_id, CASE event_id % 5 WHEN 0 THEN 'parsing' WHEN 1 THEN 'linking' WHEN 2 THEN 'failed' ELSE 'done' END AS stage, value AS progress, ts AS started FROM events"


def _selected(spark: SparkSession, sf_dir: str, sql: str, **tables: str) -> DataFrame:
    """A portable query over tables of the folder: {name} stands for each."""
    return spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables.values()})


def _bound(sql: str, *names: str) -> str:
    """The SQL with table names as parameters of spark.sql."""
    for name in names:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name} ", f"{word} {{{name}}} ").replace(f"{word} {name})", f"{word} {{{name}}})")
        if sql.endswith(f"FROM {name}"):
            sql = sql[: -len(name)] + "{" + name + "}"
    return sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, _bound(DOCUMENTS_SQL, "nation", "region"), a="nation", b="region")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, _bound(PAGES_SQL, "nation"), a="nation")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, _bound(MEASURES_SQL, "customer"), a="customer")


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, _bound(REJECTIONS_SQL, "labels", "documents"), a="labels", b="documents")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, _bound(JOBS_SQL, "events"), a="events")
