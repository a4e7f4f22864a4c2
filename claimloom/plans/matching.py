"""Queries of grounding, text matching, registries and pages, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import fuzzy, jsontext, text, unittext
from claimloom.operators import ground, layout, read, registry
from claimloom.plans.base import query, rows_of
from claimloom.plans.normalised import _dealt, _known

# Grounding: a known sentence in front of each document's text, and a candidate per kind of evidence.
_PAGE = "concat('Acme sold ', k, ' units in the north in May. ', t)"
#: Changed fields of a candidate → reason (none: kept), and whether its place is that of the exact quote.
EVIDENCE = [
    ({}, None, True), ({"evidence_quote": "concat('SOLD  ', k, ' Units in the NORTH')"}, None, True), ({"evidence_quote": "concat('sold ', k, ' unitz in thee north')"}, None, None), ({"evidence_quote": "'qqq zzz xxx jjj www vvv kkk ppp'"}, "quote_not_found", None),
    ({"value_text": "'987654321'"}, "value_absent_from_quote", True), ({"subject": "'The Company'"}, "subject_unresolved", None), ({"predicate": "'for the'"}, "predicate_unresolved", None), ({"predicate": "'Increased  by'"}, "predicate_unresolved", None), ({"confidence": "0.1D"}, "low_confidence", None),
    ({"statement": "' '"}, "missing_required_fields", None), ({"evidence_quote": "'x'"}, "quote_too_short", None), ({"evidence_quote": "concat('jjj qqq zzz | sold ', k, ' units in the north')"}, None, True), ({"evidence_quote": "'in'"}, "ambiguous_short_quote", None), ({"evidence_quote": "concat('zq', k)"}, "quote_not_found", None),
    ({"value_text": "concat(k, '.0')"}, None, True), ({"subject": "'-'"}, "subject_unresolved", None), ({"predicate": "'particulars'"}, "predicate_unresolved", None),
]
_FIELDS = {"statement": "'s'", "subject": "'Acme'", "predicate": "'units sold'", "value_text": "k", "evidence_quote": "concat('sold ', k, ' units in the north')", "confidence": "0.9D", "period": "'May'"}


def _evidence_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if r is None else repr(r)}" for i, (_, r, _) in enumerate(EVIDENCE))
    places = " ".join(f"WHEN {i} THEN {'5' if p else 'NULL'}" for i, (_, _, p) in enumerate(EVIDENCE))
    return f"""WITH c AS (SELECT doc_id AS page_id, 0 AS position, doc_id % {len(EVIDENCE)} AS i FROM documents UNION ALL SELECT doc_id, 1, 0 FROM documents)
SELECT page_id, position, CASE WHEN position = 1 THEN CASE WHEN i = page_id % {len(EVIDENCE)} THEN 'duplicate_of_existing_fact' ELSE CASE WHEN page_id % {len(EVIDENCE)} IN (1, 11) THEN 'duplicate_of_existing_fact' END END ELSE CASE i {cases} END END AS reason, CASE WHEN i = 2 THEN NULL ELSE CASE i {places} END END AS "start" FROM c"""


@query(_evidence_sql())
def ground_documents(spark, sf):
    """GRD-1..8, TXT-1..4, WIN-3: two candidates a page, every kind of evidence."""
    docs = rows_of(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.coalesce("text", F.lit("")).alias("t"), (F.col("doc_id") + 70_000_000).cast("string").alias("k"))
    kinds = F.col("page_id") % len(EVIDENCE)

    def candidates(position: int):
        field = lambda f: F.expr("CASE i " + " ".join(f"WHEN {i} THEN {c.get(f, _FIELDS[f])}" for i, (c, _, _) in enumerate(EVIDENCE)) + " END")
        rows = docs.withColumns({"i": kinds if position == 0 else F.lit(0).cast("long"), "page_text": F.expr(_PAGE), "position": F.lit(position)})
        return rows.select("page_id", "position", "page_text", "i", *[field(f).alias(f) for f in _FIELDS])

    found = ground.ground(candidates(0).unionByName(candidates(1)))
    return found.select("page_id", "position", "reason", F.when((F.col("i") != 2) & (F.col("reason").isNull() | F.col("reason").isin("duplicate_of_existing_fact", "value_absent_from_quote")), F.col("start")).alias("start"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN doc_id + 10000000 ELSE doc_id END AS page_id, doc_id % 4 AS i FROM documents WHERE length(text) > 60)
SELECT doc_id, CASE i WHEN 0 THEN 'ok' WHEN 1 THEN 'moved' WHEN 2 THEN 'value_absent' ELSE 'page_missing' END AS finding FROM f""")
def audit_facts(spark, sf):
    """GRD-11: stored facts against their pages: fine, moved by two characters, of a value that isn't there, without a page."""
    pages = rows_of(spark, sf, "documents").where("length(text) > 60").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("Sales were 70 in all. "), F.col("text")).alias("page_text"))
    i = F.col("page_id") % 4
    facts = pages.select(F.col("page_id").alias("doc_id"), F.when(i == 3, F.col("page_id") + 10_000_000).otherwise(F.col("page_id")).alias("page_id"), F.lit("Sales were 70").alias("evidence_quote"), F.when(i == 1, 2).otherwise(0).alias("start"), F.when(i == 1, 15).otherwise(13).alias("end"), F.when(i == 2, "987654321").otherwise("70").alias("value_text"))
    return ground.audited(facts, pages).select("doc_id", "finding")


@query("""SELECT o_orderkey AS page_id, 'v' || o_orderkey AS value_text, 'unattributed_by_model' AS reason, CASE WHEN o_orderkey % 2 = 0 THEN 'no row label' ELSE 'no subject and measure could be attached' END AS detail FROM orders WHERE o_orderkey % 3 <> 0""")
def unattributed_values(spark, sf):
    """GRD-9."""
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" v"), k.cast("string")))
    rows = rows_of(spark, sf, "orders").select(k.alias("page_id"), F.array(F.struct(value.alias("value_text"), F.when(k % 2 == 0, "no row label ").otherwise("").alias("reason"))).alias("entries"))
    return ground.unattributed(rows)


#: Two texts → likeness of their words, whether the first holds the second.
LIKE = [
    ("Revenue from operations", "operations revenue from", 100.0, False), ("revenue from operations", "revenue", 100.0, True), ("", "x", 0.0, False), ("alpha beta", "gamma", 26.666666666666668, False), ("net profit", "net profits", 95.23809523809524, False),
    ("Net-\nworth of  it", "NETWORTH", 100.0, True), ("cost of sales", "cost of goods", 70.0, False), ("a “b” c", 'a "B"', 100.0, True),
]


@query(_known([(round(c[2], 6), c[3]) for c in LIKE], ["likeness", "holds"], ["DOUBLE", "BOOLEAN"]))
def text_likeness(spark, sf):
    """TXT-1, TXT-5, TXT-6."""
    rows = _dealt(spark, sf, LIKE, ["a", "b"], ["string", "string"])
    return rows.select("o_orderkey", F.round(fuzzy.similarity(F.col("a"), F.col("b")), 6).alias("likeness"), fuzzy.contains_normalized(F.col("a"), F.col("b")).alias("holds"))


@query("""WITH d AS (SELECT doc_id, text, least(length(text), 200) AS e FROM documents WHERE length(text) >= 150 ) SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(text[1:79]) || '…' ELSE text END AS short, sha256(text) AS hash, sha256('{"a":' || doc_id || ',"b":null}') AS key FROM d""")
def text_pieces(spark, sf):
    """TXT-8, TXT-13."""
    rows = rows_of(spark, sf, "documents").where("length(text) >= 150")
    return rows.select("doc_id", text.truncated(F.col("text"), 80).alias("short"), text.content_hash(F.col("text")).alias("hash"), text.stable_key({"b": F.lit(None).cast("string"), "a": F.col("doc_id")}).alias("key"))


#: start, end, radius → context in "One two. Three four! Five six? Seven eight."
AROUND = [(37, 42, "Five six? Seven eight."), (21, 25, "Three four! Five six? Seven eight."), (0, 3, "One two. Three four! Fi"), (9, 14, "One two. Three four! Five six? Sev")]


@query(_known([(c[2],) for c in AROUND], ["around"], ["VARCHAR"]))
def text_context(spark, sf):
    """TXT-7."""
    rows = _dealt(spark, sf, AROUND, ["s", "e"], ["int", "int"])
    return rows.select("o_orderkey", text.context(F.lit("One two. Three four! Five six? Seven eight."), F.col("s"), F.col("e"), 20).alias("around"))


# Registries: customers are known by name, and by vectors that the embeddings stand for.
@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey END AS id FROM customer""")
def registry_resolve(spark, sf):
    """JON-10, REG-3: names with an article or a legal form, and unknown ones."""
    rows = rows_of(spark, sf, "customer").select("c_custkey", "c_name")
    known = rows.select(F.col("c_custkey").alias("id"), F.array(F.col("c_name"), F.concat(F.lit("alias of "), "c_name")).alias("aliases"))
    k = F.col("c_custkey") % 3
    asked = rows.select("c_custkey", F.when(k == 0, F.concat(F.lit("The "), "c_name", F.lit(" Ltd."))).when(k == 1, F.upper(F.concat(F.lit("alias of "), "c_name"))).otherwise(F.concat(F.lit("unknown "), "c_name")).alias("surface"))
    return registry.resolve(asked, known, True).select("c_custkey", "id")


@query("""WITH b AS (SELECT lower(c_mktsegment) AS base, c_custkey FROM customer), t AS (SELECT base, base AS slug FROM (SELECT DISTINCT base FROM b WHERE base <> 'building') UNION ALL SELECT 'machinery', 'machinery-3')
SELECT 'new ' || base AS name, CASE base WHEN 'building' THEN 'new-building' ELSE 'new-' || base END AS slug FROM (SELECT DISTINCT base FROM b) UNION ALL SELECT base AS name, CASE base WHEN 'building' THEN 'building' ELSE base || '-2' END FROM (SELECT DISTINCT base FROM b)""")
def registry_create(spark, sf):
    """REG-5, REG-7: slugs beside taken ones, one of which ends in a number already."""
    names = rows_of(spark, sf, "customer").select(F.lower("c_mktsegment").alias("base")).distinct()
    asked = names.select(F.col("base").alias("surface")).union(names.select(F.concat(F.lit("New "), "base")))
    taken = names.where("base <> 'building'").select(F.col("base").alias("slug")).union(names.where("base = 'machinery'").select(F.lit("machinery-3")))
    return registry.create(asked, taken).select("name", "slug")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v), r AS (SELECT * FROM n WHERE vec_id % 10 = 0), s AS (SELECT * FROM n WHERE vec_id % 50 = 7),
p AS (SELECT s.vec_id AS s_id, r.vec_id AS m_id, round(list_inner_product(s.v, r.v) / (s.n * r.n), 9) AS c, row_number() OVER (PARTITION BY s.vec_id ORDER BY list_inner_product(s.v, r.v) / (s.n * r.n) DESC, r.vec_id) AS k FROM s JOIN r ON s.label % 4 = 3 OR r.label % 3 = 2 OR s.label % 4 = r.label % 3)
SELECT s_id, m_id, round(c, 6) AS cosine FROM p WHERE k = 1""")
def registry_nearest(spark, sf):
    """JON-11, REG-2: the nearest row of a fitting class, a null class on either side fitting all."""
    v = rows_of(spark, sf, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    label = F.col("label")
    reg = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), vector, F.when(label % 3 != 2, (label % 3).cast("string")).alias("unit_class"))
    asked = v.where("vec_id % 50 = 7").select(F.col("vec_id").alias("surface"), vector, F.when(label % 4 != 3, (label % 4).cast("string")).alias("unit_class"))
    return registry.nearest(asked, reg, -1.0).select(F.col("surface").alias("s_id"), F.col("measure_id").alias("m_id"), F.round("cosine", 6).alias("cosine"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'alias' WHEN 1 THEN 'linked' WHEN 2 THEN 'created' WHEN 3 THEN 'asked' ELSE 'created' END AS decision, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 2 END AS id FROM customer""")
def registry_decisions(spark, sf):
    """REG-1, REG-8: alias, link, new, an answer that fits, and an answer of another unit class."""
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.lit("Net sales")).otherwise(F.concat(F.lit("name "), F.col("c_custkey").cast("string")))
    angle = F.when(k.isin(0, 1), 0.01).when(k == 2, 1.2).otherwise(0.5)
    asked = rows_of(spark, sf, "customer").select("c_custkey", name.alias("surface"), F.array(F.cos(angle), F.sin(angle)).alias("vector"), F.lit("currency").alias("unit_class"))
    reg = spark.createDataFrame([(1, ["net sales"], [1.0, 0.0], "currency"), (2, ["other"], [-1.0, 0.0], None), (3, ["third"], [-1.0, 0.1], "count")], "id long, aliases array<string>, vector array<double>, unit_class string")
    answers = asked.where(k.isin(3, 4)).select("surface", F.when(k == 3, 2).otherwise(3).cast("long").alias("id"))
    found = registry.decided(asked.select("surface", "vector", "unit_class").dropDuplicates(["surface"]), reg, answers)
    return asked.select("c_custkey", "surface").join(found, "surface").select("c_custkey", "decision", "id")


@query("""WITH s AS (SELECT c_nationkey AS id, c_mktsegment AS surface, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS unit_class, c_custkey AS position FROM customer), f AS (SELECT id, arg_min(unit_class, position) FILTER (unit_class IS NOT NULL) AS uc, list(DISTINCT surface) AS more FROM s GROUP BY 1)
SELECT n_nationkey AS id, array_to_string(list_sort(list_distinct(list_concat([n_name], coalesce(more, [])))), ',') AS aliases, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'kept' END, uc) AS unit_class FROM nation LEFT JOIN f ON f.id = n_nationkey""")
def registry_aliases(spark, sf):
    """REG-4, REG-6, JSN-6."""
    reg = rows_of(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.array("n_name").alias("aliases"), F.when(F.col("n_nationkey") % 2 == 0, "kept").alias("unit_class"))
    seen = rows_of(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("surface"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("unit_class"), F.col("c_custkey").alias("position"))
    return registry.with_aliases(reg, seen).select("id", F.array_join("aliases", ",").alias("aliases"), "unit_class")


# Pages: signals that are given → type.
PAGES = [
    (3.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.8, 0.0, 0.0, 0.0, "scanned", False), (3.0, 40.0, 0.0, 0.0, 0.0, 0.0, 0.8, 0.0, 0.0, 0.0, "empty", False), (90.0, 500.0, 0.1, 0.0, 0.4, 0.0, 0.0, 0.0, 0.0, 0.0, "toc", False), (20.0, 100.0, 0.1, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "boilerplate", False),
    (120.0, 600.0, 0.3, 0.4, 0.0, 0.0, 0.2, 0.0, 0.0, 0.0, "chart", True), (120.0, 600.0, 0.3, 0.4, 0.0, 0.0, 0.05, 0.5, 0.0, 0.0, "chart", False), (300.0, 1500.0, 0.4, 1.9, 0.0, 0.3, 0.0, 0.0, 0.0, 1.0, "table", False), (300.0, 1500.0, 0.4, 2.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, "mixed", False),
    (300.0, 1500.0, 0.26, 1.5, 0.0, 0.0, 0.0, 0.0, 5.0, 0.0, "table", False), (300.0, 1500.0, 0.2, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "mixed", False), (300.0, 1500.0, 0.02, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "prose", False),
]
_SIGNALS = ["words", "chars", "numeric_share", "sentence_density", "toc_score", "table_coverage", "image_ratio", "vector_density", "ruling_lines", "tables"]


@query(_known([c[10:] for c in PAGES], ["page_type", "vision"], ["VARCHAR", "BOOLEAN"]))
def page_types(spark, sf):
    """CLS-1, CLS-3: every type of page."""
    rows = _dealt(spark, sf, PAGES, _SIGNALS, ["double"] * 10).withColumn("page_type", text.page_type({k: F.col(k) for k in _SIGNALS}))
    return rows.select("o_orderkey", "page_type", text.vision_candidate(F.col("page_type"), F.col("image_ratio"), F.lit(3)).alias("vision"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 9 AS n FROM part) SELECT k, (SELECT count(*) FROM range(n) r(i) WHERE 60.0 + 20 * i >= 150 AND i % 3 <> 2)::INT AS rules, round(least(1.0, (SELECT coalesce(sum((60.0 + 20 * i) * (CASE WHEN i % 3 = 2 THEN 300.0 ELSE 1.0 END)), 0) FROM range(n) r(i)) / (600 * 800)), 6) AS area FROM p""")
def page_drawings(spark, sf):
    """SRC-8, SRC-9: lines across a page of 600 by 800, and what boxes cover of it."""
    n = (F.col("p_partkey") % 9).cast("int")
    width = lambda i: F.lit(60.0) + 20 * i
    boxes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(10.0).alias("x0"), F.lit(50.0).alias("y0"), (width(i) + 10).alias("x1"), (F.when(i % 3 == 2, 300.0).otherwise(1.0) + 50).alias("y1")))).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    rows = rows_of(spark, sf, "part").select(F.col("p_partkey").alias("k"), boxes.alias("b"))
    return rows.select("k", text.ruling_lines(F.col("b"), F.lit(600.0)).alias("rules"), F.round(text.area_ratio(F.col("b"), F.lit(600.0), F.lit(800.0)), 6).alias("area"))


@query("SELECT vec_id AS q_id, count(*) AS n FROM embeddings WHERE vec_id % 50 = 0 GROUP BY 1")
def vector_neighbours(spark, sf):
    """JON-7, CND-2: neighbours of the vector route, each vector at least its own copy's: k + 1 with least cosine 0.82."""
    v = rows_of(spark, sf, "embeddings").select("vec_id", "embedding")
    twins = v.unionByName(v.where("vec_id % 50 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), "embedding"))
    return read.vector_topk(twins, 50, 1, 0.82).where("q_id >= 0 and vec_id = -q_id - 1").groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT p_partkey AS id, lower(p_type || ' ' || p_brand) AS t FROM part), x AS (SELECT id, list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda v: v <> '') AS ts FROM w), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM x),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM x) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT id AS l_id, term FROM (SELECT id, unnest(ts) AS term FROM x) WHERE length(term) > 2 AND term NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'its', 'was', 'were', 'has', 'had', 'are', 'per', 'total', 'limited', 'ltd')),
sc AS (SELECT l_id, tf.id AS r_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN s GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS k FROM sc), p AS (SELECT l_id, r_id, score FROM b WHERE k <= 9 AND l_id <> r_id) SELECT * FROM (SELECT l_id, r_id, score, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS rank FROM p) WHERE rank <= 8""")
def lexical_neighbours(spark, sf):
    """JON-8, LEX-1, LEX-2, LEX-4: every part's eight nearest by its words."""
    parts = rows_of(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    return read.lexical_neighbours(parts)


#: Texts → query words.
ASKED = [("The total cost of sales, and sales per unit", "cost,sales,unit"), ("a an of to", ""), ("One two three four five six seven eight nine ten", "one,two,three,four,five,six,seven,eight"), ("Été-2024 revenue (net)", "été,2024,revenue,net"), ("", "")]


@query(_known([(c[1],) for c in ASKED], ["words"], ["VARCHAR"]))
def query_words(spark, sf):
    """LEX-1."""
    return _dealt(spark, sf, ASKED, ["s"], ["string"]).select("o_orderkey", F.array_join(read.query_words(F.col("s")), ",").alias("words"))


@query("SELECT o_orderkey, CASE k WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 5 END AS page_number, o_orderkey * 10 + k AS v FROM orders, (VALUES (0), (1), (2), (3)) t(k)")
def answers_by_page(spark, sf):
    """JSN-4: an answer's facts go to the page they name, to the first one if that wasn't asked for."""
    k = F.col("o_orderkey")
    fact = lambda page, n: F.concat(F.lit('{"page_number": ' + page + ', "o": '), k.cast("string"), F.lit(', "v": '), (k * 10 + n).cast("string"), F.lit("}"))
    text = F.concat(F.lit('{"facts": ['), F.concat_ws(", ", fact("5", 0), fact("6", 1), fact("77", 2), fact("null", 3)), F.lit("]}"))
    rows = rows_of(spark, sf, "orders").select(text.alias("text"), F.lit(5).alias("first_page"), F.array(F.lit(5), F.lit(6)).alias("pages"))
    found = jsontext.by_page(rows)
    return found.select(F.get_json_object("fact", "$.o").cast("long").alias("o_orderkey"), "page_number", F.get_json_object("fact", "$.v").cast("long").alias("v"))


@query("""SELECT doc_id, list_has_all(string_split_regex(lower(text || ' ' || source || ' ' || lang), '[^\\p{L}\\p{N}]+'), ['en', 'tion']) AS found FROM documents WHERE lang = 'en' AND list_has_all(string_split_regex(lower(text || ' ' || source || ' ' || lang), '[^\\p{L}\\p{N}]+'), ['en', 'tion'])""")
def fact_search_columns(spark, sf):
    """FLT-5 over several columns."""
    return read.search_any_column(rows_of(spark, sf, "documents").where("lang = 'en'"), ["text", "source", "lang"], "EN, tion").select("doc_id", F.lit(True).alias("found"))


_WORDS = "array(named_struct('text', 'Net', 'x0', 10D, 'y0', {y}, 'x1', 30D, 'y1', {y} + 10), named_struct('text', 'sales,', 'x0', 35D, 'y0', {y} + 1, 'x1', 70D, 'y1', {y} + 11), named_struct('text', 'rose', 'x0', 200D, 'y0', {y}, 'x1', 230D, 'y1', {y} + 10), named_struct('text', '12%', 'x0', 10D, 'y0', {y} + 20, 'x1', 30D, 'y1', {y} + 30))"


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '10,' || y || ',70,' || (y + 11) WHEN 1 THEN '10,' || y || ',70,' || (y + 11) || ' 200,' || y || ',230,' || (y + 10) || ' 10,' || (y + 20) || ',30,' || (y + 30) WHEN 2 THEN '' ELSE '10,' || (y + 20) || ',30,' || (y + 30) END AS boxes FROM (SELECT p_partkey, p_partkey % 90 AS y FROM part)""")
def quote_boxes(spark, sf):
    """GRD-10: neighbours of a line are one box, a wide gap and a new line begin others."""
    rows = rows_of(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 90).cast("double").alias("y"))
    quote = F.get(F.array(F.lit("net SALES"), F.lit("Net sales rose 12%"), F.lit("net losses"), F.lit("12%")), (F.col("k") % 4).cast("int"))
    found = rows.select("k", text.quote_boxes(F.expr(_WORDS.format(y="y")), quote).alias("b"))
    whole = lambda b: F.concat_ws(",", *[b[c].cast("long").cast("string") for c in ("x0", "y0", "x1", "y1")])
    return found.select("k", F.array_join(F.transform("b", whole), " ").alias("boxes"))


@query("""WITH p AS (SELECT o_orderkey AS l_id, o_orderkey + 1 AS r_id, o_orderkey % 4 AS k FROM orders) SELECT l_id, r_id, CASE k WHEN 0 THEN 'corroborates' WHEN 1 THEN 'reconciled' ELSE 'contradicts' END AS relation_type, CASE k WHEN 0 THEN 0.7 WHEN 1 THEN 0.55 ELSE 0.9 END::DOUBLE AS confidence, k = 1 AS order_sensitive FROM p WHERE k < 3""")
def adjudicated_pairs(spark, sf):
    """ADJ-4: answers joined in both orders: agreeing, order sensitive, asked in one order only, not asked."""
    k = F.col("l_id") % 4
    pairs = rows_of(spark, sf, "orders").select(F.col("o_orderkey").alias("l_id"), (F.col("o_orderkey") + 1).alias("r_id"))
    one = pairs.where(k < 2).select(F.col("l_id").alias("first_id"), F.col("r_id").alias("second_id"), F.when(k == 0, "corroborates").otherwise("contradicts").alias("answer"), F.lit(0.8).alias("confidence"))
    two = pairs.where(k < 3).select(F.col("r_id").alias("first_id"), F.col("l_id").alias("second_id"), F.when(k == 0, "corroborates").when(k == 1, "reconciled").otherwise("contradicts").alias("answer"), F.when(k == 2, 0.9).otherwise(0.6).alias("confidence"))
    return read.adjudicated(pairs, one.unionByName(two)).select("l_id", "r_id", "relation_type", F.round("confidence", 9).alias("confidence"), "order_sensitive")


#: currency, scale → note.
NOTES = [("INR", 1e6, "INR, million"), (None, 1e7, "crore"), ("USD", None, "USD"), (None, None, None), ("EUR", 1.0, "EUR")]


@query(_known([(c[2],) for c in NOTES], ["note"], ["VARCHAR"]))
def unit_notes(spark, sf):
    """SNK-10, UNT-9."""
    return _dealt(spark, sf, NOTES, ["c", "s"], ["string", "double"]).select("o_orderkey", unittext.unit_note(F.col("c"), F.col("s")).alias("note"))


#: Answers of a model → the JSON in them, and what is left of it where it is cut off.
ANSWERS = [
    ('{"a": 1}', '{"a": 1}', '{"a": 1}'), ('Here:\n```json\n{"b": [1, 2]}\n```\nDone', '{"b": [1, 2]}', '{"b": [1, 2]}'), ('Sure {"c": "}{"} bye {', '{"c": "}{"}', '{"c": "}{"}'), ("nothing", None, None), ("", None, None), (None, None, None),
    ('{"facts": [{"v": 1}, {"v": 2}, {"v": 3', None, '{"facts": [{"v": 1}, {"v": 2}]}'), ('{"facts": [{"v": "x, y"}], "more": [', None, '{"facts": [{"v": "x, y"}]}'), ("[1, 2] and more", "[1, 2]", "[1, 2]"),
]


@query(_known([c[1:] for c in ANSWERS], ["found", "saved"], ["VARCHAR", "VARCHAR"]))
def json_of_answers(spark, sf):
    """JSN-1, JSN-2."""
    return _dealt(spark, sf, ANSWERS, ["s"], ["string"]).select("o_orderkey", jsontext.extract_json(F.col("s")).alias("found"), jsontext.salvage_json(F.col("s")).alias("saved"))


def _box(text_: str, x: str, y: str, width: int = 60) -> str:
    return f"named_struct('text', {text_}, 'x0', CAST({x} AS DOUBLE), 'y0', CAST({y} AS DOUBLE), 'x1', CAST({x} + {width} AS DOUBLE), 'y1', CAST({y} + 10 AS DOUBLE))"


_PAGE_WORDS = "concat(array(" + _box("concat('Title', p_partkey)", "150", "60", 300) + ", " + _box("CAST(p_partkey % 900 AS STRING)", "290", "775", 20) + "), flatten(transform(sequence(0, 7), r -> array(" + _box("concat('r', r)", "340", "(100 + 15 * r)", 200) + ", " + _box("concat('l', r)", "20", "(100 + 15 * r)", 200) + "))))"


#: Pages that one task lays out.
TASK_PAGES = 5_000


def _dealt_parts(spark, sf):
    """Keys of parts, a page each, dealt to as many tasks as they need: the table is small, the work on its pages is not."""
    keys = rows_of(spark, sf, "part").select("p_partkey")
    return keys.repartition(max(1, -(-keys.count() // TASK_PAGES)), "p_partkey")


@query("""SELECT p_partkey AS document_id, 1 AS page_number, 'Title' || p_partkey || chr(10) || (SELECT string_agg('l' || r, chr(10) ORDER BY r) FROM range(8) t(r)) || chr(10) || (p_partkey % 900) || chr(10) || (SELECT string_agg('r' || r, chr(10) ORDER BY r) FROM range(8) t(r)) AS rendition, CAST(p_partkey % 900 AS VARCHAR) AS printed_label FROM part""")
def page_renditions(spark, sf):
    """LAY-1..4, SRC-10, WIN-9: a heading over two columns, read one by one, and the page's printed number below the left one."""
    pages = _dealt_parts(spark, sf).selectExpr("p_partkey AS document_id", "1 AS page_number", "600D AS width", "800D AS height", f"{_PAGE_WORDS} AS words")
    return layout.render(pages)


@query("""SELECT p_partkey AS page_id, l || ' | ' || h || ' = ' || (p_partkey * k) AS line FROM part, (VALUES ('Tea', 'Plan', 1), ('Tea', 'Real', 2), ('Rice', 'Plan', 3), ('Rice', 'Real', 4)) t(l, h, k) WHERE p_partkey % 3 <> 0""")
def table_lines(spark, sf):
    """SRC-6, SRC-7, LAY-6: tables of pages with rules or many numbers; empty columns and tables of one row drop out."""
    k = F.col("p_partkey")
    cell = lambda n: (k * n).cast("string")
    row = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) or x is None else x for x in xs])
    table = F.array(row("Crop", "", " Plan ", "Real"), row("Tea", None, cell(1), cell(2)), row("Rice", "", cell(3), cell(4)))
    words = F.array_repeat(F.lit("word"), 20)
    rows = _dealt_parts(spark, sf).select(k.alias("page_id"), words.alias("words"), F.when(k % 3 == 0, 1).otherwise(4).alias("rules"), F.array(table, F.array(row("one", "row", "1"))).alias("tables"))
    return layout.table_lines(rows)


@query("SELECT p_partkey AS page_id, 'Tea: ' || p_partkey AS line FROM part UNION ALL SELECT p_partkey, 'Rice: 19' FROM part UNION ALL SELECT p_partkey, 'Total crop: 31' FROM part")
def chart_lines(spark, sf):
    """LAY-5: numbers over their labels, and a number beside its label."""
    words = f"array({_box('CAST(p_partkey AS STRING)', '60', '100')}, {_box(chr(39) + '19' + chr(39), '160', '100')}, {_box(chr(39) + 'Tea' + chr(39), '58', '115')}, {_box(chr(39) + 'Rice' + chr(39), '162', '115')}, {_box(chr(39) + 'Total' + chr(39), '10', '300', 30)}, {_box(chr(39) + 'crop' + chr(39), '45', '300', 30)}, {_box(chr(39) + '31' + chr(39), '120', '300', 30)})"
    return layout.chart_lines(_dealt_parts(spark, sf).selectExpr("p_partkey AS page_id", f"{words} AS words"))


@query("SELECT n_nationkey AS document_id, p::INT AS page_number, (CASE n_nationkey % 3 WHEN 0 THEN (p - 1) // 3 WHEN 1 THEN (p - 1) // 4 ELSE p - 1 END)::INT AS batch FROM nation, range(1, 11) t(p)")
def page_batches(spark, sf):
    """WIN-8: ten pages of 3,000 characters, of 10, and of images."""
    k = F.col("n_nationkey")
    pages = rows_of(spark, sf, "nation").select(k.alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page_number"), F.when(k % 3 == 0, 3000).otherwise(10).alias("chars"), (k % 3 == 2).alias("image"))
    return layout.plan_batches(pages)
