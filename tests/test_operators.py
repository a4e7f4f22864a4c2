import datetime as dt
import io
import json

from pyspark.sql import functions as F

from claimloom.operators import ground, read, reconcile, registry
from claimloom.sources import claims, files
from claimloom.streaming import incremental

BASE = dict(
    id=1, document_id=1, page_id=1, measure_id=10, entity="e5", kind="numeric", value_text="v", value_base=6318e7, unit_class="currency", currency="INR", unit_scale=1e7, period_label=None, period_start=dt.date(2019, 4, 1), period_end=dt.date(2020, 3, 31), basis="actual", confidence=0.9, evidence_score=100.0, qualifiers={},
)
RATIO = dict(unit_class="ratio", currency=None, unit_scale=1.0)
#: Changes on either side → type and dimension.
RULES = [
    ({}, {}, ("corroborates", "none")), ({}, dict(value_base=63177.4e6, unit_scale=1e6), ("corroborates", "unit_scale")), (dict(value_base=2.7, **RATIO), dict(value_base=2.73, **RATIO), ("corroborates", "none")), (dict(basis="forecast", value_base=3.1, **RATIO), dict(value_base=3.1, **RATIO), ("corroborates", "vintage")),
    ({}, dict(value_base=1500e7, period_end=dt.date(2019, 6, 30)), ("refines", "period")), ({}, dict(value_base=5521e7, period_start=dt.date(2018, 4, 1), period_end=dt.date(2019, 3, 31)), ("reconciled", "period")), (dict(value_base=None), dict(value_base=None, period_start=dt.date(2018, 4, 1), period_end=dt.date(2019, 3, 31)), ("reconciled", "period")),
    (dict(qualifiers={"tenor": "5y"}), dict(qualifiers={"tenor": "10y"}), ("reconciled", "scope")), ({}, dict(qualifiers={"segment": "food"}), ("reconciled", "segment")), (dict(qualifiers={"definition": "net", "sector": "x"}), dict(qualifiers={"definition": "gross", "sector": "y"}), ("reconciled", "definition")),
    (dict(qualifiers={"product": " Tea"}), dict(qualifiers={"product": "tea ", "colour": "red"}), ("corroborates", "none")), (dict(basis="target", value_base=3.0, **RATIO), dict(value_base=4.1, **RATIO), ("supersedes", "vintage")), ({}, dict(basis="revised", value_base=6500e7), ("supersedes", "vintage")),
    (dict(basis="provisional"), dict(basis="estimate", value_base=6500e7), ("reconciled", "basis")), ({}, dict(basis="pro_forma", value_base=6500e7), ("reconciled", "basis")), (dict(basis="restated", value_base=6500e7), dict(basis="revised"), ("reconciled", "vintage")), ({}, dict(value_base=6600e7), ("contradicts", "none")), (dict(value_base=3.1, **RATIO), dict(value_base=3.2, **RATIO), ("contradicts", "none")),
    ({}, dict(currency="USD"), ("reconciled", "currency")), ({}, dict(unit_class="count", currency=None), ("reconciled", "definition")), ({}, dict(currency=None), ("reconciled", "definition")), (dict(unit_class=None, currency=None), dict(unit_class=None), ("corroborates", "none")),
    ({}, dict(value_base=900e7), ("escalate", None)), ({}, dict(period_start=None, period_end=None), ("escalate", None)), (dict(value_base=None), {}, ("escalate", None)), (dict(confidence=0.5), dict(value_base=6600e7), ("escalate", None)), ({}, dict(entity="e6"), ("dropped", None)), ({}, dict(entity=None), ("corroborates", "none")),
]


def test_rule_table_both_ways(spark):
    schema = (
        "id long, document_id long, page_id long, measure_id long, entity string, kind string, value_text string, value_base double, unit_class string, currency string, unit_scale double, period_label string, period_start date, period_end date,"
        " basis string, confidence double, evidence_score double, qualifiers map<string,string>"
    )
    rows = []
    for i, (left, right, _) in enumerate(RULES):
        for j, (a, b) in enumerate(((left, right), (right, left))):
            m = 100 * i + 10 * j
            rows += [BASE | a | dict(id=2 * m + 1, measure_id=m), BASE | b | dict(id=2 * m + 2, measure_id=m, document_id=2)]
    facts = spark.createDataFrame([tuple(r[c] for c in BASE) for r in rows], schema)
    got = {r.l_measure_id: r for r in reconcile.explained(reconcile.classify(reconcile.measure_pairs(facts))).collect()}
    for i, (left, right, want) in enumerate(RULES):
        one, two = got[100 * i], got[100 * i + 10]
        assert (one.relation_type, one.dimension) == want == (two.relation_type, two.dimension), (i, one)
        if want[0] == "supersedes":
            assert one.superseded_id % 2 == 1 and two.superseded_id % 2 == 0
        if want[0] == "contradicts":
            assert 0 < one.severity <= 1
        assert (one.explanation is None) == (want[0] in ("escalate", "dropped")) and (one.note is None) == (want[0] != "escalate")


def test_runs_bound_the_partners_of_a_fact(spark):
    facts = claims.facts(spark, "/root/testdata/sf0.001").withColumns({"measure_id": F.col("measure_id") % 2, "document_id": F.col("id")})
    pairs = reconcile.measure_pairs(facts, cap=5).select("l_id", "r_id").collect()
    ids = {m: sorted(r.id for r in facts.where(F.col("measure_id") == m).select("id").collect()) for m in (0, 1)}
    want = {(a, b) for own in ids.values() for i in range(0, len(own), 6) for a in own[i : i + 6] for b in own[i : i + 6] if a < b}
    assert {tuple(p) for p in pairs} == want and len(pairs) == len(want)
    # which is what taking pairs in order while both have room comes to
    room, greedy = {}, set()
    own = ids[0][:50]
    for a in own:
        for b in own:
            if a < b and room.get(a, 0) < 5 and room.get(b, 0) < 5:
                room[a], room[b] = room.get(a, 0) + 1, room.get(b, 0) + 1
                greedy.add((a, b))
    assert greedy == {p for p in want if p[0] in own[:48] and p[1] in own} | {p for p in want if p[0] in own[48:] and p[1] in own[48:]}


PAGE = "Income from tolls rose to 6,318 Crore in FY20. Crew of 217 in May, 217 in June. Volume was 11,904 units; costs held. (341) · (502) · (67)"


def test_grounding(spark):
    base = dict(statement="s", subject="Acme", predicate="income from tolls", value_text="6,318", evidence_quote="rose to 6,318 Crore in FY20", confidence=0.9, period="FY20")
    cases = [
        ({}, None), ({}, "duplicate_of_existing_fact"), (dict(evidence_quote="rose to 9,999 Crore elsewhere entirely"), "quote_not_found"), (dict(value_text="5,000"), "value_absent_from_quote"), (dict(value_text="6318", predicate="turnover"), None), (dict(subject="The Company"), "subject_unresolved"),
        (dict(evidence_quote="11,904", value_text="11,904"), None), (dict(evidence_quote="217", value_text="217"), "ambiguous_short_quote"), (dict(evidence_quote="999", value_text="999"), "quote_not_found"), (dict(predicate="rose to"), "predicate_unresolved"), (dict(confidence=0.1), "low_confidence"),
        (dict(evidence_quote="rose  to 6,318 Crore\nin FY20", predicate="sales"), None), (dict(evidence_quote="risen to 6,318 Crore in FY 20", predicate="tolls"), None), (dict(statement=None), "missing_required_fields"), (dict(period="FY21"), None), (dict(evidence_quote="(999) | (341) | (777)", value_text="341", predicate="crew size"), None),
    ]
    rows = [(1, i, PAGE, *[(base | c)[k] for k in base]) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, position int, page_text string, statement string, subject string, predicate string, value_text string, evidence_quote string, confidence double, period string")
    got = {r.position: r for r in ground.ground(df).collect()}
    assert [got[i].reason for i in range(len(cases))] == [w for _, w in cases]
    assert PAGE[got[0].start : got[0].end] == base["evidence_quote"] and got[0].exact and got[11].start == got[0].start


def test_registry(spark):
    reg = spark.createDataFrame([(1, ["Revenue from operations", "Total revenue"], [1.0, 0.0], "currency"), (2, ["Headcount"], [0.0, 1.0], "count")], "id long, aliases array<string>, vector array<double>, unit_class string")
    asked = spark.createDataFrame([("the total Revenue",), ("head-count",), ("new one",)], "surface string")
    assert {r.surface: r.id for r in registry.resolve(asked, reg).collect()} == {"the total Revenue": 1, "head-count": None, "new one": None}
    made = registry.create(spark.createDataFrame([("New One",), ("new one!",), ("new-one",), ("Other",)], "surface string"), spark.createDataFrame([("new-one",), ("fy-2024",), ("other-2",)], "slug string"))
    assert {r.slug for r in made.collect()} == {"new-one-2", "other"}
    taken = spark.createDataFrame([("fy-2024",), ("fy-2024-3",), ("a",), ("a-2",)], "slug string")
    more = registry.create(spark.createDataFrame([("FY 2024",), ("A",), ("b",)], "surface string"), taken)
    assert sorted(r.slug for r in more.collect()) == ["a-3", "b", "fy-2024-2"]
    near = spark.createDataFrame([("sales", [0.99, 0.05], "currency"), ("staff", [0.9, 0.1], "count"), ("x", [0.5, 0.5], None)], "surface string, vector array<double>, unit_class string")
    assert [(r.surface, r.measure_id) for r in registry.nearest(near, reg).collect()] == [("sales", 1)]


def test_sources_and_sinks(spark, tmp_path):
    for n, c in (("a.pdf", b"%PDF-1 x"), ("sub/b.pdf", b"%PDF-1 x"), ("c.pdf", b"junk"), ("d.pdf", b"%PDF-2"), ("e.txt", b"%PDF")):
        p = tmp_path / "in" / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(c)
    found = files.collect(spark, f"file://{tmp_path}/in")
    assert found.count() == 2 and files.not_ingested(found, found.limit(1)).count() == 1
    df = spark.createDataFrame([(1, 'a,"b"'), (2, "c\nd")], "document_id int, v string")
    files.export(df, str(tmp_path / "csv"))
    assert {r.v for r in spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "csv")).collect()} == {'a,"b"', "c\nd"}
    files.replace_documents(df, str(tmp_path / "t"))
    files.replace_documents(spark.createDataFrame([(2, "new")], "document_id int, v string"), str(tmp_path / "t"))
    assert {(r.document_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, 'a,"b"'), (2, "new")}


def test_refusals_arrays_snapshots_and_deleted_documents(spark, tmp_path):
    kinds = spark.createDataFrame([(b"", 0), (b"%PDFx", 5), (b"%PDF" + b"y" * 50, 54), (b"junk", 4)], "content binary, length long")
    assert [r.refused for r in files.refusals(kinds, 20).collect()] == ["empty", None, "too_large", "no_pdf"]
    assert files.page_subset(spark.range(5).selectExpr("id as page_number"), [1, 3]).count() == 2
    df = spark.createDataFrame([(1, "a"), (2, None), (3, 'q"')], "document_id int, v string")
    text = io.StringIO()
    assert files.json_array(df, text) == 3 and json.loads(text.getvalue()) == [{"document_id": 1, "v": "a"}, {"document_id": 2, "v": None}, {"document_id": 3, "v": 'q"'}]
    empty = io.StringIO()
    assert files.json_array(df.limit(0), empty) == 0 and json.loads(empty.getvalue()) == []
    assert files.snapshot({"facts": df, "none": df.limit(0)}, str(tmp_path / "s")) == {"facts": 3, "none": 0}
    back = files.restored(spark, str(tmp_path / "s"), {"facts": "document_id int, v string"})["facts"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files.replace_documents(df, str(tmp_path / "t"))
    files.replace_documents(df.where("document_id = 2"), str(tmp_path / "t"), [1, 2])
    assert {r.document_id for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {2, 3}
    rel = spark.createDataFrame([(1, 2, 1), (2, 3, 4), (3, 4, 3)], "id int, l_document_id int, r_document_id int")
    facts, rest = files.delete_documents(df, rel, spark.createDataFrame([(1,)], "document_id int"))
    assert {r.document_id for r in facts.collect()} == {2, 3} and {r.id for r in rest.collect()} == {2, 3}


def test_upsert_takes_pairs_in_either_order(spark):
    old = spark.createDataFrame([(1, 2, "old"), (5, 3, "old")], "l_id int, r_id int, t string")
    new = spark.createDataFrame([(2, 1, "new")], "l_id int, r_id int, t string")
    assert sorted(map(tuple, read.upsert(old, new, ["l_id", "r_id"]).collect())) == [(1, 2, "new"), (3, 5, "old")]


def test_stream_equals_batch(spark, tmp_path):
    facts = claims.facts(spark, "/root/testdata/sf0.001").where("measure_id < 40")
    facts.where("document_id < 10").write.parquet(str(tmp_path / "corpus/batch=start"))
    facts.where("document_id >= 10").coalesce(1).write.parquet(str(tmp_path / "new"))
    arriving = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "new"))
    incremental.reconcile_stream(arriving, str(tmp_path / "corpus"), str(tmp_path / "rel"), str(tmp_path / "cp")).awaitTermination()
    want = reconcile.classify(reconcile.measure_pairs(facts, F.col("document_id") >= 10)).transform(reconcile.informative).select("l_id", "r_id", "relation_type")
    got = spark.read.parquet(str(tmp_path / "rel/*")).select("l_id", "r_id", "relation_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    assert spark.read.parquet(str(tmp_path / "corpus/*")).count() == facts.count()


def test_vector_blocks(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one = sorted(map(tuple, read.vector_topk(rows).collect()))
    assert len(one) > 5 and sorted(map(tuple, read.vector_topk(rows, query_bytes=2_000).collect())) == one
    assert max(r[2] for r in one) <= 1.0 and read.vector_topk(rows.limit(0)).count() == 0


def test_nearest_is_the_same_at_every_registry_size(spark):
    reg = spark.createDataFrame([(1, [1.0, 0.0], "money"), (2, [0.0, 1.0], None), (3, [0.6, 0.8], "count"), (4, [1.0, 0.0], "count")], "id long, vector array<double>, unit_class string")
    near = spark.createDataFrame([("a", [1.0, 0.0], None), ("b", [0.0, 1.0], "money"), ("c", [1.0, 0.0], "count"), ("d", [1.0, 0.0], "share")], "surface string, vector array<double>, unit_class string")
    for most in (1 << 20, 100, 1):
        assert sorted((r.surface, r.measure_id) for r in registry.nearest(near, reg, block_bytes=most).collect()) == [("a", 1), ("b", 2), ("c", 4)]
