import hashlib
import random
import re
from collections import Counter
from itertools import accumulate

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm import pii as P
from claimloom.llm.boosting import Boosted, threshold

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def row(d, text):
    s = brute(text)
    n = Counter(k for k, _, _ in s)
    return (d, *[n[k] for k in PATTERNS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())


ODD = [
    None, "", "é😀 a.b@c.d.e, x@y @z.w a@b.c..d me@b-c.org", "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4980828778982124  0000000000000 4111111111111111 5", "+1 (555) 123-4567. +12 +1-2 +49.30.1234567) +123456789012345678 ++1 2345 67890",
    "﷐ +1 202 555 0101 ﷑a@b.co﷐", "1 " * 20000, "9" * 30000, "a@b.c " * 3000, "+" + "1(" * 5000 + "1", "x" * 50000 + "@", "1.1.1.1" * 2000, "user(at)host.com call 2025550101 password=87e9bf97e572d55e46",
]
ODD[6] = "﷐ +1 202 555 0101 ﷑a@b.co﷐"


def fuzz(n):
    random.seed(8)
    return ["".join(random.choice(["1", "4", "11", "255", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "\n"]) for _ in range(random.randint(0, 60))) for _ in range(n)]


def test_base_spans(spark):
    rows = list(enumerate(ODD + fuzz(1500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as _text", "3 as base_ip")
    got = P.report(docs.repartition(4)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(row(d, t) for d, t in rows)
    for r in got:
        assert {f"{k}:{a}:{b}" for k, a, b in brute(rows[r.doc_id][1])} <= set(r.spans.split(","))
    assert P.report(docs.limit(0)).count() == 0


def test_real_rows_and_native_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = P.report(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    got = df.collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert Counter(tuple(r)[:6] for r in got) == Counter(row(d, t) for d, t in text.items())
    plain = [r for r in got if not re.search("[0-9@]|pass|token|secret|api", text[r.doc_id], re.I)]
    assert plain and all(r.spans == "" for r in plain)


def test_learned_spans_add_near_misses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = P.fit(docs)
    assert set(models) == {"email", "ip", "card", "phone", "secret"}
    near = "write an e-mail to jane.roe (at) example.org soon"
    one = spark.createDataFrame([(1, near)], "doc_id long, text string")
    assert [(s.k, near[s.s : s.e]) for s in P.with_spans(one, models).select("spans").first()[0]] == [("email", "jane.roe (at) example.org")]
    kinds = Counter(s.k for r in P.with_spans(docs, models).select("spans").collect() for s in r.spans)
    base = Counter(k for r in docs.collect() for k, _, _ in brute(r.text))
    assert all(kinds[k] >= base[k] for k in base) and kinds["phone"] > base["phone"]
    text = "ont the password=22ff0562b04fb24acb que"
    df = spark.createDataFrame([(1, text, 3, "s")], "doc_id long, text string, n_chars long, _text string")
    spans = P.with_spans(df.drop("_text"), models).select("spans").first()[0]
    assert any(s.k == "secret" and text[s.s : s.e].endswith("cb") for s in spans)
    red = P.redact(df, models)
    assert red.columns == df.columns
    r = red.first()
    assert r.text == "ont the [SECRET] que" and r.n_chars == len(r.text)


def test_running_sums_and_maxima(spark):
    random.seed(4)
    rows = [[], [5], list(range(40)), [random.randint(0, 9) for _ in range(5000)]]
    df = spark.createDataFrame([(r,) for r in rows], "a array<int>").coalesce(1)
    got = df.select(P.scanned(F.col("a"), lambda a, b: a + b).alias("s"), P.scanned(F.col("a"), F.greatest).alias("m")).collect()
    assert [g.s for g in got] == [list(accumulate(r)) for r in rows] and [g.m for g in got] == [list(accumulate(r, max)) for r in rows]


def test_many_copies_do_not_fill_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    copy = docs.where(F.col("text").rlike("[0-9]")).orderBy(F.xxhash64("text")).limit(1)
    many = docs.unionByName(copy.crossJoin(spark.range(2500)).select("text"))
    assert P.sample(many).count() == P.sample(docs).count() > 50
    assert set(P.fit(many)) == {"email", "ip", "card", "phone", "secret"}


def test_redact_keeps_columns_of_any_name(spark):
    rows = [(1, "x@y.zz or 4111 1111 1111 1111", 7), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").selectExpr("*", "1 as spans", "2 as cand", "3 as _new", "4 as base_ip", "5 as c0", "6 as _merged")
    out = P.redact(docs, {})
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "[EMAIL] or [CARD]", 17, 1, 2, 3, 4, 5, 6), (2, None, None, 1, 2, 3, 4, 5, 6)]
    assert P.redact(docs.limit(0), {}).count() == 0


def test_redaction_merges_overlaps(spark):
    rows = [(1, "a +1 202 555 0101 b x@y.zz"), (2, None), (3, "clean"), (4, "4111 1111 1111 1111"), (5, "+4111 1111 1111 1111 z")]
    got = {r.doc_id: r.text for r in P.redact(spark.createDataFrame(rows, "doc_id long, text string"), {}).collect()}
    assert got == {1: "a [PHONE] b [EMAIL]", 2: None, 3: "clean", 4: "[CARD]", 5: "+[CARD] z"}


def test_boosting_as_column_and_threshold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted.fit(x, y)
    assert ((m.predict(x) > 0.5) == y).mean() > 0.9
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r[0] for r in df.select(m.column(lambda f: F.col("abc"[f]))).collect()]
    assert np.allclose(got, m.predict(x[:50]))
    assert threshold(np.array([0.9, 0.8, 0.8, 0.1]), np.array([1, 1, 0, 0]), 0.6) == 0.8
    assert threshold(np.array([0.9, 0.2]), np.array([0, 1]), 0.9) == 2.0


def test_trees_and_thresholds_come_from_every_document(spark):
    docs = spark.range(1000, 6000).selectExpr("concat('write mail to u', id, '@h.org or pay ', id) as text")
    docs = docs.unionByName(docs.limit(50))  # copies count once
    by = Counter()
    step, rows = P._collected(P.counted(docs), P.MOST_VECTORS)["email"]
    for r in rows:
        by[tuple(r.x)] += r.n
    assert step == 1 and len(by) > 2 and set(by.values()) == {5000}
    # a kind of too many distinct features is rounded, and still counts every document
    step, rows = P._collected(P.counted(docs), 4)["email"]
    by = Counter()
    for r in rows:
        by[tuple(r.x)] += r.n
    assert step > 1 and len(rows) <= 4 and sum(by.values()) >= 5000
    models = P.fit(docs, most=4)
    assert models["email"][0].step == step
    near = "write mail to u77 (at) h.org"
    assert P.with_spans(spark.createDataFrame([(1, near)], "doc_id long, text string"), models).select("spans").first()[0][0].k == "email"


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(2)
    x, n = rng.integers(0, 9, (60, 2)).astype(float), rng.integers(1, 6, 60)
    y = (x[:, 0] > 4).astype(float)
    a, b = Boosted.fit(x, y, weight=n.astype(float)), Boosted.fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    assert np.allclose(a.predict(x), b.predict(x))
    score = np.round(rng.random(60), 1)
    assert threshold(score, y, 0.5, n.astype(float)) == threshold(np.repeat(score, n), np.repeat(y, n), 0.5)
