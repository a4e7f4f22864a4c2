import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimloom.llm import fingerprints as P

ODD = [(900, None), (901, ""), (902, "  \n"), (903, "one"), (904, "a b c"), (905, "ü " * 9000), (906, "ab" * 30000), (None, "no id here at all"), (907, "tie"), (907, "other tie"), (908, " lead  and\ttrail and more of it ")]


def brute(rows, hashes):
    rows = [(d, t or "") for d, t in rows]

    def order(r):
        return (r[0] is None, -(r[0] or 0), hashes[r[1]])

    rows = sorted(rows, key=order)
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        m = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("range_rows,max_ranges", [(10, 65536), (1, 65536), (100000, 1)])
def test_next_document_and_edit(spark, range_rows, max_ranges, monkeypatch):
    real = [(r.doc_id * 7919, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = real * (4 if range_rows == 1 else 1) + ODD
    rows = [(d + i if d is not None and d > 5000 else d, t) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sketch", "2 as _r").repartition(3)
    monkeypatch.setattr(P.next_document, "__defaults__", (range_rows, max_ranges))
    hashes = {r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t")).collect()}
    got = P.report(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute(rows, hashes)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_sketch_is_the_hashes_below_the_threshold(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(50, "A b c d e f g h i j k l m n o p " * 3), (51, "a b c d e f g h i j k l m n o p " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_hashes = {r.doc_id: r.s for r in P.with_sketch(df.fillna(""), "text", "s", bits=0).collect()}
    for bits in (1, 3, 20):
        for r in P.with_sketch(df.fillna(""), "text", "s", bits=bits).collect():
            full = all_hashes[r.doc_id]
            assert r.s == ([h for h in full if h < 1 << (63 - bits)] or full[:1])
            words = [w for w in re.split("[ \t-\r]+", (r.text or "").lower()) if w]
            assert len(full) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else [])
    assert all_hashes[50] == all_hashes[51]


def test_containment_of_unequal_documents_and_merging(spark):
    part = " ".join(f"w{i}" for i in range(2000))
    whole = part + " " + " ".join(f"v{i}" for i in range(30000))
    df = spark.createDataFrame([(part, whole)], "a string, b string")
    df = P.with_sketch(P.with_sketch(df, "a", "sa"), "b", "sb").withColumn("u", P.merged("sa", "sb"))
    r = df.select(P.containment("sa", "sb").alias("x"), P.containment("sb", "sa").alias("y"), P.containment("sb", "u").alias("z")).first()
    assert r.x == 1.0 and abs(r.y - 2000 / 32000) < 0.02 and r.z == 1.0


def test_equal_texts_quality_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = P.report(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    by = {}
    for r in rows:
        assert by.setdefault(r.text, r.fingerprint) == r.fingerprint
    far = [r for r in rows if r.n_chars > 1500]
    assert sum(0.45 < r.near_edited < 0.9 for r in far) > 0.9 * len(far)
    assert sum(r.near_next < 0.2 for r in far) > 0.9 * len(far)
    assert P.report(docs.limit(0)).count() == 0


def test_short_texts_contained_in_a_long_one(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i, n in enumerate(range(6, 21)):  # a short text, followed in descending order by a long one that contains it
        rows += [(2 * i + 1, " ".join(words[100 * i : 100 * i + n])), (2 * i, " ".join(words))]
    got = {r.doc_id: r for r in P.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n in enumerate(range(6, 21)):
        assert got[2 * i + 1].near_next == 1.0
        if i:
            assert got[2 * i].near_next == pytest.approx((n - 1 - 4) / 2996)


def test_near_edited_is_the_exact_share(spark):
    texts = {d: " ".join(f"t{d}.{i}" for i in range(9 + d)) for d in range(12)}

    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    for r in P.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        t, cut = texts[r.doc_id], len(texts[r.doc_id]) // 3
        edited = t[: len(t) - cut] + texts[(r.doc_id - 1) % 12][:cut]
        assert r.near_edited == pytest.approx(len(sh(t) & sh(edited)) / len(sh(t)))
