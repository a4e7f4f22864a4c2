import hashlib
import re

import numpy as np
import pytest

from claimloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items):
    fold = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        for j in range(max(len(w) - 13, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, own = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    own |= windows[k]
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "tiny Item"), (3, None), (4, " .. "), (5, "solo-überword"), (2, "tiny item"), (None, "null id item here"), (7, "one two three four five six seven eight nine ten eleven twelve thirteen")]
DOCS = [
    (1, "xx one TWO three four five six seven eight nine ten, eleven twelve thirteen fourteen yy"),
    (2, None), (3, ""), (4, "a tiny item and a tiny, ITEM"), (5, "solo überword"), (6, "w " * 5000 + "tiny item"),
    (7, "one two three four five six seven eight nine ten eleven twelve"), (7, "null id item here"), (8, "?!"), (9, "tiny"), (None, "tiny item"), (11, "two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
]


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 20])
def test_against_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.judged(D.match(docs, bench, block_bytes=block))
    import pyspark.sql.functions as F

    rows = found.select("doc_id", "_n_words", "_n_hit", F.size("_items"), F.sha2(F.array_join("_items", ","), 256), "_contaminated").collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute(DOCS, ITEMS)


def test_real_rows(spark):
    base = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    rows = [tuple(r)[:6] for r in D.report(docs, bench).collect()]
    assert sorted(rows, key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[2] for r in rows)
    assert D.decontaminate(docs, bench, 0.05).count() == sum(not r[5] for r in rows)


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'keep' as _n_hit", "1 as _spans", "2 as _items", "3 as _n_words", "4 as _contaminated", "5 as c0", "6 as `x.y`")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.decontaminate(docs, bench)
    rows = kept.collect()
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in rows} == {("keep", 1, 2, 3, 4, 5, 6)}
    assert sorted(r.doc_id for r in rows) == [2, 3, 7, 8, 9]
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def test_huge_vocabulary_wraps_keys_only(spark):
    index = D.BenchmarkSuffixes([("1", b" ".join(b"w%d" % i for i in range(20)))])
    index.base = 2**40 + 1
    index.grams = []
    for k in (1, 2, 3):
        keys = np.unique(np.array([index._key(w[:k]) for w in index.windows if (len(w) == k if k < 3 else len(w) >= k)], np.int64))
        bits = np.zeros(1 << D._HASH_BITS, bool)
        bits[D._mix(keys)] = True
        index.grams.append((keys, bits))
    codes = np.append(index.sequences[0][1], np.int32(-2))
    assert len(index.search(codes)[0]) == 8


def test_longest_match_and_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as _x", "'k' as item_id")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    best = {(r.item_id, r.start): (r.length, r.doc_id, r.position) for r in D.longest_matches(docs, bench).collect()}
    assert best["1", 0] == (14, 1, 1)
    assert D.report(docs.limit(0), bench).count() == 0
    assert D.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0
