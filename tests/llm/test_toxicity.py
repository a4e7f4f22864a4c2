import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm import toxicity as X


def test_held_out_accuracy_and_whole_table(spark):
    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = X.report(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    z, y = map(np.array, zip(*held))
    order = np.argsort(np.argsort(z, kind="stable"))
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.97
    assert (z[y == 1] >= 0.3).mean() > 0.85 and (z[y == 0] >= 0.3).mean() < 0.02


def small(spark):
    toxic = [(i, f"Fine words here number{i}. You idiot{'s' * (i % 2)} fool. More of it!", 1) for i in range(0, 80, 2)]
    clean = [(i, f"Fine words here number{i}. You nice person. More of it!", 0) for i in range(1, 121, 2)]
    rows = toxic + clean
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(0, 0), (None, 1), (3, None), (999999, 1)], "doc_id long, toxic int")
    return docs, labels


def test_sentences_located_and_odd_rows(spark):
    docs, labels = small(spark)
    model = X.fit(docs, labels.selectExpr("*", "'x' as text"))
    bad = X.offending(docs, model).collect()
    assert {r.doc_id for r in bad} == set(range(0, 80, 2)) and all("idiot" in r.sentence for r in bad)
    odd = [(1, None), (2, ""), (3, " .!\n"), (4, "idiot fool " * 30000), (5, "fine. " * 20000), (None, "you idiot fool"), (6, "You idiot fool"), (6, "You idiot fool")]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as _x", "2.0D as score", "3 as c0")
    got = [(r.doc_id, r._score) for r in X.score(df, model).collect()]
    assert [s for d, s in got if d in (1, 2, 3)] == [0, 0, 0]
    assert all(s > 0.5 for d, s in got if d in (None, 6, 4)) and len(got) == len(odd)
    df = df.selectExpr("*", "7 as _score", "8 as _offending")
    kept = X.clean(df, model)
    rows = kept.collect()
    assert kept.columns == df.columns and {r.doc_id for r in rows} == {1, 2, 3, 5} and {(r._score, r._offending) for r in rows} == {(7, 8)}
    assert X.clean(df.limit(0), model).count() == 0
    assert X.report(docs.limit(0), labels).count() == 0


def test_no_labels_scores_zero_and_fold_is_kept_out(spark):
    docs, labels = small(spark)
    assert {r.score for r in X.report(docs, labels.limit(0)).collect()} == {0.0}
    flipped = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, X.report(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_score_equals_the_formula(spark):
    """Brute force: the noisy-or of the sentences, word by word from the model's weights."""
    docs, labels = small(spark)
    model = X.fit(docs, labels)
    rows = [*((r.doc_id, r.text) for r in docs.collect()), (900, "Idiot. idiot! IDIOT?\nfool of a fool"), (901, "nothing known here")]
    got = {r.doc_id: r._score for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, text in rows:
        none = 1.0
        for s in {frozenset(re.findall(r"\w+", x.lower())) for x in re.split(r"[.!?\n]", text)}:
            if s:
                z = model.bias + sum(model.weights.get(w, 0) + sum(model.weights.get(w[:k] + "*", 0) for k in (4, 5, 6) if len(w) > k) for w in s)
                none *= 1 - 1 / (1 + math.exp(-z))
        assert abs(got[d] - (1 - none)) < 1e-9


def test_bytes_of_the_sample_are_bounded(spark):
    docs, labels = small(spark)
    some = X.fit(docs, labels, most_bytes=3_000)
    assert some.weights and some.weights != X.fit(docs, labels).weights
    assert not X.fit(docs, labels, most_bytes=10).weights
