from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from claimloom.operators import read
from claimloom.plans import matching


def test_search_takes_the_letters_of_its_sql(spark):
    texts = ["the and tion", "Thé and tion the", "na tion and the", "naïtion, THE and", "thé and tion", "the-and_tion", "the and tions", "THE AND TİON", "theand tion", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert sorted(r.id for r in read.search_all(df, "text", "The, tion AND").collect()) == [0, 1, 2, 3, 5, 7]
    more = spark.createDataFrame([(0, "én tion"), (1, "en tion"), (2, "en tión"), (3, "x en_tion"), (4, "eń tion en")], "id int, text string")
    assert sorted(r.id for r in read.search_any_column(more, ["text"], "EN, tion").collect()) == [1, 3, 4]


def test_topk_holds_tiles_and_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(600, 4)), 1)
    v[300:330] = v[0]  # ties
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    f = v.astype(np.float32).astype(np.float64)
    unit = f / np.sqrt((f**2).sum(axis=1, keepdims=True))
    score = np.round(unit @ unit.T, 6)
    for queries, rows in ((1024, 2048), (5, 7), (3, 2)):
        monkeypatch.setattr(read, "TILE_QUERIES", queries)
        monkeypatch.setattr(read, "TILE_ROWS", rows)
        got = sorted((r.q_id, r["rank"], r.vec_id) for r in read.vector_topk(df, 20, 4).collect())
        want = [(q, n + 1, i) for q in range(0, 600, 20) for n, i in enumerate(sorted((j for j in range(600) if j != q), key=lambda j: (-score[q, j], j))[:4])]
        assert got == want


def test_neighbours_of_equal_texts(spark):
    words = ["red tea", "tea red", "green tea leaf", "leaf green", "red red leaf", "blue"]
    facts = spark.createDataFrame([(i, words[i * 7 % 6]) for i in range(200)], "id long, text string")
    got = read.lexical_neighbours(facts, 8)
    rows = got.collect()
    n = Counter(r.l_id for r in rows)
    assert len(n) == 200 and set(n.values()) == {8}
    for r in rows:
        if facts and words[r.l_id * 7 % 6] == "blue":
            assert words[r.r_id * 7 % 6] == "blue" and r.r_id != r.l_id
    blue = [i for i in range(200) if words[i * 7 % 6] == "blue"]
    assert sorted(r.r_id for r in rows if r.l_id == blue[-1]) == blue[:8] and sorted(r.r_id for r in rows if r.l_id == blue[0]) == blue[1:9]
    # texts are scored, not facts: no join makes more rows than pairs of distinct texts and words, whatever their copies
    assert "least" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "TASK_PAGES", 20)
    assert matching.page_renditions(spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() > 4
