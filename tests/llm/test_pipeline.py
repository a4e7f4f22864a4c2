import random
import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from claimloom.llm import bpe, decontaminate, simhash, toxicity

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split(" ")
    w = [x for y in w for x in re.split("[\t-\r]", y) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
            if same:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        best[k] = min(best.get(k, (True, 0)), (d is None, d or 0))
    return sorted((d for no, d in best.values() if not no))


def test_near_dedup_keeps_one_of_each_group(spark):
    random.seed(12)
    w = [f"w{i}" for i in range(3000)]
    base = [random.choices(w, k=random.randint(60, 300)) for _ in range(25)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for j in range(i % 4):
            c = list(b)
            for _ in range(max(1, len(c) // 60)):
                c[random.randrange(len(c))] = random.choice(w)
            rows.append((100 + 10 * i + j, " ".join(c)))
    rows += [(500, None), (501, None), (502, ""), (503, ""), (504, "one two"), (505, "One two"), (506, rows[3][1]), (507, "  "), (508, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _t", "2 as root", "3 as _key")
    kept = simhash.near_deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert len({r for r in got if r < 100}) == 25
    assert got == brute_groups([(d, t if t is None else t) for d, t in rows])
    assert simhash.near_deduplicated(docs.limit(0)).count() == 0


def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, docs

    def through(k):
        stage = corpus_pipeline.STAGES[k][1](spark, held, SF)
        assert stage.columns == columns
        rows = stage.collect()
        return rows, spark.createDataFrame(rows, docs.schema)

    scored = toxicity.report(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0")
    rows, held = through(0)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in scored.collect()) and len(rows) < 200
    want = brute_groups([(r.doc_id, r.text) for r in rows])
    rows, held = through(1)
    assert sorted(r.doc_id for r in rows) == want
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(r.doc_id for r in decontaminate.report(held, bench).where("n_hit = 0").collect())
    rows, held = through(2)
    assert sorted(r.doc_id for r in rows) == want
    before = {r.doc_id: r.text for r in rows}
    rows, held = through(3)
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]", r.text) and r.n_chars == len(r.text)
        assert re.search("[0-9@]", before[r.doc_id]) or r.text == before[r.doc_id]
    t = Tokenizer.from_file(bpe.TOKENIZER)
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[4][1](spark, held, SF).collect()}
    assert got == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in rows}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == got  # the whole chain, through its tables


def test_run_chains_the_stages(spark, monkeypatch):
    steps = [(f"s{i}", lambda spark, docs, sf_dir, i=i: docs.where(F.col("doc_id") % (i + 2) != 0)) for i in range(4)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", steps + [("last", lambda spark, docs, sf_dir: docs.select("doc_id"))])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == [i for i in range(200) if all(i % k for k in (2, 3, 4, 5))]
