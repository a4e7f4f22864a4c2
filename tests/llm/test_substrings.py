import hashlib
import random
from collections import Counter

import numpy as np

from claimloom.llm import sketching as K
from claimloom.llm import substrings as S


def brute(rows):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    count = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return Counter(out)


def made():
    random.seed(6)
    w = lambda n: [random.choice("abcdefgh") + str(random.randint(0, 30)) for _ in range(n)]
    shared, line = w(60), w(40)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, " ".join(w(34))), (5, "a " * 36), (6, "a " * 35), (7, "b c " * 4000), (8, "é ".join(w(50)))]
    rows += [(9 + i, " ".join(w(random.randint(0, 80)) + shared[: random.randint(34, 60)] + w(random.randint(0, 80)))) for i in range(40)]
    rows += [(100 + i, " ".join(w(20) + line + w(20))) for i in range(60)]
    rows += [(200, " ".join(shared)), (200, " ".join(shared)), (None, " ".join(w(100))), (201, "　".join(shared)), (202, " ".join(line + line)), (203, " ".join(w(30000)))]
    return rows


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as kind").repartition(6)
    assert Counter(map(tuple, S.report(docs, buckets=5, block_bytes=4000).collect())) == brute(rows)
    assert S.report(docs.limit(0), buckets=2).count() == 0


def test_real_rows_and_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert Counter(map(tuple, S.report(docs).collect())) == want and sum(r[2] for r in want) > 0
    kept = S.deduplicated(docs).collect()
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept} == {(d, s) for d, _, _, s in want}


def test_merged_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(4)]
    parts[1][:200], parts[2][:50], parts[3][:10] = parts[0][:200], parts[2][50:100], parts[3][10]
    pieces = sorted((p.to_pylist()[0] for part in parts for p in K.sketch_pieces(part, 21)), key=lambda r: r["bucket"])
    rows = [np.zeros(1 << 18, np.uint8) for _ in K.ROWS]
    import pyarrow as pa

    for b in K._merge([pa.RecordBatch.from_pylist(pieces, K.PIECES_ARROW)]):
        r = b.to_pylist()[0]
        row, s = r["bucket"] >> 16, r["bucket"] & 0xFFFF
        rows[row][s << 17 : (s + 1) << 17] = np.frombuffer(r["data"], np.uint8)
    seen = K.Repeated(21, rows)
    count = Counter(np.concatenate(parts).tolist())
    every = np.array(sorted(count), np.uint64)
    assert seen(every[[count[x] > 1 for x in every.tolist()]]).all()
    assert seen(every[[count[x] == 1 for x in every.tolist()]]).mean() < 0.02


def test_words_and_their_hashes():
    text = "a bb\ta\n\x0bé é\u00a0x  a bb " + "z" * 3000 + " a\x1cb"
    for step in (1, 7, 1 << 20):
        starts, one, two = S.word_hashes(np.frombuffer(text.encode(), np.uint8), step)
        words = text.encode().split()
        assert [text.encode()[s:].split()[0] for s in starts.tolist()] == words
        for h in (one, two):
            assert len(set(h.tolist())) == len(set(words)) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    assert S._joined([b"", b"x y", b" ", b"z"])[2].tolist() == [0, 0, 2, 2, 3]
