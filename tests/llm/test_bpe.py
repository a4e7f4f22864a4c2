import hashlib
import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from claimloom.llm import bpe as B

ODD = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "a  b"), (6, "a   b \n c\n\n d\t e "), (7, "it's we'll <|endoftext|> x<|endoftext|>y  <|endoftext|>"), (8, "z " * 40000), (9, "é" * 30000),
    (10, "   x \u0085 y\x1c z 　"), (11, "1 22 333,4 !?. ..."), (11, "dup id"), (11, "dup id"), (None, "null id"), (12, " lead"), (13, "😀👍 mañana ÆØ"), (14, "\n a"), (15, "a​ b\x00 c"),
]


def fuzz(n):
    random.seed(2)
    return [(100 + i, "".join(random.choice([" ", " ", "  ", "\n", "\t", "a", "B1", "'s", ".", "é", " ", "\x1d", "日本", "<|endoftext|>", "-"]) for _ in range(random.randint(0, 25)))) for i in range(n)]


def brute(rows):
    t = Tokenizer.from_file(B.TOKENIZER)
    out = []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def test_against_library(spark):
    rows = ODD + fuzz(2500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as data").repartition(5)
    assert Counter(map(tuple, B.encoded(docs, block_bytes=50_000, buckets=7).collect())) == brute(rows)
    assert B.report(docs.limit(0)).count() == 0


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert Counter(map(tuple, B.report(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_ids_and_decoding_join(spark):
    docs = spark.createDataFrame(ODD[4:7] + ODD[:2], "doc_id long, text string")
    full = B.encoded(docs, output="ids")
    t = Tokenizer.from_file(B.TOKENIZER)
    for r in B.decode(full, out="again").collect():
        text = dict(ODD[:7])[r.doc_id] or ""
        assert r.ids == t.encode(text, add_special_tokens=False).ids and r.decoded == r.again == text


def test_a_foreign_answer_is_refused():
    words = [b"a", b"b"]
    good = B._answer(words, [[1], [2, 3]])
    assert B._read_answer(good, [b"a", b"c"]) is None and B._read_answer(good, [b"a"]) is None
    n, ids = B._read_answer(good, words)
    assert n.tolist() == [1, 2] and ids.tolist() == [1, 2, 3]
