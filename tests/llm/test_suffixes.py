import hashlib
import random
from collections import Counter

import numpy as np

from claimloom.llm import suffixes as S


def brute(rows):
    rows = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    least = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(key(d), least.get(w, float("inf")))
    out = []
    for d, b in rows:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < key(d):
                mask[i : i + 50] = True
        runs = sum(1 for i in range(len(b)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((d, len(b), int(mask.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    return Counter(out)


def made():
    random.seed(9)
    s = lambda n: "".join(random.choice("abcdé \x00\n") for _ in range(n))
    shared, line = s(120), s(60)
    rows = [(1, None), (2, ""), (3, "short"), (4, "ab" * 3000), (5, "ab" * 2000), (6, "a" * 49), (7, "a" * 50), (8, "a" * 51), (0, "a" * 50), (20000, "x" + "ab" * 40)]
    rows += [(10 + i, s(random.randint(0, 90)) + shared[random.randint(0, 20) : random.randint(60, 120)] + s(random.randint(0, 90))) for i in range(40)]
    rows += [(100 + i, s(30) + line + s(30)) for i in range(60)]
    rows += [(200, shared), (200, shared), (None, shared), (None, s(70)), (-5, line), (201, s(20000)), (202, line + line)]
    return rows


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as kind").repartition(6)
    assert Counter(map(tuple, S.report(docs, buckets=5, block_bytes=4000).collect())) == brute(rows)
    assert S.report(docs.limit(0), buckets=2).count() == 0


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert Counter(map(tuple, S.report(docs).collect())) == want and sum(r[2] for r in want) > 0


def test_transform_and_merge_equal_a_plain_sort():
    random.seed(1)
    for _ in range(40):
        shards = [[bytes(random.choice(b"ab\x00c") for _ in range(random.randint(1, 40))) for _ in range(random.randint(1, 6))] for _ in range(random.randint(1, 4))]
        ts = [S.Transform(np.frombuffer(b"".join(x), np.uint8), np.array([len(s) for s in x])) for x in shards]
        for t, x in zip(ts, shards):
            suffixes = sorted((([c + 1 for c in s[i:]] + [0], k) for k, s in enumerate(x) for i in range(len(s) + 1)), key=lambda p: (p[0], p[1]))
            assert t.string.tolist() == [k for _, k in suffixes]
        for depth in (1, 3, 60):
            now, group = S.merge(ts, depth)
            heads = []
            for t, x in zip(ts, shards):
                text = [([c + 1 for c in s[i:]] + [0])[:depth] for s in x for i in range(len(s) + 1)]
                inverse = np.argsort(t.rank)
                heads += [text[i] for i in inverse]
            got = [heads[p] for p in now.tolist()]
            assert got == sorted(got)
            for a, b, g, h in zip(got, got[1:], group.tolist(), group.tolist()[1:]):
                assert (g == h) == (a == b and 0 not in a)


def test_kept_bytes_and_shards_of_any_size(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r.doc_id, hashlib.sha256(bytes(r.bytes)).hexdigest()) for r in S.deduplicated(docs).collect())
    assert left == Counter({(d, h): n for (d, _, _, _, h), n in brute(rows).items()})
    assert S.deduplicated(docs.limit(0)).count() == 0
    random.seed(2)
    strings = [bytes(random.choice(b"ab") for _ in range(random.randint(50, 90))) for _ in range(300)]
    strings += [s[3:60] + b"x" for s in strings[:100] if len(s) > 60]
    body, lengths = np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)))
    owners = np.array([random.randrange(50) for _ in strings])
    least = {}
    for s, d in zip(strings, owners.tolist()):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(d, least.get(s[i : i + 50], d))
    want = [least[s[i : i + 50]] for s in strings for i in range(len(s) - 49)]
    for size in (64, 1000, 1 << 20):
        assert S.least_documents(body, lengths, owners, size).tolist() == want
    assert S.resolved(body, lengths, owners).tolist() == want


def test_spans_of_one_hash_stay_apart_if_their_bytes_differ(monkeypatch):
    monkeypatch.setattr(S, "_prefix", lambda b: (np.zeros(len(b) + 1, np.uint64), np.ones(len(b) + 1, np.uint64)))
    texts = [b"a" * 60, b"b" * 60, b"a" * 60, b"c" * 60]
    found = S.Listed([1, 2, 3, None], texts, lambda anchors: np.ones(len(anchors), bool), 1)
    taken = {found.buffer[a : a + n + 49].tobytes() for a, n in zip(found.entry_start.tolist(), found.entry_size.tolist())}
    assert taken == {b"a" * 60, b"b" * 60, b"c" * 60} and len(found.masks(np.zeros(int(found.entry_size.sum()), np.int64))) == 4


def test_blocks_learn_which_anchors_two_documents_have():
    random.seed(6)
    s = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n)).encode()
    shared, line = [s(90) for _ in range(40)], s(70)
    blocks = [[s(random.randint(0, 3000)) + random.choice(shared) + s(30) for _ in range(30)] for _ in range(5)]
    blocks += [[line * 9, b"", s(20)], [s(4000), shared[0], shared[0]]]  # the line repeats in one document alone
    owners = {}
    for b, texts in enumerate(blocks):
        _, _, anchor, doc = S.runs(texts)
        for a, d in zip(anchor.tolist(), doc.tolist()):
            owners.setdefault(a, set()).add((b, d))
    for bits, slices in ((48, 65536), (34, 7), (32, 1)):
        pieces = [p for b, texts in enumerate(blocks) for p in S._mark_pieces(b, texts, bits, slices)]
        pieces.sort(key=lambda p: p.column("bucket")[0].as_py())
        answers = {}
        for p in S._answer_marks(pieces):
            r = p.to_pylist()[0]
            answers.setdefault(r["block"], {})[r["bucket"]] = r["data"]
        for b, texts in enumerate(blocks):
            anchor = S.runs(texts)[2]
            assert S.Several(answers[b], bits, slices)(anchor).tolist() == [len(owners[a]) > 1 for a in anchor.tolist()]


def test_marks_grow_with_the_input_and_slices_stay_small():
    for size in (0, 1 << 20, 6 * 10**9, 30 * 10**9, 10**12, 10**14):
        bits, slices = S.marks_shape(size)
        assert 1 << bits >= 4 * min(size, 1 << 46) and max(S._bottom(k + 1, bits, slices) - S._bottom(k, bits, slices) for k in {0, slices // 2, slices - 1}) <= 1 << 32
        assert slices == S.K.MOST_BUCKETS or size <= (slices + 1) * S.SLICE_BYTES


def test_texts_are_stored_once_and_not_shuffled(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string").repartition(6)
    df = S.report(docs, block_bytes=4000)
    assert sum(r[1] for r in df.collect()) == sum(len((t or "").encode()) for _, t in made())
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    plan = plan.split("== Initial Plan ==")[0]
    scans = [i for i, line in enumerate(plan.split("\n")) if "data#" in line and "Bucketed: true" in line]
    above = [plan.split("\n")[i - 3 : i] for i in scans]
    assert len(scans) == 2 and not any("Exchange" in x for lines in above for x in lines)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("claimloom_")]
