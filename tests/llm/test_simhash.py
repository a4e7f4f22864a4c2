import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import simhash as S
from claimloom.llm.components import connected_components


def brute_fp(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    fps = [(d, brute_fp(t)) for d, t in docs]
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {c: min((fps[i][0] for i in range(len(fps)) if comp[i] == c and fps[i][0] is not None), default=None) for c in set(comp)}
    return Counter((d, f"{f:016x}", least[c]) for (d, f), c in zip(fps, comp))


def test_cases_and_real_rows(spark):
    odd = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (6, "a b"), (7, "x " * 30000), (None, "one"), (9, "a b c d e f"), (10, "É é A a"), (6, "other text of six words here")]
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(odd + real, "doc_id long, text string").selectExpr("*", "5 as fp", "6 as root")
    assert Counter(tuple(r) for r in S.report(docs).collect()) == brute(odd + real)
    assert S.report(docs.limit(0)).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    ball = base[0] ^ (np.uint64(1) << rng.integers(0, 8, 50, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, ball]))
    for within in (0, 2, 5):
        tree = S.VantageTree(points[::3], 3, within, leaf_size=100)
        assert tree.leaves > 8 or within > 4
        at, leaf = tree.route(points)
        homes = {}
        for i, k in zip(at.tolist(), leaf.tolist()):
            homes.setdefault(i, set()).add(k)
        d = np.bitwise_count(points[:, None] ^ points[None, :])
        for i, j in zip(*np.where((d <= within) & (np.arange(len(points))[:, None] < np.arange(len(points))))):
            assert homes[i] & homes[j]
        root, member = S.forest(points, within)
        assert len(member) == len(set(member.tolist()))
        linked = ((d <= within).sum(axis=1) > 1).sum()
        assert len(member) + len(set(root.tolist())) == linked


def test_outgrown_shard_gets_its_own_tree():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, near[:300] ^ (np.uint64(3) << rng.integers(0, 62, 300, dtype=np.uint64))]))
    place = {int(p): i for i, p in enumerate(points)}
    parts = []
    for size in (100, 10_000):
        a, b = S.leaf_forest(points, 2, size)
        parts.append(connected([(place[int(x)], place[int(y)]) for x, y in zip(a, b)], len(points)))
    assert parts[0] == parts[1] and len(set(parts[0])) < len(points) - 1500


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, None), (7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if b is not None and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((v, find(v)) for v in list(up))
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.v, r.root) for r in got) == want


def test_cross_links_join_what_brute_force_joins():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
    sets += [np.delete(s, 0) for s in sets if len(s) > 8]
    v, n = np.arange(len(sets)), len(sets)
    close = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    for probe in (np.ones(n, bool), v % 3 == 0, np.zeros(n, bool)):
        want = connected([(i, j) for i in range(n) for j in range(i) if close(sets[i], sets[j]) and (probe[i] or probe[j])], n)
        found = S.cross_links(v, v, probe, sets, 0.8)
        assert connected(found, n) == want and all(close(sets[i], sets[j]) for i, j in found)


def connected(edges, n):
    root = list(range(n))
    for i, j in edges:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_original_with_many_copies_that_are_unlike_each_other(spark):
    rng = random.Random(4)
    original = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(original))]
    for d in range(1, 2001):
        words = list(original)
        for i in rng.sample(range(5, 395), 6):
            words[i] = f"x{d}.{i}"
        rows.append((d, " ".join(words)))
    sets = [set(S.shingles(t.encode(), S.NEAR_SHINGLE)) for _, t in rows]
    share = lambda x, y: len(x & y) / len(x | y)
    assert min(share(sets[0], s) for s in sets) > 0.82
    assert sum(share(sets[i], sets[i + 1]) < 0.8 for i in range(1, 2000)) > 1900
    other = [(5000 + i, " ".join(f"y{i}.{j}" for j in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows + other, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in S.near_deduplicated(docs).select("doc_id").collect()) == [0] + [d for d, _ in other]


def components_by_brute_force(sets):
    """Least index of each set's component, every pair that has a shingle in common compared."""
    holders = {}
    for i, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, []).append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, own in enumerate(sets):
        both = Counter(j for x in own for j in holders[x] if j < i)
        for j, n in both.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_no_near_copy_is_missed(spark):
    """Recall and precision of 1 on real rows and on clusters of many edited copies, all sizes of groups and blocks."""
    rng = random.Random(8)
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for c in range(6):
        base = [f"c{c}.{i}" for i in range(rng.randint(80, 300))]
        for d in range(rng.choice([3, 40, 700])):
            words = list(base)
            for i in rng.sample(range(len(words)), rng.randint(0, len(words) // 40)):
                words[i] = f"e{c}.{d}.{i}"
            rows.append((100_000 + 1_000 * c + d, " ".join(words)))
    rows.sort()
    sets = [set(S.shingles(t.encode(), S.NEAR_SHINGLE)) for _, t in rows]
    root = components_by_brute_force(sets)
    want = sorted({rows[k][0] for k in root})
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as v", "2 as g", "3 as _h1", "4 as `a b`", "5 as _row")
    kept = S.near_deduplicated(docs.repartition(5))
    assert kept.columns == docs.columns
    same_words = {i for i, s in enumerate(sets) if not s}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id not in {rows[i][0] for i in same_words}) == [d for d in want if d not in {rows[i][0] for i in same_words}]


def test_near_dedup_takes_candidates_from_the_tree(spark, monkeypatch):
    """Without any samples in common, texts that the vantage-point tree links are still compared, and only similar ones go."""
    random.seed(12)
    words = [f"w{i}" for i in range(4000)]
    base = random.sample(words, 3000)
    edited = base[:1500] + ["other"] + base[1501:]  # ten shingles of some 3,000 differ
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(random.sample(words, 3000))), (4, "a b"), (5, ""), (6, " "), (7, "a  b")]
    differ = lambda a, b: (S.fingerprint(S.hashes(a.encode(), 5)) ^ S.fingerprint(S.hashes(b.encode(), 5))).bit_count()
    assert differ(rows[0][1], rows[1][1]) <= S.WITHIN < differ(rows[0][1], rows[2][1])
    signed = S._signed
    monkeypatch.setattr(S, "_signed", lambda docs, k: signed(docs, k).withColumn("fps", F.array().cast("array<bigint>")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.near_deduplicated(docs).collect()) == [1, 3, 4, 5, 6]
    # linked by the tree, unlike as sets: the whole comparison decides
    monkeypatch.setattr(S, "WITHIN", 64)
    linked = S._linked_by_tree(S._signed(docs, 5), 64)
    assert linked.select("fp").distinct().count() == 1 and linked.count() == 5
