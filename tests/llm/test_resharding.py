import itertools
import random
import zlib
from collections import Counter, defaultdict

from claimloom.llm import resharding as R


def least_bytes(sizes_by_shard, shards):
    """Fewest bytes moved, by trying every choice of the shards that take an odd row."""
    total = sum(map(len, sizes_by_shard.values()))
    q, r = divmod(total, shards)
    best = None
    for odd in itertools.combinations(range(shards), r):
        cost = 0
        for s, sizes in sizes_by_shard.items():
            cap = (q + (s in odd)) if s < shards else 0
            cost += sum(sorted(sizes)[: max(0, len(sizes) - cap)])
        best = cost if best is None else min(best, cost)
    return best


def test_flow_moves_the_fewest_bytes():
    random.seed(4)
    for _ in range(60):
        shards = random.randint(1, 5)
        olds = {s: [random.randint(1, 30) for _ in range(random.randint(0, 9))] for s in range(random.randint(1, 6))}
        blocks = {(s, z): (n, n * z) for s, v in olds.items() for z, n in Counter(v).items()}
        if not blocks:
            continue
        moved, counts = R.solve(blocks, shards)
        assert max(counts) - min(counts) <= 1 and sum(counts) == sum(map(len, olds.values()))
        assert sum(moved[k] * k[1] for k in blocks) == least_bytes(olds, shards)
        covered = defaultdict(list)
        for s, z, lo, hi, j, slot in R.transfers(blocks, shards):
            covered[j] += range(slot, slot + hi - lo)
        assert all(sorted(v) == list(range(len(v))) for v in covered.values())


def check(rows, docs, shards=8):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    n = [len(slots[j]) for j in range(shards)]
    assert max(n) - min(n) <= 1


def test_cases(spark):
    docs = [(i, "x" * (i % 50), f"s{i % 3}") for i in range(200)] + [(1, None, None), (1, None, None), (None, "", "s1"), (7, "y" * 200000, "s0"), (7, "é", "s0")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as shard", "2 as slot", "'z' as size")
    check(R.report(df).collect(), docs)
    assert R.report(df.limit(0)).count() == 0
    check(R.report(df.limit(3)).collect(), [tuple(r)[:2] for r in df.limit(3).collect()])


def test_real_rows_move_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = R.report(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    sizes = defaultdict(list)
    for r in rows:
        sizes[r.old_shard].append(r.size)
    moved = sum(r.size for r in rows if r.moved)
    assert moved == least_bytes(sizes, 8)


def test_rewrite_leaves_untouched_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, 10) for i in range(20)] + [(100 + i, 2, 10) for i in range(16)] + [(200 + i, 3, 10) for i in range(4)] + [(300 + i, 4, 10) for i in range(10)], "id long, old int, size long")
    made = R.plan(rows, "old", "size", ["id"], 5)
    placed = R.place(rows, made, "old", "size", ["id"])
    assert made.touched(5) == [2, 3]
    R.rewrite(placed, made.touched(5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.shard, r["count"]) for r in back.groupBy("shard").count().collect()} == {(2, 10), (3, 10)}


def test_cuts_are_exact_and_the_fewest_bytes_move(spark):
    rng = random.Random(6)
    for shards, n in ((3, 200), (5, 60), (2, 7)):
        data = [(i, rng.randrange(5), rng.choice([rng.randint(1, 50), rng.randint(1, 3_000_000_000)])) for i in range(n)] + [(n + i, 0, 40) for i in range(n // 2)]
        rows = spark.createDataFrame(data, "id long, old int, size long").repartition(3)
        light = rows.selectExpr("old as _old", "size as _size")
        ranks = {o: rng.randrange(len([1 for r in data if r[1] == o])) for o in {r[1] for r in data}}
        assert R.cut_sizes(light, ranks) == {o: sorted(r[2] for r in data if r[1] == o)[k] for o, k in ranks.items()}
        placed = R.reshard(rows, "old", "size", ["id"], shards).collect()
        sizes = defaultdict(list)
        for r in data:
            sizes[r[1]].append(r[2])
        assert sum(r.size for r in placed if r.moved) == least_bytes(sizes, shards) and len(placed) == len(data)
