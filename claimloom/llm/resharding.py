"""Resharding by minimum-cost flow.

A shard that must give rows gives its smallest ones, so what matters of its sizes is one cut: the size up to
which rows go. The cut is found exactly, by counting ever narrower ranges of sizes. It parts a shard's
rows into three blocks, below, at and above the cut. A flow network carries every row from
its block to a new shard: staying costs nothing, moving costs the block's mean row size, and the
new shards' capacities are gapless row counts, at most one apart; which of them take the odd row is
left to the flow. Successive shortest paths give the transfers that move the fewest bytes: the only block
that can be parted holds rows of one size.

Only counts (at most shards x BINS rows) reach the driver. A row's place follows
from its block's segments and its rank in the block; ranks are counted in hash buckets, whose number grows with the
rows, so no block is ranked by a single task. rewrite() writes again only the shards that lose or gain rows.

Defined cases: a null text counts no bytes (size 1), its crc is that of the empty text; a null or unknown old
shard is placed in shard 0 first; repeated rows and ids are rows of their own; an empty table gives
no rows; further columns stay with their rows, whatever their names but for shard, slot and moved.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import plain, scratch_path, staged

#: Ranges of sizes that a round of the search for a cut counts.
BINS = 1024
#: Hash buckets that share the ranking of a block's rows, at least, and rows that one should hold.
BUCKETS, BUCKET_ROWS = 128, 50_000
BELOW, AT, ABOVE = 0, 1, 2


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.n, self.to, self.cap, self.cost, self.out = nodes, [], [], [], [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, cap: int, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        high = [0.0] * self.n
        while True:
            dist, via, heap = [float("inf")] * self.n, [-1] * self.n, [(0.0, s)]
            dist[s] = 0.0
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a] + 1e-9:
                    continue
                for e in self.out[a]:
                    if self.cap[e] > 0:
                        new = d + max(0.0, self.cost[e] + high[a] - high[self.to[e]])
                        if new < dist[self.to[e]] - 1e-9:
                            dist[self.to[e]], via[self.to[e]] = new, e
                            heapq.heappush(heap, (new, self.to[e]))
            if dist[t] == float("inf"):
                return
            for i in range(self.n):
                if dist[i] < float("inf"):
                    high[i] += dist[i]
            push, at = float("inf"), t
            while at != s:
                push, at = min(push, self.cap[via[at]]), self.to[via[at] ^ 1]
            at = t
            while at != s:
                self.cap[via[at]] -= push
                self.cap[via[at] ^ 1] += push
                at = self.to[via[at] ^ 1]


def solve(blocks: Mapping[tuple[int, int], tuple[int, int]], shards: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """blocks: (old shard, class) → (rows, bytes). Rows of each block that move, and each new shard's row count."""
    keys = sorted(blocks)
    total = sum(n for n, _ in blocks.values())
    q, r = divmod(total, shards)
    src, pool, odd, sink, first = 0, 1, 2, 3, 4
    net = Flow(first + shards + len(keys))
    into = []
    for j in range(shards):
        net.arc(pool, first + j, total, 0.0)
        into.append((net.arc(first + j, sink, q, 0.0), net.arc(first + j, odd, 1, 0.0)))
    net.arc(odd, sink, r, 0.0)
    moves = {}
    for i, k in enumerate(keys):
        node, (n, size) = first + shards + i, blocks[k]
        net.arc(src, node, n, 0.0)
        if 0 <= k[0] < shards:
            net.arc(node, first + k[0], n, 0.0)
        moves[k] = net.arc(node, pool, n, size / max(n, 1))
    net.run(src, sink)
    return {k: net.cap[e ^ 1] for k, e in moves.items()}, [net.cap[a ^ 1] + net.cap[b ^ 1] for a, b in into]


def transfers(blocks: Mapping[tuple[int, int], tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments of ranks, (old shard, class, from rank, to rank, new shard, first slot), that cover every row."""
    moved, counts = solve(blocks, shards)
    slot, out = [0] * shards, []
    for k in sorted(blocks):
        stay = blocks[k][0] - moved[k]
        if stay:
            out.append((*k, moved[k], blocks[k][0], k[0], slot[k[0]]))
            slot[k[0]] += stay
    for k in sorted(blocks):
        at = 0
        for j in range(shards):
            take = min(moved[k] - at, counts[j] - slot[j])
            if take > 0:
                out.append((*k, at, at + take, j, slot[j]))
                slot[j] += take
                at += take
    return out


def cut_sizes(rows: DataFrame, wanted: Mapping[int, int]) -> dict[int, int]:
    """rows (_old, _size): for each old shard wanted, its size of that rank (from 0, ascending), exactly.

    Each round counts BINS ranges of every shard's sizes and keeps the range that holds the rank.
    """
    spark, open_ = rows.sparkSession, {}
    for r in rows.where(F.col("_old").isin(list(wanted))).groupBy("_old").agg(F.min("_size").alias("a"), F.max("_size").alias("b")).collect() if wanted else []:
        open_[r["_old"]] = (r["a"], r["b"] + 1, wanted[r["_old"]])
    found = {}
    while open_:
        ranges = [(o, a, b, -(-(b - a) // BINS)) for o, (a, b, _) in open_.items()]
        inside = rows.join(F.broadcast(spark.createDataFrame(ranges, "_old int, a long, b long, w long")), "_old").where("_size >= a and _size < b")
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in inside.groupBy("_old", F.floor((F.col("_size") - F.col("a")) / F.col("w")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["_old"], []).append((r["bin"], r["n"]))
        for o, a, b, w in ranges:
            rank = open_[o][2]
            for bin_, n in sorted(counts[o]):
                if rank < n:
                    break
                rank -= n
            lo = a + bin_ * w
            if w == 1:
                found[o] = lo
                del open_[o]
            else:
                open_[o] = (lo, min(b, lo + w), rank)
    return found


@dataclass
class Plan:
    """Segments of ranks of every block and where they go, with what places a row in its block."""

    segments: list[tuple[int, int, int, int, int, int]]
    cuts: list[tuple[int, int | None, int]]
    starts: DataFrame
    buckets: int

    def touched(self, shards: int) -> list[int]:
        """New shards that lose or gain rows."""
        moved = [(s[0], s[4]) for s in self.segments if s[0] != s[4]]
        return sorted({x for pair in moved for x in pair if x < shards})


def _blocked(rows: DataFrame, old_shard: str, size: str, cuts, key: Sequence[str], buckets: int) -> DataFrame:
    """rows with _old, _class and _bucket. cuts: (old shard, cut or null, class of all its rows where null)."""
    table = F.broadcast(rows.sparkSession.createDataFrame(cuts, "_old int, _cut long, _all int"))  # a row for each old shard
    placed = rows.withColumns({"_old": F.coalesce(F.col(old_shard).cast("int"), F.lit(0)), "_bucket": F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")}).join(table, "_old")
    by_size = F.when(F.col(size) < F.col("_cut"), BELOW).when(F.col(size) == F.col("_cut"), AT).otherwise(ABOVE)
    return placed.withColumn("_class", F.when(F.col("_cut").isNull(), F.col("_all")).otherwise(by_size)).drop("_cut", "_all")


def plan(rows: DataFrame, old_shard: str, size: str, key: Sequence[str], shards: int) -> Plan:
    """The transfers for rows; only (old shard, size, key) of them is read."""
    light = staged(rows.select(F.coalesce(F.col(old_shard).cast("int"), F.lit(0)).alias("_old"), F.col(size).alias("_size"), *key), "reshard-sizes")
    counts = {r["_old"]: r["n"] for r in light.groupBy("_old").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    few = total // shards
    cut = cut_sizes(light, {o: n - few - 1 for o, n in counts.items() if 0 <= o < shards and n > few})
    cuts = [(o, cut.get(o), ABOVE if 0 <= o < shards else BELOW) for o in counts]
    buckets = max(BUCKETS, total // BUCKET_ROWS)
    blocked = _blocked(light.withColumn("_shard", F.col("_old")).drop("_old"), "_shard", "_size", cuts, key, buckets) if cuts else light.withColumns({"_class": F.lit(0), "_bucket": F.lit(0)})
    parts = staged(blocked.groupBy("_old", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes")), "reshard-blocks")
    blocks = {(r["_old"], r["_class"]): (r["n"], r["b"]) for r in parts.groupBy("_old", "_class").agg(F.sum("_n").alias("n"), F.sum("_bytes").alias("b")).collect()}
    before = F.sum("_n").over(Window.partitionBy("_old", "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_old", "_class", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    return Plan(transfers(blocks, shards) if blocks else [], cuts, starts, buckets)


def place(rows: DataFrame, made: Plan, old_shard: str, size: str, key: Sequence[str]) -> DataFrame:
    """rows with shard, slot and moved by a plan; key: columns that order a block's equal-sized rows."""
    spark, kept = rows.sparkSession, rows.columns
    segments = spark.createDataFrame(made.segments, "_old int, _class int, _lo long, _hi long, shard int, _slot long")
    placed = _blocked(rows, old_shard, size, made.cuts, key, made.buckets) if made.cuts else rows.withColumns({"_old": F.lit(0), "_class": F.lit(0), "_bucket": F.lit(0)})
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_old", "_class", "_bucket").orderBy(*key)).cast("long"))
    ranked = ranked.join(made.starts, ["_old", "_class", "_bucket"]).withColumn("_at", F.col("_start") + F.col("_rank") - 1)
    # the plan has at most (blocks + shards) x 2 rows
    out = ranked.join(F.broadcast(segments), ["_old", "_class"]).where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    return out.select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("_slot") + F.col("_at") - F.col("_lo")).alias("slot"), (F.col("shard") != F.col("_old")).alias("moved"))


def reshard(rows: DataFrame, old_shard: str, size: str, key: Sequence[str], shards: int) -> DataFrame:
    """rows with shard, slot and moved."""
    return place(rows, plan(rows, old_shard, size, key, shards), old_shard, size, key)


def rewrite(placed: DataFrame, touched: Sequence[int], path: str) -> None:
    """Writes below path, as shard=<k>, every shard that loses or gains rows (touched); the others' files stay as they are.

    Tasks write what they hold of each shard, so nothing is shuffled once more.
    """
    placed.where(F.col("shard").isin(list(touched))).write.mode("overwrite").partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = 8, old_shards: int = 6) -> DataFrame:
    """The documents, sharded by source until now (uneven: one source is hot), dealt to eight shards of equal row counts.

    Shards that change are written to the shared folder, texts included, and their rows are read from there.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = plain(docs, "doc_id", "text", "source").select("doc_id", "text", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(old_shards)).cast("int").alias("old_shard"))
    key = ["doc_id", "text_crc32"]
    made = plan(rows, "old_shard", "size", key, shards)
    placed, touched, path = place(rows, made, "old_shard", "size", key), made.touched(shards), scratch_path(spark, "reshard-files")
    rewrite(placed, touched, path)
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved"]
    written = spark.read.schema(placed.schema).parquet(path) if touched else placed.limit(0)
    same = [k for k in range(shards) if k not in touched]
    out = written.select(*columns)
    return out.unionByName(placed.where(F.col("shard").isin(same)).select(*columns)) if same else out
