"""SimHash near-duplicates by vantage-point trees over the fingerprints.

A bounded sample of the distinct fingerprints grows a vantage-point tree: a node holds a
fingerprint and a Hamming radius, points within the radius belong to its inner branch. By the
triangle inequality two fingerprints within `within` bits of each other differ by no more than
that in their distance from the vantage point, so a point up to `within` bits outside the radius
is also sent to the inner branch; every linked pair then meets in at least one leaf, and all other
branches are pruned. The leaves are the shards: each compares its own fingerprints exactly. A
shard emits a spanning forest (each member to its local root), never the pairs of a group; the
forests are joined by connected components.

Only distinct fingerprints enter the tree, so a group of exact copies is one point. The tree's
leaf count is bounded by the sample; a leaf's rows are 16 bytes each. A shard that has outgrown the
leaf size grows a tree of its own, so comparisons don't grow with the square of a shard.

Defined cases: null, empty and word-free text has fingerprint zero, linked like any other; text of
fewer words than a shingle is one shingle; repeated rows and equal ids are rows of their own; a
null doc_id is linked but never names a component.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import extended, map_arrow, plain, shielded, staged, texts_of
from claimloom.llm.components import connected_components

SHINGLE = 3
WITHIN = 2
SEED = 42
#: Distinct fingerprints sampled to place the vantage points (correctness doesn't depend on it).
SAMPLE = 20_000
#: Fingerprints that a shard should hold.
LEAF = 3_000


def shingles(text: bytes, k: int) -> list[bytes]:
    """k-word shingles, repeats included; fewer words: the whole sequence; none: nothing."""
    words = text.lower().split()  # of bytes: A-Z only, and splits at \\x20 and \\x09-\\x0D only
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    join = b" ".join
    return [join(t) for t in zip(*(words[i:] for i in range(k)))]


def hashes(text: bytes, k: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles(text, k)), np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit is 1 if set in over half the hashes."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, k: int = SHINGLE, column: str = "_fp") -> DataFrame:
    """docs and a signed long with the fingerprint's 64 bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(hashes(t, k)) for t in texts_of(batch, "text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, column])

    return map_arrow(docs, run, extended(docs, [(column, T.LongType())]))


@dataclass
class Node:
    point: int = 0
    radius: int = -1
    inner: "Node | None" = None
    outer: "Node | None" = None
    leaf: int = -1


class VantageTree:
    def __init__(self, sample: np.ndarray, scale: float, within: int, leaf_size: int = LEAF, seed: int = 7):
        """sample: distinct fingerprints; scale: how many fingerprints each stands for."""
        self.within, self.leaves, self.rng = within, 0, random.Random(seed)
        self.root = self._grow(np.unique(sample), max(scale, 1e-9), leaf_size)

    def _grow(self, points: np.ndarray, scale: float, leaf_size: int) -> Node:
        n = len(points)
        if n * scale > leaf_size and n >= 16:
            best = None
            for p in self.rng.sample(range(n), min(n, 5)):
                count = np.bincount(np.bitwise_count(points ^ points[p]), minlength=66).cumsum()
                inner = count[np.minimum(np.arange(65) + self.within, 65)].astype(float)
                outer = n - count[:65].astype(float)
                cost = np.where(outer > 0, inner**2 + outer**2, np.inf)
                r = int(np.argmin(cost))
                if best is None or cost[r] < best[0]:
                    best = (cost[r], points[p], r)
            if best[0] < 0.9 * n * n:  # else no branch can be pruned here
                d = np.bitwise_count(points ^ best[1])
                return Node(int(best[1]), best[2], self._grow(points[d <= best[2] + self.within], scale, leaf_size), self._grow(points[d > best[2]], scale, leaf_size))
        self.leaves += 1
        return Node(leaf=self.leaves - 1)

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, leaf) for every leaf that the point belongs to or borders."""
        out, todo = [], [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node.leaf >= 0:
                out.append((at, np.full(len(at), node.leaf)))
                continue
            d = np.bitwise_count(points[at] ^ np.uint64(node.point))
            todo += [(node.inner, at[d <= node.radius + self.within]), (node.outer, at[d > node.radius])]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def forest(points: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (root, member) of the links between distinct fingerprints, by exact comparison."""
    n = len(points)
    near = np.zeros(n, bool)
    step = max(1, (1 << 20) // max(n, 1))
    for i in range(0, n, step):  # who has a partner at all
        close = np.bitwise_count(points[i : i + step, None] ^ points[None, i:]) <= within
        close[np.arange(len(close)), np.arange(len(close))] = False
        near[i : i + len(close)] |= close.any(axis=1)
        near[i:] |= close.any(axis=0)
    left, roots, members = points[near], [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:64], front[64:]
            hit = (np.bitwise_count(some[:, None] ^ left[None, :]) <= within).any(axis=0)
            if hit.any():
                new, left = left[hit], left[~hit]
                roots.append(np.full(len(new), root))
                members.append(new)
                front = np.concatenate([front, new])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *roots]), np.concatenate([none, *members])


def leaf_forest(points: np.ndarray, within: int, leaf_size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """forest() of a shard of any size: one that outgrew leaf_size gets a vantage-point tree of its own, over its own points.

    Branches that border a vantage point's radius are searched on both sides again, so no pair is lost, and equal
    pairs found twice are no harm to a spanning forest's components.
    """
    if len(points) <= 2 * leaf_size:
        return forest(points, within)
    tree = VantageTree(points, 1.0, within, leaf_size)
    if tree.leaves < 2:
        return forest(points, within)
    at, leaf = tree.route(points)
    order = np.argsort(leaf, kind="stable")
    found = [forest(points[own], within) for own in np.split(at[order], np.flatnonzero(np.diff(leaf[order])) + 1)]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links(fps: DataFrame, within: int = WITHIN, leaf_size: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """fps (fp: distinct, not null) → spanning edges (a, b) of all pairs within so many bits."""
    spark = fps.sparkSession
    n = fps.count()
    share = min(1.0, sample / max(n, 1))
    # drawn by the fingerprint's own hash: the same sample on every run; limit only bounds the draw's spread
    drawn = fps.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).limit(2 * sample).collect()
    tree = VantageTree(np.array([r["fp"] for r in drawn], np.int64).view(np.uint64), n / max(len(drawn), 1), within, leaf_size)
    held = spark.sparkContext.broadcast(tree)

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        at, leaf = held.value.route(fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(fp[at])], names=["leaf", "fp"])

    def compare(shard: pa.Table) -> pa.Table:
        points = np.unique(shard.column("fp").to_numpy().view(np.uint64))
        root, member = leaf_forest(points, within, leaf_size)
        return pa.table({"a": pa.array(root.view(np.int64)), "b": pa.array(member.view(np.int64))})

    shards = map_arrow(fps, route, "leaf int, fp long")
    return shards.repartition(max(1, min(tree.leaves, 2000)), "leaf").groupBy("leaf").applyInArrow(compare, "a long, b long")


def clustered(docs: DataFrame, k: int = SHINGLE, within: int = WITHIN) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the least doc_id reachable."""
    rows = staged(with_fingerprint(plain(docs, "doc_id", "text"), k).select("doc_id", F.col("_fp").alias("fp")), "simhash")
    reps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-reps")
    roots = connected_components(links(reps.select("fp"), within)).select(F.col("v").alias("fp"), "root")
    named = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp")


def report(docs: DataFrame) -> DataFrame:
    return clustered(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates of a stated Jaccard similarity, for pipelines. At 0.8 two full fingerprints differ
# in ten bits or more of 64, a radius at which no branch of a vantage-point tree can be pruned. So
# candidates come by two routes. Texts whose full fingerprints are linked by the vantage-point tree, as
# above, are a candidate group. And SimHashes of small samples of the shingles are equal (radius zero) with
# probability similarity**PER_SAMPLE each: a pair of 0.8 shares one of SAMPLES with 0.99999. All are
# verified on whole shingle sets. Stars first: every text is compared once, with the most central
# partner it has (the one that shares samples with most texts, as an original does with its copies).
# Then, in groups which that leaves in several pieces, every text outside the largest piece is
# compared with all members, so no pair of a group that isn't connected is left out.

NEAR_SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, PER_SAMPLE = 20, 3
#: Members and bytes of shingle hashes that one comparison task's block of a candidate group should hold.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Groups up to this size are compared once, however many samples bring the same members together.
SAME_MEMBERS = 64
#: Most bits of the filter that picks the texts to be read again (2 MB); past some 2 million of them more pass.
MOST_FILTER_BITS = 24

_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, SAMPLES * PER_SAMPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sampled(h: np.ndarray) -> np.ndarray:
    """SimHash of each of SAMPLES samples of PER_SAMPLE shingles (bit set if over half of three have it)."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.empty(len(_MULTIPLIERS), np.uint64)
    for i, m in enumerate(_MULTIPLIERS):
        v = h * m
        least[i] = (v ^ (v >> np.uint64(31))).min()
    a, b, c = least.reshape(SAMPLES, PER_SAMPLE).T
    return (a & b) | (b & c) | (a & c)


def cross_links(v: np.ndarray, label: np.ndarray, probe: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that join every probe to all similar members of other labels.

    A pair isn't compared if its two are known to be connected (same label, or linked here before). Sets aren't empty.
    """
    order = np.argsort(~probe, kind="stable")  # probes first: two of them are compared once
    v, sets, label = v[order], [sets[i] for i in order], np.unique(label[order], return_inverse=True)[1]
    n = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate(sets)
    words = np.unique(flat)
    at, has, out = np.searchsorted(words, flat).astype(np.int32), np.zeros(len(words), bool), []
    for i in range(min(int(probe.sum()), len(v) - 1)):
        lo = i + 1
        open_ = (label[lo:] != label[i]) & (np.minimum(n[lo:], n[i]) >= similarity * np.maximum(n[lo:], n[i]))
        if not open_.any():
            continue
        own = at[starts[i] : starts[i + 1]]
        has[own] = True
        both = np.add.reduceat(has[at[starts[lo] :]], starts[lo:-1] - starts[lo], dtype=np.int64)
        has[own] = False
        hit = lo + np.flatnonzero(open_ & (both >= similarity * (n[i] + n[lo:] - both)))
        found, one = np.unique(label[hit], return_index=True)
        out += [(int(v[i]), int(v[j])) for j in hit[one]]
        label[np.isin(label, found)] = label[i]
    return out


def _compare(similarity: float):
    """applyInArrow over a cell's (v, label, probe, set) → links."""

    def run(cell: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        probe = cell.column("probe").to_numpy()
        if cell.num_rows > 1 and probe.any():
            sets = [np.frombuffer(x, np.uint64) for x in cell.column("set").to_pylist()]
            found = cross_links(cell.column("v").to_numpy(), cell.column("label").to_numpy(), probe, sets, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _stars(members: DataFrame) -> DataFrame:
    """members (g, fp, v, n: size of the group) → (v, root): the most central text that shares a group with v."""
    central = members.groupBy("v").agg(F.sum("n").alias("score"))
    scored = members.select("g", "fp", "v").join(central, "v").withColumn("rank", F.struct("score", F.xxhash64("v"), "v"))
    best = scored.groupBy("g", "fp").agg(F.max("rank").alias("best"))
    return scored.select("g", "fp", "v").join(best, ["g", "fp"]).groupBy("v").agg(F.max("best").alias("b")).select("v", F.col("b.v").alias("root")).where("v <> root")


def _star_links(stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified (a, b) of stars: a root's members come in cells of bounded size, each with a copy of the root's set."""
    sized = sets.select("v", F.octet_length("set").alias("bytes"))
    pairs = stars.join(sized, "v").join(sized.select(F.col("v").alias("root"), F.col("bytes").alias("root_bytes")), "root")
    pairs = staged(pairs.where(F.least("bytes", "root_bytes") >= similarity * F.greatest("bytes", "root_bytes")).select("v", "root", "bytes"), "near-stars")
    parts = F.greatest(F.floor((F.count(F.lit(1)) - 1) / BLOCK), F.floor((F.sum("bytes") - 1) / BLOCK_BYTES)) + 1
    roots = pairs.groupBy("root").agg(parts.alias("parts"))
    cell = F.pmod(F.xxhash64("root", "v"), "parts").alias("cell")
    rows = pairs.join(roots, "root").select("root", cell, "v", F.lit(False).alias("probe"))
    heads = roots.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("cell"), F.col("root").alias("v"), F.lit(True).alias("probe"))
    cells = rows.unionByName(heads).join(sets.select("v", "set"), "v").withColumn("label", F.col("v"))
    return cells.groupBy("root", "cell").applyInArrow(_compare(similarity), "a long, b long")


def _remaining_links(members: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of one candidate group (g, fp) that roots (v, root) leaves in several pieces.

    Members of the group's largest piece are only compared with, all others are compared with every member. Large
    groups are cut into blocks of both, which meet in cells of bounded size.
    """
    known = sets.select("v", F.octet_length("set").alias("bytes")).join(roots, "v", "left").select("v", "bytes", F.coalesce("root", "v").alias("label"))
    labelled = staged(members.select("g", "fp", "v").join(known, "v"), "near-labelled")
    pieces = labelled.groupBy("g", "fp", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("size"))
    groups = pieces.groupBy("g", "fp").agg(F.sum("m").alias("n"), F.sum("size").alias("size"), F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("g", "fp", "n", "size", F.col("main.label").alias("main"), F.col("main.m").alias("m"))
    blocks = (F.greatest(F.floor((F.col("n") - 1) / BLOCK), F.floor((F.col("size") - 1) / BLOCK_BYTES)) + 1).alias("blocks")
    probes = F.floor((F.col("n") - F.col("m") - 1) / BLOCK) + 1
    # a group of one block is one cell; of more, probes are cut as well and every two blocks meet
    groups = groups.select("g", "fp", "n", "main", blocks, probes.alias("probes")).withColumn("probes", F.when(F.col("blocks") == 1, F.lit(1).cast("long")).otherwise(F.col("probes")))
    todo = staged(labelled.select("g", "fp", "v", "label").join(groups, ["g", "fp"]).withColumn("probe", F.col("label") != F.col("main")).drop("main"), "near-remaining")

    small = todo.where((F.col("n") <= SAME_MEMBERS) & (F.col("blocks") == 1)).groupBy("g", "fp").agg(F.sort_array(F.collect_list(F.struct("v", "label", "probe"))).alias("all"))
    once = small.groupBy(F.md5(F.to_json("all").cast("binary")).alias("cell")).agg(F.first("all").alias("all")).select("cell", F.explode("all").alias("x")).select("cell", "x.v", "x.label", "x.probe")
    rest = todo.where((F.col("n") > SAME_MEMBERS) | (F.col("blocks") > 1))
    own, every = (lambda c: F.pmod(F.xxhash64("g", "v"), F.col(c))), (lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    at = ["g", "fp", "v", "label", "probe", "blocks"]
    as_probe = rest.where("probe").withColumn("i", own("probes")).withColumn("j", every("blocks")).select(*at, "i", "j")
    as_member = rest.withColumn("j", own("blocks")).withColumn("i", every("probes")).select(*at, "i", "j").where(~F.col("probe") | (F.col("blocks") > 1))
    large = as_probe.unionByName(as_member.withColumn("probe", F.col("probe") & (F.col("blocks") == 1)))
    large = large.groupBy(F.concat_ws(":", "g", "fp", "i", "j").alias("cell"), "v").agg(F.first("label").alias("label"), F.max("probe").alias("probe")).select("cell", "v", "label", "probe")
    return once.unionByName(large).join(sets.select("v", "set"), "v").groupBy("cell").applyInArrow(_compare(similarity), "a long, b long")


def _filter(wanted: DataFrame, key: str) -> np.ndarray:
    """Bits of the wanted keys (hashes), 8 cells a key up to MOST_FILTER_BITS; the driver gets no more than those bits."""
    bits = max(10, min(MOST_FILTER_BITS, (8 * max(1, wanted.count())).bit_length()))
    cell = F.shiftrightunsigned(F.col(key), 64 - bits)
    words = wanted.select(F.shiftright(cell, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _identity() -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(SEED), "text").alias("_h2")]


def _row_key() -> Column:
    """Hash of a row's text and id, by which the rows to be read again are picked."""
    return F.xxhash64("_h1", "_h2", F.col("doc_id").isNull(), "doc_id")


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """(v, _h1, _h2, doc_id: the least, fps, whole: fingerprint) of each distinct text; v is unique and no hash. Texts without words have no whole."""
    own = plain(docs, "doc_id", "text").select("doc_id", "text", *_identity())

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, whole = [], []
        for t in texts_of(batch, "text"):
            h = hashes(t, k)
            fps.append(sampled(np.unique(h)).view(np.int64))
            whole.append(int(np.uint64(fingerprint(h)).view(np.int64)) if len(h) else None)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_h1", "_h2")), pa.array(fps, pa.list_(pa.int64())), pa.array(whole, pa.int64())], names=["doc_id", "_h1", "_h2", "fps", "whole"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(own, sign, f"doc_id {kind}, _h1 long, _h2 long, fps array<long>, whole long")
    texts = rows.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("doc_id"), F.first("fps").alias("fps"), F.first("whole").alias("whole"))
    return staged(texts.withColumn("v", F.monotonically_increasing_id()), "near-signed")


def _linked_by_tree(signed: DataFrame, within: int = WITHIN) -> DataFrame:
    """(v, g, fp) of texts whose fingerprints the vantage-point tree links: g follows the samples' numbers, fp is the component."""
    own = signed.select("v", "whole").where("whole is not null")
    reps = staged(own.select(F.col("whole").alias("fp")).distinct(), "near-fingerprints")
    roots = connected_components(links(reps, within)).select(F.col("v").alias("whole"), "root")
    return own.join(roots, "whole", "left").select("v", F.lit(SAMPLES).alias("g"), F.coalesce("root", "whole").alias("fp"))


def similar_groups(docs: DataFrame, k: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(texts (v, _h1, _h2, doc_id), links (v, root) of those that are like another); texts without words are linked to none."""
    signed = _signed(docs, k)
    tree = staged(_linked_by_tree(signed), "near-tree")
    entries = signed.select("v", F.posexplode("fps").alias("g", "fp")).unionByName(tree)
    shared = entries.groupBy("g", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(entries.join(shared, ["g", "fp"]), "near-members")
    wanted = staged(members.select("v").distinct().join(signed.select("v", "_h1", "_h2", "doc_id"), "v").withColumn("key", _row_key()), "near-wanted")
    held = docs.sparkSession.sparkContext.broadcast(_filter(wanted, "key"))
    rows = plain(docs, "doc_id", "text").select("doc_id", "text", *_identity()).withColumn("key", _row_key())

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = held.value
        key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        pick = batch.filter(pa.array(bits[(key >> np.uint64(64 - int(len(bits)).bit_length() + 1)).astype(np.int64)] > 0))
        sets = [np.unique(hashes(t, k)).tobytes() for t in texts_of(pick, "text")]
        return pa.RecordBatch.from_arrays([*(pick.column(c) for c in ("_h1", "_h2")), pa.array(sets, pa.binary())], names=["_h1", "_h2", "set"])

    # few other rows pass the filter, and of repeated rows all: the join drops the former, dropDuplicates the latter
    passed = map_arrow(rows, whole, "_h1 long, _h2 long, set binary").join(wanted.select("v", "_h1", "_h2"), ["_h1", "_h2"])
    sets = staged(passed.select("v", "set").dropDuplicates(["v"]), "near-sets")
    roots = staged(connected_components(_star_links(_stars(members), sets, similarity)), "near-roots")
    more = _remaining_links(members, sets, roots, similarity)
    return signed.drop("fps", "whole"), connected_components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_deduplicated(docs: DataFrame, k: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document, the one of least doc_id, of each group of equal or similar texts; columns unchanged.

    Texts without a shingle are equal to each other only if they are the same string; null texts are one group.
    """
    texts, links_ = similar_groups(docs, k, similarity)
    named = texts.join(links_, "v", "left").withColumn("root", F.coalesce("root", "v"))
    # one row per group: the least id (null last), and of texts with that id the one of least hash
    stays = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_h1", "_h2")).alias("m"))
    mine = ["_d", "_no", "_h1", "_h2"]
    stays = staged(stays.select(F.coalesce("m.doc_id", F.lit(0)).alias("_d"), F.col("m.no").alias("_no"), "m._h1", "m._h2"), "near-stays")
    held, restored = shielded(docs, "doc_id", "text")
    keyed = held.withColumns({"_d": F.coalesce("doc_id", F.lit(0)), "_no": F.col("doc_id").isNull()}).select("*", *_identity())
    return restored(keyed.join(stays, mine, "left_semi").dropDuplicates(mine))
