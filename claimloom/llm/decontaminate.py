"""Benchmark decontamination by suffix arrays over the training shards.

Every task holds a shard of the training text (an Arrow batch of whole documents) as a sequence of
word codes and sorts the shard's suffixes into an array. Each suffix of each benchmark item is then
binary-searched in that array: the interval that shares its first WINDOW words gives all verbatim
occurrences with their locations, and the match is extended to its longest run. The array is
sparse: a suffix whose first words start no benchmark suffix cannot share WINDOW words with one, so
it is left out before the sort. Word codes are ranks in the benchmark's vocabulary, so the order of
codes is the order of words, and equal codes are equal words: nothing is decided by hashes.

Documents never move: the plan is one narrow pass without any shuffle. The benchmark is what is
sent to the tasks; its size is checked, and above BLOCK_BYTES it is processed in blocks, with a
stored pass over the documents for each block.

Defined cases: null or word-free text has no words and no hits; null or word-free items have no
window; an item shorter than WINDOW is one window; equal item ids count once; a null item id is
written as the empty string; repeated documents are judged each on its own; other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import extended, map_arrow, plain, shielded, staged, texts_of

WINDOW = 13
#: Most benchmark text (bytes) that one pass sends to the tasks.
BLOCK_BYTES = 16 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_HASH_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, runs of letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


def _mix(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


class BenchmarkSuffixes:
    """The benchmark's suffixes, cut to windows, with the words and first grams they start with."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        texts = [(item, words_of(text)) for item, text in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.base = len(self.vocabulary) + 2
        self.sequences = [(item, np.array([self.vocabulary[w] for w in ws], np.int32)) for item, ws in texts]
        spots: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, (_, codes) in enumerate(self.sequences):
            n = len(codes)
            for j in range(max(n - window, 0) + 1 if n else 0):
                spots.setdefault(tuple(codes[j : j + window].tolist()), []).append((i, j))
        self.windows = sorted(spots)
        self.spots = [spots[w] for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.low = self._packed([w + (-2,) * (window - len(w)) for w in self.windows])
        self.high = self._packed([w + (2**31 - 3,) * (window - len(w)) for w in self.windows])
        self.grams = []  # by gram length: sorted keys and their hash bitmap
        for k in (1, 2, 3):
            keys = np.unique(np.array([self._key(w[:k]) for w in self.windows if (len(w) == k if k < 3 else len(w) >= k)], np.int64))
            bits = np.zeros(1 << _HASH_BITS, bool)
            bits[_mix(keys)] = True
            self.grams.append((keys, bits))

    def _key(self, gram) -> int:
        """A gram's key. It may wrap around with a huge vocabulary: keys only say which suffixes needn't be sorted."""
        key = 0
        for c in gram:
            key = (key * self.base + int(c) + 1) % 2**64
        return key - 2**64 if key >= 2**63 else key

    def _packed(self, rows) -> np.ndarray:
        """Rows of codes as byte strings in the same order (-2 stands below every code)."""
        out = (np.array(rows, np.int64).reshape(-1, self.window) + 2).astype(">u4")
        return np.ascontiguousarray(out).view(f"V{4 * self.window}").ravel()

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Positions whose first words start a benchmark window."""
        n, found = len(codes), []
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in (1, 2, 3):
            m = n - k + 1
            if m <= 0:
                break
            known = known[:m] & (codes[k - 1 :] >= 0)
            key = key[:m] * self.base + codes[k - 1 :] + 1
            keys, bits = self.grams[k - 1]
            if len(keys):
                at = np.flatnonzero(known)
                at = at[bits[_mix(key[at])]]
                slot = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
                found.append(at[keys[slot] == key[at]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, window number) where the shard's suffix array shares a whole window.

        codes: the shard's word codes, -1 for other words, -2 closing each document.
        """
        at = self.starts(codes)
        if not len(at) or not len(self.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tail = np.concatenate([codes, np.full(self.window, -2, np.int32)])
        grid = tail[at[:, None] + np.arange(self.window)].astype(np.int64)
        order = np.lexsort(grid.T[::-1])  # the suffix array of the shard, to WINDOW words
        at, grid = at[order], grid[order]
        array = self._searchable(grid)
        lo = np.searchsorted(array, self._searchable_packed(self.low), "left")
        hi = np.searchsorted(array, self._searchable_packed(self.high), "right")
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return at[np.repeat(lo, count) + inside], which

    def _searchable(self, grid: np.ndarray) -> np.ndarray:
        return self._searchable_packed(np.ascontiguousarray((grid + 2).astype(">u4")).view(f"V{4 * self.window}").ravel())

    def _searchable_packed(self, rows: np.ndarray) -> np.ndarray:
        # one trailing byte keeps NumPy from stripping zero bytes off the end of a string
        wide = np.concatenate([rows.view(np.uint8).reshape(len(rows), 4 * self.window), np.ones((len(rows), 1), np.uint8)], axis=1)
        return np.ascontiguousarray(wide).view(f"S{4 * self.window + 1}").ravel()

    def longest(self, codes: np.ndarray, at: int, item: int, start: int) -> int:
        """Words that the item's suffix and the shard's suffix have in common."""
        own = self.sequences[item][1][start:]
        theirs = codes[at : at + len(own)]
        differ = np.flatnonzero(own[: len(theirs)] != theirs)
        return int(differ[0]) if len(differ) else len(theirs)


def _index_blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """Benchmark suffixes in blocks of bounded size, each no larger than one pass may send."""
    rows, held = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).toLocalIterator():
        text = (r["t"] or "").encode()
        if rows and held + len(text) > block_bytes:
            yield BenchmarkSuffixes(rows, window)
            rows, held = [], 0
        rows.append((r["i"], text))
        held += len(text)
    yield BenchmarkSuffixes(rows, window)


_EXTRA = [("_n_words", T.LongType()), ("_spans", T.ArrayType(T.IntegerType())), ("_items", T.ArrayType(T.StringType())), ("_longest", T.IntegerType()), ("_at", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("position", T.IntegerType()), T.StructField("length", T.IntegerType())])))]


def _shard(shared, carry: bool, locations: bool):
    """One shard: hit spans (start, end by turns), items and longest matches of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index: BenchmarkSuffixes = shared.value
        get, codes, begin, at = index.vocabulary.get, [], [], 0
        for text in texts_of(batch, "text"):
            ws = words_of(text)
            begin.append(at)
            one = np.fromiter((get(w, -1) for w in ws), np.int32, len(ws))
            codes += [one, np.array([-2], np.int32)]
            at += len(ws) + 1
        begin.append(at)
        codes, begin = np.concatenate(codes), np.array(begin, np.int64)
        position, which = index.search(codes)
        owner = np.searchsorted(begin, position, "right") - 1
        order = np.lexsort((position, owner))
        position, which, owner = position[order], which[order], owner[order]
        cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        spans, items, longest, places = [], [], [], []
        for d in range(batch.num_rows):
            s, own, best, found = [], set(), 0, []
            for k in range(cut[d], cut[d + 1]):
                p, w = int(position[k]), int(which[k])
                lo, hi = p - int(begin[d]), p - int(begin[d]) + int(index.lengths[w])
                if s and lo <= s[-1]:
                    s[-1] = max(s[-1], hi)
                else:
                    s += [lo, hi]
                for item, start in index.spots[w]:
                    own.add(index.sequences[item][0])
                    n = index.longest(codes, p, item, start)
                    best = max(best, n)
                    if locations:
                        found.append({"item_id": index.sequences[item][0], "start": start, "position": lo, "length": n})
            if carry:
                s = _union(s, batch.column("_spans")[d].as_py())
                own |= set(batch.column("_items")[d].as_py())
                best = max(best, batch.column("_longest")[d].as_py())
                found += batch.column("_at")[d].as_py()
            spans.append(s)
            items.append(sorted(own))
            longest.append(best)
            places.append(found)
        extra = [pa.array(np.diff(begin) - 1, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(places, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("position", pa.int32()), ("length", pa.int32())])))]
        names = [n for n in batch.schema.names if not carry or n not in dict(_EXTRA)]
        return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + extra, names=names + [n for n, _ in _EXTRA])

    return run


def _union(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, locations: bool = False) -> DataFrame:
    """docs with _n_words, _spans (hit word ranges), _items, _longest and, if asked, _at (match locations)."""
    spark, carry = docs.sparkSession, False
    for index in _index_blocks(benchmark, window, block_bytes):
        source = staged(docs, "decontaminate") if carry else docs
        schema = source.schema if carry else extended(docs, _EXTRA)
        docs, carry = map_arrow(source, _shard(spark.sparkContext.broadcast(index), carry, locations), schema), True
    return docs


def judged(matched: DataFrame) -> DataFrame:
    """Adds n_hit and the verdict: some hit, and a twentieth of the words or more."""
    # spans alternate start and end: the sum with alternating signs is the number of words inside
    n_hit = F.aggregate(F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return matched.withColumn("_n_hit", n_hit).withColumn("_contaminated", (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0) -> DataFrame:
    """docs without those that have a hit, if hits cover `least_share` of their words or more; columns unchanged."""
    held, restored = shielded(docs, "text")
    return restored(judged(match(held, benchmark)).where((F.col("_n_hit") == 0) | (F.col("_n_hit") < least_share * F.col("_n_words"))))


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Longest verbatim match of each benchmark suffix that shares a window, with one location."""
    found = match(plain(docs, "doc_id", "text"), benchmark, locations=True).select("doc_id", F.explode("_at").alias("m"))
    best = F.max_by(F.struct("doc_id", "m.position"), F.struct("m.length", -F.col("doc_id"), -F.col("m.position")))
    return found.groupBy("m.item_id", "m.start").agg(F.max("m.length").alias("length"), best.alias("b")).select("item_id", "start", "length", "b.doc_id", "b.position")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with the digest columns of the operator's result."""
    found = judged(match(plain(docs, "doc_id", "text"), benchmark))
    ids = F.array_join("_items", ",")
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), F.col("_contaminated").alias("contaminated"), F.col("_longest").alias("longest_match"))
