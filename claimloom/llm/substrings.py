"""Repeated word windows behind a count-min prefilter.

First pass: every partition sketches the anchors of its windows (see sketching), and the sketches
are merged; a window's anchor occurs as often as the window or oftener. Second pass: only windows that the merged
sketch estimates to be repeated are grouped, by 96 bits: two rolling hashes, each over hashes of words of its own,
so that no single word's hash decides. Each block lists its distinct window
hashes by bucket with "once" or "more", a bucket's task adds up the lists of all blocks and answers
each with a bit per entry, and blocks apply their answers to their documents. Listing distinct
windows per block is the pre-aggregation: a passage in a third of all documents is one entry a block.

Defined cases: null text has no words; texts of fewer than WINDOW words lose nothing; a window that
occurs twice in one document is repeated; repeated rows and ids are occurrences of their own; other
columns don't take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm import sketching as K
from claimloom.llm.common import plain

WINDOW = 35
GRAM = 16
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WORD_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def word_hashes(text: np.ndarray, step: int = K.GROUP_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each word of the bytes starts, and two independent 64-bit hashes of it), a stretch of whole words at a time."""
    space = np.concatenate([[True], (text == 32) | ((text >= 9) & (text <= 13)), [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    out = [np.empty(len(starts), np.uint64) for _ in _WORD_BASES]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + step, "right")))
        first = starts[lo]
        part = text[first : ends[hi - 1]] + np.uint64(1)
        for values, base in zip(out, _WORD_BASES):
            up, down = _factors(base, len(part))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up, dtype=np.uint64)])
            a, z = starts[lo:hi] - first, ends[lo:hi] - first
            values[lo:hi] = K.mix((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))
        lo = hi
    return starts, *out


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _factors(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, kept for the usual length."""
    if n > K.GROUP_BYTES:
        return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
    if base not in _kept:
        _kept[base] = _powers(base, K.GROUP_BYTES), _powers(pow(base, -1, 1 << 64), K.GROUP_BYTES)
    up, down = _kept[base]
    return up[:n], down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every n neighbours."""
    up, down = _powers(base, len(codes)), _powers(pow(base, -1, 1 << 64), max(0, len(codes) - n + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)])
    return K.mix((total[n:] - total[:-n]) * down) if len(codes) >= n else np.zeros(0, np.uint64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of the texts' words one after the other, and where each text begins (with the end)."""
    starts, one, two = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return one, two, np.searchsorted(starts, edges)


def _whole(begin: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of the places of n neighbours lie inside one document."""
    out = np.ones(max(0, length - n + 1), bool)
    for e in begin[1:-1]:
        out[max(0, e - n + 1) : e] = False
    return out


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = rolling(codes, GRAM, _BASES[0])
    return grams, K.slide(grams, WINDOW - GRAM + 1) if len(codes) >= WINDOW else np.zeros(0, np.uint64)


def anchors_of(texts: list[bytes]) -> np.ndarray:
    """Anchors of all windows, each document on its own."""
    out = [np.zeros(0, np.uint64)]
    codes, _, begin = _joined(texts)
    for a, z in zip(begin[:-1], begin[1:]):
        if z - a >= WINDOW:
            grams, anchors = _anchors(codes[a:z])
            out.append(K.selected(grams, anchors, WINDOW - GRAM + 1))
    return np.concatenate(out)


def _windows(texts: list[bytes], repeated: K.Repeated) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows estimated repeated: (document, first word, 64 bits, 32 bits)."""
    parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
    for lo, hi in K.groups(texts):
        codes, others, begin = _joined(texts[lo:hi])
        if len(codes) < WINDOW:
            continue
        _, anchors = _anchors(codes)
        at = np.flatnonzero(_whole(begin, WINDOW, len(codes)))
        at = at[repeated(anchors[at])]
        if len(at):
            a, b = rolling(codes, WINDOW, _BASES[0])[at], rolling(others, WINDOW, _BASES[1])[at]
            doc = np.searchsorted(begin, at, "right") - 1
            parts.append(((lo + doc).astype(np.int32), at - begin[doc], a, (b >> np.uint64(32)).astype(np.uint32)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _entries(a: np.ndarray, b: np.ndarray, buckets: int):
    """Distinct windows by bucket: (order, entry of each ordered window, first place of each entry, edges of buckets)."""
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((b, a, bucket))
    x, y = a[order], b[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(x) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    edges = np.searchsorted(bucket[order][first], np.arange(buckets + 1))
    return order, np.cumsum(new) - 1, first, edges


def _tally(batches):
    """Adds up each bucket's lists and answers them; rows come sorted by bucket."""

    def answers(bucket, held):
        a = np.concatenate([h[1] for h in held])
        b = np.concatenate([h[2] for h in held])
        more = np.concatenate([h[3] for h in held])
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        start = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        size = np.diff(np.append(start, len(x)))
        twice = (size > 1) | (np.add.reduceat(more[order].astype(np.int64), start) > 0)
        out = np.empty(len(x), bool)
        out[order] = np.repeat(twice, size)
        at = 0
        for block, own, _, _ in held:
            yield K.piece(K.ANSWER, block, bucket, np.packbits(out[at : at + len(own)]).tobytes())
            at += len(own)

    bucket, held = None, []
    for batch in batches:
        for block, k, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data"))):
            if k != bucket:
                if held:
                    yield from answers(bucket, held)
                bucket, held = k, []
            raw = K.swell(data)
            n = int.from_bytes(raw[:4], "little")
            held.append((block, np.frombuffer(raw, "<u8", n, 4), np.frombuffer(raw, "<u4", n, 4 + 8 * n), np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 12 * n))[:n]))
    if held:
        yield from answers(bucket, held)


def removed(docs: DataFrame, finish, schema: str, buckets: int | None = None, block_bytes: int = K.BLOCK_BYTES) -> DataFrame:
    """finish(doc_ids, texts, masks) → Arrow table, for each block; a mask says which words of a text go."""
    spark = docs.sparkSession
    own = plain(docs, "doc_id", "text")
    size = K.input_bytes(own)
    buckets, bits = buckets or K.bucket_count(size), K.width(size, 4)
    stored = K.stage_blocks(own, anchors_of, bits, "substrings", block_bytes)
    repeated = spark.sparkContext.broadcast(K.merged(stored, bits))
    blocks = stored.where(f"kind = {K.DOCS}")

    def lists(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                _, texts = K.opened(data)
                _, _, a, b = _windows(texts, repeated.value)
                order, entry, first, edges = _entries(a, b, buckets)
                more = np.diff(np.append(first, len(order))) > 1
                x, y = a[order][first], b[order][first]
                for k in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[k], edges[k + 1])
                    yield K.piece(K.ANSWER, block, int(k), K.squeeze(int(edges[k + 1] - edges[k]).to_bytes(4, "little") + x[s].tobytes() + y[s].tobytes() + np.packbits(more[s]).tobytes()))

    def apply(group: pa.Table) -> pa.Table:
        rows = dict(zip(group.column("bucket").to_pylist(), group.column("data").to_pylist()))
        ids, texts = K.opened(rows.pop(-1))
        doc, at, a, b = _windows(texts, repeated.value)
        order, entry, first, edges = _entries(a, b, buckets)
        twice = np.zeros(len(first), bool)
        for k, data in rows.items():
            n = edges[k + 1] - edges[k]
            twice[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(data, np.uint8))[:n]
        hit = order[twice[entry]] if len(order) else order
        hit = hit[np.lexsort((at[hit], doc[hit]))]
        cut = np.searchsorted(doc[hit], np.arange(len(texts) + 1))
        masks = []
        for d, text in enumerate(texts):
            change = np.zeros(len(text.split()) + 1, np.int64)
            own = at[hit[cut[d] : cut[d + 1]]]
            np.add.at(change, own, 1)
            np.add.at(change, own + WINDOW, -1)
            masks.append(np.cumsum(change[:-1]) > 0)
        return finish(ids, texts, masks)

    found = blocks.mapInArrow(lists, K.PIECES).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_tally, K.PIECES)
    return blocks.unionByName(found).repartition(K.block_tasks(size, block_bytes), "block").groupBy("block").applyInArrow(apply, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts without the words of repeated windows, kept words joined by one space."""

    def finish(ids, texts, masks):
        kept = [b" ".join([w for w, m in zip(t.split(), mask.tolist()) if not m]).decode() for t, mask in zip(texts, masks)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(kept, pa.string())})

    return removed(docs, finish, "doc_id long, text string")


def report(docs: DataFrame, **options) -> DataFrame:
    def finish(ids, texts, masks):
        shas = []
        for t, mask in zip(texts, masks):
            words = t.split()
            shas.append(hashlib.sha256(b" ".join([w for w, m in zip(words, mask.tolist()) if not m] if mask.any() else words)).hexdigest())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(m) for m in masks], pa.int64()), "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return removed(docs, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", **options)
