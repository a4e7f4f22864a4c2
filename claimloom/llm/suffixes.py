"""Substring dedup by merging Burrows-Wheeler transforms.

A window's anchor is the least hash of the short grams inside it. Every block sends the marks (leading
bits of a hash) of its anchors, as many bits as the input asks for, to the slices of their range, and gets
a bit back for each: whether two documents of the corpus have it. Nothing of this goes through the driver or is
held whole by a task, so it rules out as much of a large corpus as of a small one. Windows whose anchor only
one document has are dropped. What remains is cut into spans, runs of windows with one anchor, and spans go to the bucket
of their anchor, so equal windows of any two documents meet. A bucket drops windows whose hash no other
window has. The rest of its spans makes shards, each with a suffix order and a Burrows-Wheeler
transform of its own. The transforms are merged by iterative interleave refinement: beginning with the
shards one after the other, each round carries the interleave through the last-to-first mapping, a stable
distribution by the preceding symbol, after which it is right to one symbol more and group borders
tell where common prefixes end. After WINDOW rounds every group is an interval of suffixes with a common
prefix of WINDOW bytes; its least doc_id answers all of them. No suffix is sorted again across shards,
and no equality is decided by a hash.

Every block gets, for each window of its spans, the least document that has it, and removes the
bytes of windows that also start in a smaller document. Equal spans of a block are sent once, equal
strings of a bucket (compared byte by byte) are merged once.

Defined cases: null text is empty; texts under WINDOW bytes lose nothing; a null doc_id is larger
than any other; documents with one id aren't smaller than each other; repeats within one document
alone are kept; other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm import sketching as K
from claimloom.llm.common import plain, staged

WINDOW = 50
GRAM = 20
LAST = np.iinfo(np.int64).max
#: Text of a block: smaller than elsewhere, since a block's spans are held as strings.
BLOCK_BYTES = 12 << 20
#: Text of a shard in a bucket, at least (the last one excepted), and windows that one step takes up.
SHARD_BYTES, STEP = 128 << 10, 1 << 20
#: Input whose anchors' marks make a slice.
SLICE_BYTES = 32 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_codec = pa.Codec("zstd", 3)


def _squeezed(data: bytes) -> bytes:
    return K.squeeze(data, _codec)


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts) or b"", np.uint8), begin


def _grams(buffer: np.ndarray) -> np.ndarray:
    """Hash of every GRAM neighbouring bytes."""
    n = len(buffer) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer.tobytes(), strides=(1,))
    return K.mix(eight[:n] * _C[0] + eight[8 : n + 8] * _C[1] + eight[GRAM - 8 : n + GRAM - 8] * _C[2])


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, windows, anchor, text) of every run of neighbouring windows with one anchor, in the texts put together."""
    none, base = np.zeros(0, np.int64), 0
    parts = [(none, none, none.astype(np.uint64), none)]
    for lo, hi in K.groups(texts):
        buffer, begin = _buffer(texts[lo:hi])
        if len(buffer) >= WINDOW:
            anchors = K.slide(_grams(buffer), WINDOW - GRAM + 1)
            whole = np.ones(len(anchors), bool)  # whether the window lies in one document
            for e in begin[1:-1]:
                whole[max(0, e - WINDOW + 1) : e] = False
            at = np.flatnonzero(whole)
            own = anchors[at]
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]))) if len(at) else none
            # neighbouring windows of two documents are never neighbours here: the windows between aren't whole
            start = at[first]
            parts.append((base + start, np.diff(np.append(first, len(at))), own[first], lo + np.searchsorted(begin, start, "right") - 1))
        base += len(buffer)
    return tuple(map(np.concatenate, zip(*parts)))


def marks_shape(size: int) -> tuple[int, int]:
    """(bits of an anchor's mark, slices that marks are dealt to) for so many input bytes: some forty marks or more for every anchor."""
    return max(24, min(48, size.bit_length() + 2)), max(1, min(K.MOST_BUCKETS, size // SLICE_BYTES))


def _slice_edges(marks: np.ndarray, bits: int, slices: int) -> np.ndarray:
    """Where each slice of ascending marks begins."""
    return np.searchsorted((marks * np.uint64(slices)) >> np.uint64(bits), np.arange(slices + 1, dtype=np.uint64))


def _bottom(k: int, bits: int, slices: int) -> int:
    return -(-(k << bits) // slices)


def marked(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(marks of a block's anchors, ascending and distinct, whether two of its documents have one)."""
    _, _, anchor, doc = runs(texts)
    mark, place = K.cells(anchor, 0, bits), np.append(False, doc[1:] != doc[:-1]).cumsum()[: len(doc)]
    order = np.argsort(mark, kind="stable")  # documents stay in order
    mark, place = mark[order], place[order]
    mark = mark[np.append(True, (mark[1:] != mark[:-1]) | (place[1:] != place[:-1]))[: len(mark)]]
    own, count = np.unique(mark, return_counts=True)
    return own, count > 1


def _mark_pieces(block: int, texts: list[bytes], bits: int, slices: int):
    """A block's marks, slice by slice: gaps by byte planes, then a bit for each mark of two documents."""
    own, two = marked(texts, bits)
    edge = _slice_edges(own, bits, slices)
    for k in np.flatnonzero(np.diff(edge)).tolist():
        part = slice(edge[k], edge[k + 1])
        gaps = np.diff(own[part] - np.uint64(_bottom(k, bits, slices)), prepend=np.uint64(0)).astype("<u4")
        yield K.piece(K.SKETCH, block, k, _squeezed(len(gaps).to_bytes(4, "little") + gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(two[part]).tobytes()))


def _answer_marks(batches):
    """Answers each block's marks with a bit: whether two documents, of any blocks, have it. Rows come sorted by slice."""

    def answers(k, held):
        every = np.sort(np.concatenate([own for _, own, _ in held]))
        several = np.concatenate([every[1:][every[1:] == every[:-1]], *(own[two] for _, own, two in held)])
        several = np.append(np.unique(several), np.uint64(1 << 63))
        for block, own, _ in held:
            yield K.piece(K.SKETCH, block, k, np.packbits(several[np.searchsorted(several, own)] == own).tobytes())

    key, held = None, []
    for batch in batches:
        for block, k, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data"))):
            if k != key:
                if held:
                    yield from answers(key, held)
                key, held = k, []
            raw = K.swell(data)
            n = int.from_bytes(raw[:4], "little")
            gaps = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T.copy().view("<u4").ravel()
            held.append((block, np.cumsum(gaps, dtype=np.uint64), np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 4 * n))[:n].astype(bool)))
    if held:
        yield from answers(key, held)


class Several:
    """Which anchors of a block's runs two documents or more have, by the answers to its marks."""

    def __init__(self, answers: dict[int, bytes], bits: int, slices: int):
        self.answers, self.bits, self.slices = answers, bits, slices

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        own, at = np.unique(K.cells(anchors, 0, self.bits), return_inverse=True)
        n = np.diff(_slice_edges(own, self.bits, self.slices))
        bits = [np.unpackbits(np.frombuffer(self.answers[k], np.uint8))[: n[k]] for k in np.flatnonzero(n).tolist()]
        return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)[at]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd number and n + 1 of its inverse; those of the usual length are kept."""

    def made(n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, _C[0]), np.full(n + 1, np.uint64(pow(int(_C[0]), -1, 1 << 64)))
        up[:1], down[:1] = 1, 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)

    if n > K.GROUP_BYTES:
        return made(n)
    if not _powers:
        _powers.append(made(K.GROUP_BYTES))
    return _powers[0][0][:n], _powers[0][1][: n + 1]


def _prefix(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What hashes of substrings are made of: (sums, factors), the hash of a to z being (sums[z] - sums[a]) * factors[a]."""
    up, down = _factors(len(buffer))
    sums = np.empty(len(buffer) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buffer + np.uint64(1)) * up, dtype=np.uint64, out=sums[1:])
    return sums, down


class Distinct:
    """Which of the substrings of a buffer are equal: each one's entry, and each entry's first substring.

    Substrings are put in order of a key, hash and length; neighbours of one hash are compared byte by byte.
    """

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray, hashed: np.ndarray, key: np.ndarray):
        order = np.lexsort((length, hashed, key))
        k, h, n = key[order], hashed[order], length[order]
        new = np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1])) if len(k) else np.zeros(0, bool)
        repeats = np.flatnonzero(~new)
        heads = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[repeats]
        some, others = order[repeats], order[heads]
        for lo, hi in _steps(np.cumsum(length[some])):
            n = length[some[lo:hi]]
            equal = buffer[_ranges(start[some[lo:hi]], n)] == buffer[_ranges(start[others[lo:hi]], n)]
            new[repeats[lo:hi]] = ~np.logical_and.reduceat(equal, np.cumsum(n) - n)
        self.order, self.first = order, order[new]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self._starts = np.flatnonzero(new)

    def least(self, values: np.ndarray) -> np.ndarray:
        """Each entry's least value."""
        return np.minimum.reduceat(values[self.order], self._starts) if len(values) else values


class Listed:
    """The spans of a block: distinct ones as entries in the order of their buckets, and where each of them occurs."""

    def __init__(self, ids: list[int | None], texts: list[bytes], repeated: Callable[[np.ndarray], np.ndarray], buckets: int):
        """repeated: which of the anchors of all the block's runs may be those of windows of two documents."""
        self.buffer, self.edges = _buffer(texts)
        start, size, anchor, doc = runs(texts)
        held = repeated(anchor)
        self.start, self.size, self.doc = start[held], size[held], doc[held]
        bucket = (anchor[held] % np.uint64(buckets)).astype(np.int64)
        del start, size, anchor, doc
        hashed = np.empty(len(bucket), np.uint64)
        for lo, hi in K.groups(texts):
            own = slice(*np.searchsorted(self.start, self.edges[[lo, hi]]))
            sums, factors = _prefix(self.buffer[self.edges[lo] : self.edges[hi]])
            at = self.start[own] - self.edges[lo]
            hashed[own] = (sums[at + self.size[own] + WINDOW - 1] - sums[at]) * factors[at]
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        spans = Distinct(self.buffer, self.start, self.size + WINDOW - 1, hashed, bucket)
        self.entry, first = spans.entry, spans.first
        self.entry_start, self.entry_size, self.entry_doc = self.start[first], self.size[first], spans.least(self.ids[self.doc])
        self.cut = np.searchsorted(bucket[first], np.arange(buckets + 1))

    def packed(self, bucket: int) -> bytes:
        own = slice(self.cut[bucket], self.cut[bucket + 1])
        n = self.entry_size[own] + WINDOW - 1
        return len(n).to_bytes(4, "little") + n.astype("<u4").tobytes() + self.entry_doc[own].astype("<i8").tobytes() + self.buffer[_ranges(self.entry_start[own], n)].tobytes()

    def masks(self, gains: np.ndarray) -> list[np.ndarray]:
        """Which bytes of each text go. gains: of each entry's windows, how much less their least document is than the entry's."""
        least = np.repeat(self.entry_doc, self.entry_size)
        least -= gains
        del gains
        begin = np.cumsum(self.entry_size) - self.entry_size
        change = np.zeros(len(self.buffer) + 1, np.int32)
        for lo, hi in _steps(np.cumsum(self.size)):
            n = self.size[lo:hi]
            hit = least[_ranges(begin[self.entry[lo:hi]], n)] < np.repeat(self.ids[self.doc[lo:hi]], n)
            gone = _ranges(self.start[lo:hi], n)[hit]
            np.add.at(change, gone, 1)
            np.add.at(change, gone + WINDOW, -1)
        del least
        mask = np.cumsum(change, out=change)[:-1] > 0
        return [mask[a:z] for a, z in zip(self.edges[:-1], self.edges[1:])]


def _steps(ends: np.ndarray):
    """Ranges of items that hold about STEP each; ends: running total of what they hold."""
    lo = 0
    while lo < len(ends):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + STEP, "right")))
        yield lo, hi
        lo = hi


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, documents, bytes) of a bucket's strings of one block."""
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, "<u4", n, 4).astype(np.int64), np.frombuffer(data, "<i8", n, 4 + 4 * n), np.frombuffer(data, np.uint8, -1, 4 + 12 * n)


class Transform:
    """Suffix order, Burrows-Wheeler transform and last-to-first mapping of a shard of strings.

    Symbols are bytes + 1 (UTF-8 has no byte 255); 0 closes a string. Closing symbols are ordered by
    string, so the order of suffixes is strict.
    """

    def __init__(self, body: np.ndarray, lengths: np.ndarray):
        """body: the strings' bytes, one after the other."""
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(body) + len(lengths), np.uint8)
        text[_ranges(ends - lengths, lengths)] = body + np.uint8(1)
        string = np.repeat(np.arange(len(lengths)), lengths + 1)
        left = ends[string] - np.arange(len(text))  # symbols before the closing one
        # rank by eight symbols: what follows a closing symbol is blanked, and ties there go by string
        eight = np.ndarray((len(text),), ">u8", text.tobytes() + bytes(7), strides=(1,)).astype(np.uint64)
        keep = np.minimum(left, 8)
        eight &= np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 8)] + [(1 << 64) - 1], np.uint64)[keep]
        tie = np.where(left < 8, string + 1, 0)
        order = np.lexsort((tie, eight))
        new = np.append(True, (eight[order][1:] != eight[order][:-1]) | (tie[order][1:] != tie[order][:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(text)))
        rank = np.empty(len(text), np.int64)  # a group's first place
        rank[order] = np.repeat(start, size)
        open_ = order[np.repeat(size > 1, size)]
        done = 8
        while len(open_):  # only groups of several are sorted on, by the rank of what follows
            after = rank[np.minimum(open_ + done, len(text) - 1)] + 1
            key = rank[open_] * (len(text) + 1) + after
            by = np.argsort(key)
            open_, key = open_[by], key[by]
            held = rank[open_]
            group = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            run = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(run, len(key)))
            inside = run - group[np.searchsorted(group, run, "right") - 1]
            rank[open_] = np.repeat(held[run] + inside, size)
            open_ = open_[np.repeat(size > 1, size)]
            done *= 2
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        self.text_start = ends - lengths
        self.rank = rank
        before = np.roll(text, 1)
        before[self.text_start] = 0
        self.bwt = before[order]
        back = np.arange(len(text)) - 1
        back[self.text_start] = ends  # the symbol before a string's first closes that string
        self.last_to_first = rank[back[order]]
        self.string = string[order]
        self.strings = len(lengths)


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave: places in the shards' orders one after the other, group number of each) after depth symbols.

    Suffixes of a group share their first depth symbols; suffixes shorter than that are alone. A round takes two
    symbols at once, through the last-to-first mapping applied twice; an odd depth begins with a round of one.
    """
    offset = np.cumsum([0, *(len(s.bwt) for s in shards)])
    symbol = np.concatenate([s.bwt for s in shards])
    back = np.concatenate([s.last_to_first + o for s, o in zip(shards, offset)]).astype(np.int32)
    closing = np.concatenate([np.arange(s.strings) + o for s, o in zip(shards, offset)]).astype(np.int32)
    now, group = np.arange(len(symbol), dtype=np.int32), np.zeros(len(symbol), np.int32)
    m = len(closing)
    pair, twice = (symbol[back].astype(np.uint16) << 8) | symbol, back[back]
    last = back[closing][np.lexsort((back[closing], symbol[closing]))]  # suffixes of one symbol, in order
    for step in [1] * (depth % 2) + [2] * (depth // 2):
        key, to = (symbol, back) if step == 1 else (pair, twice)
        order = np.argsort(key[now], kind="stable")
        moved = now[order]
        lead, held = key[moved], group[order]
        now = to[moved]
        now[:m] = closing  # closing symbols stand first, in the order of the strings
        border = np.empty(len(now), bool)
        border[:1] = True
        border[1:] = (lead[1:] != lead[:-1]) | (held[1:] != held[:-1])
        border[: m + 1] = True
        if step == 2:
            ended = m + np.flatnonzero((lead[m:] & 255) == 0)
            now[ended] = last
            border[ended] = True
        group = np.cumsum(border, dtype=np.int32)
        if group[-1] == len(group):
            break
    return now, group


def least_documents(body: np.ndarray, lengths: np.ndarray, docs: np.ndarray, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For each window of the strings, one after the other, the least document that has it, by merging shards' transforms."""
    cut = [0, *(int(i) for i in np.flatnonzero(np.diff(np.cumsum(lengths) // shard_bytes)) + 1), len(lengths)]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    shards = [Transform(body[begin[a] : begin[z]], lengths[a:z]) for a, z in zip(cut, cut[1:]) if z > a]
    now, group = merge(shards, WINDOW)
    firsts = [a for a, z in zip(cut, cut[1:]) if z > a]
    doc = np.concatenate([docs[a + t.string] for a, t in zip(firsts, shards)])
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    found = np.empty(len(doc), np.int64)
    found[now] = np.repeat(np.minimum.reduceat(doc[now], start), np.diff(np.append(start, len(now))))
    out, o = [], 0
    for (a, z), t in zip([(a, z) for a, z in zip(cut, cut[1:]) if z > a], shards):
        out.append(found[o + t.rank[_ranges(t.text_start, lengths[a:z] - WINDOW + 1)]])
        o += len(t.bwt)
    return np.concatenate(out)


def resolved(body: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """least_documents() of all windows; those that share their hash with no other are their own document's."""
    n = lengths - WINDOW + 1
    at = _ranges(np.cumsum(lengths) - lengths, n)
    sums, factors = _prefix(body)
    hashed = (sums[at + WINDOW] - sums[at]) * factors[at]
    del sums, factors
    order = np.argsort(hashed)
    same = np.append(False, hashed[order][1:] == hashed[order][:-1])
    several = np.empty(len(at), bool)
    several[order] = same | np.append(same[1:], False)
    least = np.repeat(docs, n)
    own = np.flatnonzero(several)
    if len(own):
        string = np.repeat(np.arange(len(n)), n)[own]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1] + 1) | (string[1:] != string[:-1])))
        size = np.diff(np.append(first, len(own))) + WINDOW - 1
        least[own] = least_documents(body[_ranges(at[own[first]], size)], size, docs[string[first]])
    return least


def _merge_bucket(batches):
    """Answers each block's list with the least document of every window; rows come sorted by bucket."""

    def answers(bucket, held):
        lengths, docs, body = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        start = np.cumsum(lengths) - lengths
        sums, factors = _prefix(body)
        strings = Distinct(body, start, lengths, (sums[start + lengths] - sums[start]) * factors[start], np.zeros(len(start), np.int8))
        del sums, factors
        one = lengths[strings.first]
        least = resolved(body[_ranges(start[strings.first], one)], one, strings.least(docs))
        n, begin = lengths - WINDOW + 1, np.cumsum(one - WINDOW + 1) - one + WINDOW - 1
        gain = np.repeat(docs, n) - least[_ranges(begin[strings.entry], n)]
        at = 0
        for block, own, _, _ in held:
            n = int((own - WINDOW + 1).sum())
            # neighbouring windows mostly gain alike: differences compress well
            yield K.piece(K.ANSWER, block, bucket, K.squeeze(np.diff(gain[at : at + n], prepend=0).astype("<i8").tobytes()))
            at += n

    bucket, held = None, []
    for batch in batches:
        for block, k, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data"))):
            if k != bucket:
                if held:
                    yield from answers(bucket, held)
                bucket, held = k, []
            held.append((block, *_unpack(K.swell(data))))
    if held:
        yield from answers(bucket, held)


def removed(docs: DataFrame, finish, schema: str, buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """finish(doc_ids, texts, masks) → Arrow table, for each block; a mask says which bytes of a text go."""
    spark = docs.sparkSession
    own = plain(docs, "doc_id", "text")
    size = K.input_bytes(own)
    buckets, (bits, slices) = buckets or min(K.MOST_BUCKETS, 4 * K.bucket_count(size)), marks_shape(size)
    # fewer buckets than shuffle partitions would have Spark deal the blocks anew
    tasks = max(K.block_tasks(size, block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = K.bucketed_blocks(own, "suffixes", block_bytes, tasks)

    def marks(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                yield from _mark_pieces(block, K.opened(data)[1], bits, slices)

    def opened(block: pa.Table, rows: pa.Table) -> tuple[list[int | None], list[bytes], Listed, dict[int, bytes]]:
        held = {K.SKETCH: {}, K.ANSWER: {}}
        for kind, k, data in zip(*(rows.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
            held[kind][k] = data
        ids, texts = K.opened(block.column("data")[0].as_py())
        return ids, texts, Listed(ids, texts, Several(held[K.SKETCH], bits, slices), buckets), held[K.ANSWER]

    def lists(block: pa.Table, rows: pa.Table) -> pa.Table:
        found = opened(block, rows)[2]
        n = block.column("block")[0].as_py()
        pieces = [K.piece(K.ANSWER, n, k, _squeezed(found.packed(k))) for k in np.flatnonzero(np.diff(found.cut)).tolist()]
        return pa.Table.from_batches(pieces, K.PIECES_ARROW).combine_chunks()

    def apply(block: pa.Table, rows: pa.Table) -> pa.Table:
        ids, texts, found, answers = opened(block, rows)
        gains = [np.cumsum(np.frombuffer(K.swell(answers.pop(k)), "<i8")) for k in np.flatnonzero(np.diff(found.cut)).tolist()]
        return finish(ids, texts, found.masks(np.concatenate([np.zeros(0, np.int64), *gains])))

    by = lambda df: df.groupBy("block")
    sliced = blocks.mapInArrow(marks, K.PIECES).repartition(slices, "bucket").sortWithinPartitions("bucket")
    several = staged(sliced.mapInArrow(_answer_marks, K.PIECES), "suffix-marks")
    listed = by(blocks).cogroup(by(several)).applyInArrow(lists, K.PIECES)
    answers = listed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge_bucket, K.PIECES)
    return by(blocks).cogroup(by(several.unionByName(answers))).applyInArrow(apply, schema)


def kept(text: bytes, mask: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~mask].tobytes() if mask.any() else text


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, bytes): what is left of each text; a cut may part a character's bytes."""

    def finish(ids, texts, masks):
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "bytes": pa.array([kept(t, m) for t, m in zip(texts, masks)], pa.binary())})

    return removed(docs, finish, "doc_id long, bytes binary")


def report(docs: DataFrame, **options) -> DataFrame:
    def finish(ids, texts, masks):
        runs = [int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) for m in masks]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
            "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(kept(t, m)).hexdigest() for t, m in zip(texts, masks)], pa.string()),
        })

    return removed(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)
