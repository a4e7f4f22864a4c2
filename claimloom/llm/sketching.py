"""Count-min sketches merged from partitions, and the blocks of documents that repeat-finders share.

A window (35 words, 50 bytes) is keyed by its anchor: the least hash among the short grams inside
it, so a window that occurs twice has an anchor that occurs twice. Anchors are selected by content
alone and are far fewer than windows. Their counts go into a count-min sketch of two rows; each
task sketches what it read, slices of the sketches are merged by adding counts (two is as good as
many), and cells that reached two become bits. Estimates never fall below true counts: a window
whose anchor has a clear bit occurs once, for certain. The sketch's width grows with the input up
to MOST_BITS; beyond it more windows pass the filter, and none is ever lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from claimloom.llm.common import input_bytes, plain, scratch_path, small_batches  # noqa: F401

PIECES = "kind int, block long, bucket int, data binary"
PIECES_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
DOCS, SKETCH, ANSWER = 0, 1, 2
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SLICE = 20
#: Cells of a sketch row, as a power of two, at most (32 MB of bits a row).
MOST_BITS = 28
#: Text of a block.
BLOCK_BYTES = 32 << 20
#: zstd level of bucketed blocks: written once, read by every pass.
BLOCK_LEVEL = 6
#: Documents hashed together, in bytes: bounds the arrays of one step.
GROUP_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 65_536
MOST_TASKS = 100_000

_codec = pa.Codec("zstd", 1)


def squeeze(data: bytes, codec: pa.Codec = _codec) -> bytes:
    return len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True)


def swell(data: bytes) -> bytes:
    return _codec.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


def piece(kind: int, block: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], schema=PIECES_ARROW)


def bucket_count(size: int) -> int:
    return max(16, min(MOST_BUCKETS, size // BUCKET_BYTES))


def block_tasks(size: int, block_bytes: int) -> int:
    """Tasks that blocks are dealt to: few blocks each, texts being twice as large as stored; past MOST_TASKS one after the other."""
    return max(16, min(MOST_TASKS, 6 * size // block_bytes))


def width(size: int, shift: int) -> int:
    """Bits of a sketch row for so many input bytes and one anchor in 2**shift bytes or so."""
    return max(SLICE, min(MOST_BITS, (max(size, 1) >> shift).bit_length()))


def mix(z: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (in place)."""
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    return z


def slide(values: np.ndarray, n: int, least=np.minimum) -> np.ndarray:
    """Least (or greatest) of every n neighbours."""
    step = 1
    while step * 2 <= n:
        values = least(values[:-step], values[step:])
        step *= 2
    return least(values[: len(values) - (n - step)], values[n - step :]) if step < n else values


def selected(grams: np.ndarray, anchors: np.ndarray, n: int) -> np.ndarray:
    """Hash of each gram position that is the least of some n neighbours (ties all count)."""
    padded = np.concatenate([np.zeros(n - 1, np.uint64), anchors, np.zeros(n - 1, np.uint64)])
    return grams[grams == slide(padded, n, np.maximum)]


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (anchors * np.uint64(ROWS[row])) >> np.uint64(64 - bits)


def sketch_pieces(anchors: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A partition's sketch, as the cells of each slice that count one and two."""
    for row in range(len(ROWS)):
        at = np.sort(cells(anchors, row, bits))
        first = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        many = np.diff(np.append(start, len(at))) > 1
        at = at[start].astype(np.int64)
        edge = np.searchsorted(at >> SLICE, np.arange((1 << (bits - SLICE)) + 1))
        for s in range(1 << (bits - SLICE)):
            own, two = at[edge[s] : edge[s + 1]] & ((1 << SLICE) - 1), many[edge[s] : edge[s + 1]]
            if len(own):
                gaps = np.diff(own, prepend=0).astype("<u4")
                yield piece(SKETCH, 0, row << 16 | s, squeeze(len(own).to_bytes(4, "little") + gaps.tobytes() + np.packbits(two).tobytes()))


def _merge(batches):
    """Adds the slices of each bucket's sketches; rows come sorted by bucket. Yields bits of cells that reached two."""
    key, count = None, None
    for batch in batches:
        for k, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
            if k != key:
                if key is not None:
                    yield piece(SKETCH, 0, key, np.packbits(count > 1, bitorder="little").tobytes())
                key, count = k, np.zeros(1 << SLICE, np.uint8)
            raw = swell(data)
            n = int.from_bytes(raw[:4], "little")
            at = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
            two = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 4 * n))[:n]
            count[at] = np.minimum(2, count[at] + 1 + two)
    if key is not None:
        yield piece(SKETCH, 0, key, np.packbits(count > 1, bitorder="little").tobytes())


class Repeated:
    """Merged sketch: which anchors are estimated to occur twice or more."""

    def __init__(self, bits: int, rows: list[np.ndarray]):
        self.bits, self.rows = bits, rows

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for row, held in enumerate(self.rows):
            at = cells(anchors, row, self.bits)
            out &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of GROUP_BYTES or one document each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > GROUP_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _closed(held: list[pa.RecordBatch], codec: pa.Codec | str) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_table(pa.Table.from_batches(held))
    return sink.getvalue().to_pybytes()


def bucketed_blocks(docs: DataFrame, name: str, block_bytes: int, tasks: int) -> DataFrame:
    """docs (doc_id, text) as a stored table (block, data) of compressed blocks, bucketed by block.

    What is grouped with it by block is dealt to its buckets; the blocks themselves are never shuffled. The catalog
    knows the table only until it is read: the returned plan holds its files and buckets.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        partition, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        codec = pa.Codec("zstd", BLOCK_LEVEL)

        def block():
            return pa.RecordBatch.from_arrays([pa.array([partition << 20 | n], pa.int64()), pa.array([_closed(held, codec)], pa.binary())], names=["block", "data"])

        for batch in batches:
            if held and size + batch.nbytes > block_bytes:
                yield block()
                n, held, size = n + 1, [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield block()

    path = scratch_path(spark, name)
    own = plain(docs, "doc_id", "text").selectExpr("cast(doc_id as long) as doc_id", "text")
    known = "spark_catalog.default.claimloom_" + path.rsplit("-", 1)[1]
    rows = own.mapInArrow(run, "block long, data binary")
    rows.write.format("parquet").option("path", path).option("compression", "none").bucketBy(tasks, "block").saveAsTable(known)
    try:
        return spark.table(known)
    finally:
        spark.sql(f"drop table {known}")


def stage_blocks(docs: DataFrame, anchors_of: Callable[[list[bytes]], np.ndarray], bits: int, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as a stored table of compressed blocks (kind DOCS) and partition sketches (kind SKETCH)."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        partition, n, held, size, found = TaskContext.get().partitionId(), 0, [], 0, []

        def block():
            return piece(DOCS, partition << 20 | n, -1, _closed(held, "zstd"))

        for batch in batches:
            if held and size + batch.nbytes > block_bytes:
                yield block()
                n, held, size = n + 1, [], 0
            held.append(batch)
            size += batch.nbytes
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found += [anchors_of(texts[lo:hi]) for lo, hi in groups(texts)]
            if sum(map(len, found)) > 1 << 22:
                yield from sketch_pieces(np.concatenate(found), bits)
                found = []
        if held:
            yield block()
        if found:
            yield from sketch_pieces(np.concatenate(found), bits)

    path = scratch_path(spark, name)
    own = plain(docs, "doc_id", "text").selectExpr("cast(doc_id as long) as doc_id", "text")
    own.mapInArrow(run, PIECES).write.partitionBy("kind").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def merged(stored: DataFrame, bits: int) -> Repeated:
    """The sketches of all partitions as one; what reaches the driver is a bit per cell, bounded by MOST_BITS."""
    slices = 1 << (bits - SLICE)
    parts = stored.where(f"kind = {SKETCH}").repartition(min(len(ROWS) * slices, 256), "bucket").sortWithinPartitions("bucket")
    rows = [np.zeros(1 << (bits - 3), np.uint8) for _ in ROWS]
    for r in parts.mapInArrow(_merge, PIECES).select("bucket", "data").toLocalIterator():
        row, s = r["bucket"] >> 16, r["bucket"] & 0xFFFF
        rows[row][s << (SLICE - 3) : (s + 1) << (SLICE - 3)] = np.frombuffer(r["data"], np.uint8)
    return Repeated(bits, rows)


def opened(data: bytes) -> tuple[list[int | None], list[bytes]]:
    """(doc_ids, texts) of a stored block."""
    table = pa.ipc.open_stream(data).read_all()
    return table.column("doc_id").to_pylist(), [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
