"""Byte-level BPE encoding and decoding through a table of distinct words.

Words are split so that each encodes alone exactly as it does in its text: a new word begins at a
space that follows a non-space character. (The tokenizer's own pattern never joins text across
such a place, nor does an added token.) The steps:

1. each task reads a block of documents and lists the block's distinct words by hash bucket;
2. a bucket's task holds the words of that bucket from all blocks, encodes each distinct word once,
   and answers every block with ids in the order of its list;
3. documents and answers meet by block: word positions pick up their ids, and the ids of the block's
   distinct words are decoded by a join with the table of id and piece, whose size the vocabulary bounds.

What moves is one list entry per block and distinct word, the answers, and the documents once
(compressed). A bucket's task streams its lists and holds one bucket's distinct words. Blocks are
found again by partition and number; should a source deal its rows differently the second time, a
list doesn't match its answer's checksum and that block's words are encoded on the spot.

Defined cases: null text is empty: no tokens, and the digests of nothing; repeated rows and ids
are rows of their own; very long texts are a block of their own; other columns don't take part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm.common import input_bytes, plain, small_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Text of a block, and input of which one hash bucket is made.
BLOCK_BYTES = 32 << 20
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 16_384
MOST_TASKS = 100_000
#: Distinct words that one join decodes.
JOINED_WORDS = 50_000
_DOCS = -1
_LATER_SPACE = re.compile(r"\s ")
_PIECES = "block long, bucket int, data binary"
_PIECES_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


def words_of(text: str) -> list[str]:
    """Keys of the text's words: a word without its leading space, or, with a space put before it, the word as it is."""
    parts = text.split(" ")
    if not _LATER_SPACE.search(text):
        parts[0] = " " + parts[0]
        return parts
    out, held = [], parts[0]
    for part in parts[1:]:
        if held and not held[-1].isspace():  # a space begins a word only after a non-space
            out.append(" " + held)
            held = " " + part
        else:
            held += " " + part
    out.append(" " + held)
    return out


def word_text(key: str) -> str:
    return key[1:] if key[:1] == " " else " " + key


class _Numbers(dict):
    """Words in the order they were first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _lists(keys, buckets: int) -> list[list[bytes]]:
    """The keys by bucket, each list sorted."""
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    digest = xxhash.xxh3_64_intdigest
    for key in keys:
        b = key.encode()
        out[digest(b) % buckets].append(b)
    for one in out:
        one.sort()
    return out


def _pack(words: list[bytes]) -> bytes:
    return np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words)


def _unpack(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.frombuffer(data, "<u4", n, 4).cumsum().tolist()
    body, out, at = data[4 + 4 * n :], [], 0
    for e in ends:
        out.append(body[at:e])
        at = e
    return out


_codec = pa.Codec("zstd", 1)


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _codec.compress(data, asbytes=True)


def _swell(data: bytes) -> bytes:
    return _codec.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


def _blocks(batches, block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Blocks of whole documents with their numbers."""
    partition, n, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        if held and size + batch.nbytes > block_bytes:
            yield partition << 20 | n, pa.Table.from_batches(held)
            n, held, size = n + 1, [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield partition << 20 | n, pa.Table.from_batches(held)


class Codec:
    """A tokenizer from its JSON text, with the id-to-piece table."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        table = piece_table(self.tokenizer)
        self.pieces = pa.table({"id": pa.array(list(table), pa.int64()), "piece": pa.array(list(table.values()), pa.binary())})

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def decoded_words(pieces: pa.Table, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Text of each word (counts: its number of ids) by a join of ids and pieces on the id, put back in order."""
    out: list[bytes] = []
    at = 0
    for lo in range(0, len(counts), JOINED_WORDS):
        n = counts[lo : lo + JOINED_WORDS]
        some = ids[at : at + int(n.sum())].astype(np.int64)
        at += len(some)
        joined = pa.table({"id": some, "place": np.arange(len(some))}).join(pieces, "id", join_type="inner").sort_by("place")
        if joined.num_rows != len(some):
            raise ValueError("an id has no piece")
        piece = pa.concat_arrays(joined.column("piece").chunks) if joined.num_rows else pa.array([], pa.binary())
        lengths = np.concatenate([[0], np.cumsum(pc.binary_length(piece).to_numpy(zero_copy_only=False))]).astype(np.int64)
        data = b"".join(piece.to_pylist())
        ends = lengths[np.cumsum(n)].tolist()
        out += [data[a:z] for a, z in zip([0, *ends], ends)]
    return out


def piece_table(tokenizer: Tokenizer) -> dict[int, bytes]:
    """id → bytes of its piece; a token outside the byte alphabet stands for its own characters."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}


_codecs: dict[int, Codec] = {}


def _codec_of(shared) -> Codec:
    """One codec for each Python worker."""
    key = hash(shared.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def _answer(words: list[bytes], ids: list[list[int]]) -> bytes:
    flat = np.array([i for one in ids for i in one], "<u4")
    head = np.array([len(words)], "<u4").tobytes() + xxhash.xxh3_64_digest(_pack(words))
    return head + np.array(list(map(len, ids)), "<u4").tobytes() + flat.tobytes()


def _read_answer(data: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
    """(number of ids of each word, ids), or None if the answer is to another list."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    if n != len(words) or data[4:12] != xxhash.xxh3_64_digest(_pack(words)):
        return None
    return np.frombuffer(data, "<u4", n, 12), np.frombuffer(data, "<u4", -1, 12 + 4 * n)


def encoded(docs: DataFrame, path: str = TOKENIZER, output: str = "digests", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """One row per document of docs (doc_id, text): the ids and decoded text, or with output="digests" their digests."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:  # the driver's file; tasks get its content, of a size that the vocabulary bounds
        shared = spark.sparkContext.broadcast(f.read())
    own = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    if buckets is None:
        buckets = max(16, min(MOST_BUCKETS, input_bytes(own) // BUCKET_BYTES))

    def keys_of(block: pa.Table) -> set[str]:
        keys: set[str] = set()
        for t in texts_in(block):  # no more than one text is held split
            keys.update(words_of(t))
        return keys

    def texts_in(block: pa.Table) -> Iterator[str]:
        for chunk in block.column("text").chunks:
            for i in range(0, len(chunk), 64):
                yield from (t or "" for t in chunk[i : i + 64].to_pylist())

    def list_words(batches):
        for number, block in _blocks(batches, block_bytes):
            lists = [(b, _squeeze(_pack(ws))) for b, ws in enumerate(_lists(keys_of(block), buckets)) if ws]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(lists), pa.int64()), pa.array([b for b, _ in lists], pa.int32()), pa.array([d for _, d in lists], pa.binary())], schema=_PIECES_ARROW)

    def encode_once(batches):
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            for block, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    known, bucket = {}, b
                words = _unpack(_swell(data))
                new = [w for w in words if w not in known]
                known.update(zip(new, _codec_of(shared).encode([word_text(w.decode()) for w in new])))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([b], pa.int32()), pa.array([_squeeze(_answer(words, [known[w] for w in words]))], pa.binary())], schema=_PIECES_ARROW)

    def pack_documents(batches):
        for number, block in _blocks(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(block)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_DOCS], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_PIECES_ARROW)

    def put_back(group: pa.Table) -> pa.Table:
        codec = _codec_of(shared)
        rows = dict(zip(group.column("bucket").to_pylist(), group.column("data").to_pylist()))
        block = pa.ipc.open_stream(rows.pop(_DOCS)).read_all()
        numbers = _Numbers()
        places = [np.fromiter(map(numbers.__getitem__, words_of(t)), np.int32) for t in texts_in(block)]  # every text is split once
        lists = _lists(numbers, buckets)
        listed, counts, flats, at = np.empty(len(numbers), np.int64), [], [], 0
        for b, words in enumerate(lists):
            if words:
                found = _read_answer(_swell(rows[b]), words) if b in rows else None
                if found is None:
                    ids = codec.encode([word_text(w.decode()) for w in words])
                    found = np.array(list(map(len, ids)), "<u4"), np.array([i for one in ids for i in one], "<u4")
                listed[[numbers[w.decode()] for w in words]] = np.arange(at, at + len(words))
                at += len(words)
                counts.append(found[0])
                flats.append(found[1])
        del lists, rows, numbers
        count = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
        start = np.cumsum(count) - count
        decoded = decoded_words(codec.pieces, flat, count)  # each distinct word is decoded once
        n_tokens, first, second = [], [], []
        for own in places:
            place = listed[own]
            n = count[place]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids = flat[np.repeat(start[place], n) + step].astype("<u4")
            text = b"".join(map(decoded.__getitem__, place.tolist())).decode("utf-8", "replace")
            n_tokens.append(len(ids))
            first.append(hashlib.sha256(ids.tobytes()).hexdigest() if output == "digests" else ids.astype(np.int32))
            second.append(hashlib.sha256(text.encode()).hexdigest() if output == "digests" else text)
        kinds = (pa.string(), pa.string()) if output == "digests" else (pa.list_(pa.int32()), pa.string())
        return pa.Table.from_arrays([block.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if output == "digests" else ("ids", "decoded"))])

    lists = own.mapInArrow(list_words, _PIECES)
    answers = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encode_once, _PIECES)
    packed = own.mapInArrow(pack_documents, _PIECES)
    last = "ids_sha256 string, decoded_sha256 string" if output == "digests" else "ids array<int>, decoded string"
    # a block's pieces meet in one task, which has few blocks; past MOST_TASKS it takes them one after the other
    tasks = max(16, min(MOST_TASKS, 6 * input_bytes(own) // block_bytes))
    return packed.unionByName(answers).repartition(tasks, "block").groupBy("block").applyInArrow(put_back, f"doc_id long, n_tokens long, {last}")


def decode(rows: DataFrame, ids: str = "ids", path: str = TOKENIZER, out: str = "decoded") -> DataFrame:
    """rows with the text of a column of ids, by a join with the id-to-piece table (bounded by the vocabulary)."""
    spark = rows.sparkSession
    with open(path, encoding="utf-8") as f:
        table = piece_table(Tokenizer.from_str(f.read()))
    pieces = F.broadcast(spark.createDataFrame(list(table.items()), "_id int, _piece binary"))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = keyed.select("_row", F.posexplode(ids).alias("_at", "_id")).join(pieces, "_id").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["_piece"])).cast("string")
    return keyed.join(parts, "_row", "left").withColumn(out, F.coalesce(joined, F.lit(""))).drop("_row", "_p")


def report(docs: DataFrame) -> DataFrame:
    return encoded(docs)
