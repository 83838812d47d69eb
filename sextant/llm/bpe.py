"""Byte-level BPE: encode every distinct word once for the whole corpus, then put documents together again."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm.common import lean, save, scratch_dir, small_batches, trim

#: UTF-8 bytes of text that share one dictionary of words.
BLOCK_BYTES = 4 << 20
#: Documents of a block that are packed together.
GROUP = 256
#: Words are dealt out by hash to at most so many buckets.
BUCKETS = 4096

PACKED = "block long, bucket int, blob binary"


#: A block's file: groups of documents and their words' numbers; the first row has none, but the words' order in the buckets.
FILE = pa.schema([("docs", pa.list_(pa.int64())), ("blob", pa.binary())])


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def _shipped(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, read by the driver (a path with a scheme: by Spark) and sent to executors, which needn't have it: a vocabulary of fixed size, about a megabyte."""
    if "://" in path:
        return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class TokenBytes:
    """The token-byte table, with joins of ids to it: a row a token, found by its id."""

    def __init__(self, ranks: dict[bytes, int]):
        table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.table = pa.array(table, pa.large_binary())

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after another."""
        if not len(ids):
            return b""
        found = self.table.take(pa.array(ids))
        edges = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(ids) + 1]
        return found.buffers()[2][int(edges[0]) : int(edges[-1])].to_pybytes()


def _planes(a: np.ndarray) -> bytes:
    """Integers as four planes of bytes: the high ones are mostly zero and compress away."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


def _pack(*arrays: np.ndarray, rest: bytes = b"") -> bytes:
    """Arrays of one length and a rest, compressed."""
    import zstandard

    return len(arrays[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=6).compress(b"".join(map(_planes, arrays)) + rest)


def _unpack(blob: bytes) -> tuple[int, bytes]:
    import zstandard

    return int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:])


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, block_bytes: int, buckets: int, path: str) -> Iterator[pa.RecordBatch]:
    """Explode documents into pre-tokens, a block at a time.

    A block yields its distinct words, packed by hash bucket; its documents, as
    the numbers of their words by position, go to a file of the block in the
    shared folder. Words are numbered as they are first seen, so common ones
    have small numbers that compress well. So a word common everywhere is
    shuffled once a block, and no document is. A block of a failed or doubled
    attempt has a name of its own, which no saved row has.
    """
    import uuid

    import regex
    import xxhash
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    find = regex.compile(pattern).findall
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])

    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    def closed(words: Numbers, docs: list) -> Iterator[pa.RecordBatch]:
        block = uuid.uuid4().int >> 65
        listed = [w.encode("utf-8", "surrogatepass") for w in words]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in listed), np.int64, len(listed))
        order = np.array(sorted(range(len(listed)), key=listed.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        with store.open_output_stream(f"{base}/{block}", compression=None) as out, pa.ipc.new_stream(out, FILE) as file:
            file.write_batch(pa.RecordBatch.from_arrays([pa.array([[]], pa.list_(pa.int64())), pa.array([_pack(np.array(order, np.uint32))])], schema=FILE))
            for lo in range(0, len(docs), GROUP):
                part = docs[lo : lo + GROUP]
                blob = _pack(np.array([len(x) for _, x in part], np.uint32), rest=_planes(np.concatenate([x for _, x in part])))
                file.write_batch(pa.RecordBatch.from_arrays([pa.array([[d for d, _ in part]], pa.list_(pa.int64())), pa.array([blob])], schema=FILE))
        rows = []
        for b in range(buckets):
            if edges[b] < edges[b + 1] or not b:  # the first also says that there is this block
                part = [listed[i] for i in order[edges[b] : edges[b + 1]]]
                rows.append((block, b, _pack(np.fromiter(map(len, part), np.uint32, len(part)), rest=b"".join(part))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    words, docs, size = Numbers(), [], 0
    for batch in batches:
        length = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
        for i, doc in enumerate(batch.column(0).to_pylist()):
            found = find(batch.column(1)[i].as_py() or "")
            docs.append((doc, np.fromiter(map(words.__getitem__, found), np.uint32, len(found))))
            size += length[i]
            if size >= block_bytes:
                yield from closed(words, docs)
                words, docs, size = Numbers(), [], 0
    if docs:
        yield from closed(words, docs)


def encode_words(packed: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """(block, bucket, blob): the numbers of ids and the ids of the words of (block, bucket, blob), in their order.

    packed is dealt out and sorted by bucket, so all blocks' equal words follow
    each other in one task, which encodes each distinct word of the corpus once
    and copies the ids; it remembers the words of one bucket at a time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe, known, now = None, {}, None
        for batch in batches:
            bpe = bpe or tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=parse_ranks(ranks.value), special_tokens={})._core_bpe
            out = []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    known, now = {}, bucket
                n, data = _unpack(blob)
                ends = 4 * n + np.cumsum(_from_planes(data, n).astype(np.int64))
                ids, at = [], 4 * n
                for end in ends.tolist():
                    word = data[at:end]
                    if (got := known.get(word)) is None:
                        known[word] = got = bpe.encode_single_piece(word)
                    ids.append(got)
                    at = end
                flat = np.fromiter((i for x in ids for i in x), np.uint32)
                out.append(_pack(np.fromiter(map(len, ids), np.uint32, n), rest=_planes(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "blob"])

    return packed.select("block", "bucket", "blob").mapInArrow(lean(encode), "block long, bucket int, blob binary")


def _per_block(docs: DataFrame, ranks: Broadcast, pattern: str, block_bytes: int, finish: Callable[[], Callable[[np.ndarray], tuple]], schema: str) -> DataFrame:
    """(doc_id, n_tokens, ...) of docs (doc_id, text): what the function that finish() makes gives for a document's ids, as schema says."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch_dir(spark)
    packed = save(rows.mapInArrow(lean(lambda b: _blocks(b, pattern, block_bytes, buckets, path)), PACKED))
    known = encode_words(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket"), ranks, pattern)
    names = ["doc_id", "n_tokens", *[x.split()[0] for x in schema.split(", ")]]

    def assemble(key: tuple, left: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        lens, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        bucket, blobs = left.column("bucket").to_numpy(), left.column("blob")
        for i in np.argsort(bucket).tolist():
            n, data = _unpack(blobs[i].as_py())
            lens.append(_from_planes(data, n).astype(np.int64))
            flat.append(_from_planes(data[4 * n :], int(lens[-1].sum())))
        by_bucket, flat = np.concatenate(lens), np.concatenate(flat)
        done, out = finish(), []
        with store.open_input_stream(f"{base}/{key[0].as_py()}", compression=None) as file, pa.ipc.open_stream(file) as groups:
            for group in groups:  # the first holds the words' order, each other one a group of documents
                listed, (blob,) = group.column("docs").to_pylist()[0], group.column("blob").to_pylist()
                n, data = _unpack(blob)
                if not listed:
                    order = _from_planes(data, n)
                    lens, starts = np.empty(n, np.int64), np.empty(n, np.int64)
                    lens[order], starts[order] = by_bucket, np.cumsum(by_bucket) - by_bucket
                    continue
                sizes = _from_planes(data, n).astype(np.int64)
                places = _from_planes(data[4 * n :], int(sizes.sum()))
                for doc, lo, hi in zip(listed, (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
                    at = places[lo:hi]
                    k = lens[at]
                    ends = np.cumsum(k)
                    total = int(ends[-1]) if len(k) else 0
                    take = np.arange(total) + np.repeat(starts[at] - (ends - k), k)
                    out.append((doc, total, *done(flat[take].astype("<u4"))))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
        made = pa.table({c: pa.array(x, pa.int64() if i < 2 else None) for i, (c, x) in enumerate(zip(names, cols, strict=True))})
        trim()
        return made

    return known.groupBy("block").applyInArrow(assemble, f"doc_id long, n_tokens long, {schema}")


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs (doc_id, text): ids as little-endian unsigned 32-bit integers.

    Pre-tokens are exploded with their positions, a block's documents sharing
    a dictionary; a shuffle by word brings equal words together, to be encoded
    once; ids join back to the blocks, which reassemble by position.
    A null text is empty and has no ids; repeated rows each have a row; an
    empty table gives none; other columns are ignored.
    """
    return _per_block(docs, _shipped(docs.sparkSession, ranks_path), pattern, block_bytes, lambda: lambda ids: (ids.tobytes(),), "ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with decoded (binary): its ids joined with the token-byte table, which every task has, a document at a time."""
    ranks = _shipped(encoded.sparkSession, ranks_path)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or TokenBytes(parse_ranks(ranks.value))
            texts = [table.join(np.frombuffer(x.as_py(), "<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(lean(look_up), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for docs (doc_id, text).

    As encode and decode, one after the other, but a block's ids are decoded
    where they were put together and only their digests leave the task.
    """
    ranks, held = _shipped(docs.sparkSession, ranks_path), {}

    def digests() -> Callable[[np.ndarray], tuple]:
        if not held:  # once a task, whatever the number of its blocks
            held["table"] = TokenBytes(parse_ranks(ranks.value))
        table = held["table"]
        return lambda ids: (hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(table.join(ids)).hexdigest())

    return _per_block(docs, ranks, pattern, BLOCK_BYTES, digests, "ids_sha256 string, decoded_sha256 string")
