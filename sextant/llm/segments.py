"""Windows that occur twice in a corpus: cut documents at shared anchors, so that equal windows meet in equal places.

A window is `window` symbols of one document (words or bytes). Its anchor is
the gram of `gram` symbols in it with the smallest hash, so equal windows have
equal anchors at equal offsets. A segment is a longest run of windows with the
same anchor. Whatever windows share, their segments share an anchor; nothing
else needs to be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import lean, save

_B, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Symbols that are cut into segments at once; a position takes 24 bits of a key.
CHUNK = 1 << 20
POSITION = np.uint64((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Cutter:
    """Segments of sequences of symbols, given as well-mixed 64-bit hashes."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        n = CHUNK + 2 * window + 2
        self.up, self.down = _powers(_B, n), _powers(_INV, n)

    def _sliding_min(self, x: np.ndarray, width: int) -> np.ndarray:
        n = len(x) - width + 1
        step = 1
        while 2 * step <= width:
            x = np.minimum(x[:-step], x[step:])
            step *= 2
        return np.minimum(x[:n], x[width - step : width - step + n])

    def cut(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: anchor hash, content hash, first window's start, number of windows."""
        k, m = self.window, self.gram
        found = []
        for lo in range(0, max(0, len(symbols) - k + 1), CHUNK):
            x = symbols[lo : lo + CHUNK + k - 1]
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * self.up[: len(x)], out=total[1:])
            grams = mix((total[m:] - total[:-m]) * self.down[: len(x) - m + 1])
            key = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
            least = self._sliding_min(key, k - m + 1)
            at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            count = np.diff(np.append(at, len(least)))
            end = at + count + k - 1
            content = mix((total[end] - total[at]) * self.down[at] + count.astype(np.uint64))
            found.append((grams[(least[at] & POSITION).astype(np.int64)], content, at + lo, count))
        if not found:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# ---- the distributed part ------------------------------------------------------------------

#: Segments of a block that lose their equals before anything is shuffled.
BLOCK_SEGMENTS = 300_000

FACTS = "uid long, anchor long, content long, start long, windows long, state int"
#: States of a segment: its windows all start earlier too; it equals an earlier one, and what that one's content is reported to repeat, it repeats;
#: it is the first of its content, and its anchor has other contents; it is the first of its content, has copies, and its anchor no other content.
GONE, COPY, CONTESTED, COPIED = range(4)


def _starts_of_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def first_of_equals(anchor: np.ndarray, content: np.ndarray, uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by anchor, content, uid, start, and in it which segments are the first of their content."""
    order = np.lexsort((start, uid, content, anchor))
    return order, _starts_of_runs(anchor[order], content[order])


def merged(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals with those of one uid that overlap or touch made one."""
    if not len(uid):
        return uid, start, end
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order], end[order]
    new = _starts_of_runs(uid)
    # the furthest end so far within a uid: one running maximum, each uid lifted above the one before
    lift = (np.cumsum(new) - 1) * np.int64(end.max() + 1)
    far = np.maximum.accumulate(end + lift) - lift
    gap = new.copy()
    gap[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(gap)
    return uid[at], start[at], far[np.append(at[1:], len(far)) - 1]


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    n = len(arrays[0])
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    import zstandard

    n, data, out, at = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:]), [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(data[at : at + size], k))
        at += size
    return out


_SEGMENT = [np.uint64, np.uint64, np.int64, np.int64, np.uint16, np.uint32]
_FACT = [np.int64, np.int64, np.int64]
_COPY = [np.int64, np.int64, np.uint16, np.uint64, np.uint64]


def shared_segments(rows: DataFrame, symbols: Callable[[], Callable[[str | None], np.ndarray]], window: int, gram: int, follow: bool = False) -> DataFrame:
    """A saved table (uid, anchor, content, start, windows, state) about rows (uid, text): segments whose windows may occur twice.

    Segments that have neither a copy nor an anchor with other contents are
    left out: their windows occur once. Copies are settled here (GONE, with
    intervals made one) or, with follow, only named (COPY): then somebody else
    says what their content repeats, and its first segment is in the table
    (COPIED) even if it is alone at its anchor.

    A block of documents sends each content once, packed by buckets of
    anchors, so however many copies a passage has, a bucket gets at most one a
    block; copies within a block never meet.
    """
    spark = rows.sparkSession
    splits = rows.rdd.getNumPartitions()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * splits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, of, kept, n, turn = Cutter(window, gram), symbols(), [], 0, 0

        def closed(parts: list, turn: int) -> pa.RecordBatch:
            a, c, s, k, u = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first = first_of_equals(a, c, u, s)
            a, c, u, s, k = a[order], c[order], u[order], s[order], k[order]
            again = ~first
            if follow:
                blob = _pack(u[again], s[again], k[again].astype(np.uint16), a[again], c[again])
            else:
                blob = _pack(*merged(u[again], s[again], s[again] + k[again]))
            bucket, blobs, kinds = [turn % buckets], [blob], [0]
            times = np.diff(np.append(np.flatnonzero(first), len(first))).astype(np.uint32)
            a, c, u, s, k = a[first], c[first], u[first], s[first], k[first].astype(np.uint16)
            where = (a % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    at = order[edges[b] : edges[b + 1]]
                    bucket.append(b)
                    kinds.append(1)
                    blobs.append(_pack(a[at], c[at], u[at], s[at], k[at], times[at]))
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = cutter.cut(of(text))
                if len(found[0]):
                    kept.append((*found, np.full(len(found[0]), uid, np.int64)))
                    n += len(found[0])
                    turn = turn or uid
                if n >= BLOCK_SEGMENTS:
                    yield closed(kept, turn)
                    kept, n, turn = [], 0, turn + 1
        if kept:
            yield closed(kept, turn)

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        parts, facts = [], []

        def fact(u: np.ndarray, s: np.ndarray, k: np.ndarray, a: np.ndarray, c: np.ndarray, state: np.ndarray | int) -> None:
            facts.append((u, a.view(np.int64), c.view(np.int64), s, k.astype(np.int64), np.broadcast_to(np.asarray(state, np.int32), u.shape)))

        def gone(u: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
            fact(u, s, e - s, np.zeros(len(u), np.uint64), np.zeros(len(u), np.uint64), GONE)

        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind:
                parts.append(_unpack(blob, _SEGMENT))
            elif follow:
                fact(*_unpack(blob, _COPY), COPY)
            else:
                gone(*_unpack(blob, _FACT))
        if parts:
            a, c, u, s, k, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first = first_of_equals(a, c, u, s)
            a, c, u, s, k, m = a[order], c[order], u[order], s[order], k[order].astype(np.int64), m[order].astype(np.int64)
            again = ~first
            if follow:
                fact(u[again], s[again], k[again], a[again], c[again], COPY)
            else:
                gone(*merged(u[again], s[again], s[again] + k[again]))
            copies = np.add.reduceat(m, np.flatnonzero(first)) > 1
            a, c, u, s, k = a[first], c[first], u[first], s[first], k[first]
            begin = np.flatnonzero(_starts_of_runs(a))
            several = np.repeat(np.diff(np.append(begin, len(a))) > 1, np.diff(np.append(begin, len(a))))
            at = several | copies if follow else several
            fact(u[at], s[at], k[at], a[at], c[at], np.where(several[at], CONTESTED, COPIED))
        u, a, c, s, k, state = (np.concatenate(x) for x in zip(*facts, strict=True))
        return pa.table({"uid": pa.array(u), "anchor": pa.array(a), "content": pa.array(c), "start": pa.array(s), "windows": pa.array(k), "state": pa.array(state.astype(np.int32))})

    packed = rows.select("uid", "text").mapInArrow(lean(cut), "bucket int, kind int, blob binary")
    return save(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle, FACTS))


PIECES = "bucket int, anchor long, content long, uid long, start long, data binary"


def residual(rows: DataFrame, facts: DataFrame, window: int, take: Callable[[], Callable[[str, list], list[bytes]]]) -> DataFrame:
    """(bucket, anchor, content, uid, start, data): the symbols of the segments that facts have as contested or copied. take() gives a function of (text, [(start, end)])."""
    spark = rows.sparkSession
    asked = facts.where(F.col("state") >= CONTESTED).groupBy("uid").agg(F.collect_list(F.struct("anchor", "content", "start", "windows")).alias("asked"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    names = [x.split()[0] for x in PIECES.split(", ")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = take()
        for batch in batches:
            out = []
            for u, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = cut(text, [(w["start"], w["start"] + w["windows"] + window - 1) for w in wanted])
                out += [(w["anchor"] % buckets, w["anchor"], w["content"], u, w["start"], x) for w, x in zip(wanted, found, strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    texts = rows.select("uid", "text").join(asked.hint("shuffle_hash"), "uid")
    return texts.select("uid", "text", "asked").mapInArrow(lean(pick), PIECES)


def apply_removals(rows: DataFrame, facts: DataFrame, found: DataFrame, window: int, finish: Callable, schema: str) -> DataFrame:
    """finish(text, merged [start, end) of what to remove) for every row (uid, doc_id, text), with doc_id before what it gives."""
    gone = facts.where(F.col("state") == GONE).select("uid", "start", "windows").unionByName(found.select("uid", "start", "windows"))
    spans = gone.groupBy("uid").agg(F.collect_list(F.struct("start", F.col("windows"))).alias("gone"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = np.array([g["start"] for g in gone or ()], np.int64)
                e = np.array([g["start"] + g["windows"] + window - 1 for g in gone or ()], np.int64)
                _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                out.append(finish(text, s, e))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c) for c in cols]], ["doc_id", *names])

    joined = rows.select("uid", "doc_id", "text").join(spans.hint("shuffle_hash"), "uid", "left")
    return joined.select("uid", "doc_id", "text", "gone").mapInArrow(lean(run), f"doc_id long, {schema}")
