"""Suffix-array dedup of bytes: distributed prefix doubling over the positions that are still in doubt."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import lean, save, small_batches, unique_ids
from sextant.llm.segments import Cutter, _starts_of_runs, apply_removals, first_of_equals, merged, mix, residual, shared_segments

WINDOW = 100
#: Bytes of the gram that anchors a window; of the one that anchors it again within a shard.
GRAM, FINE_GRAM = 24, 98
#: Prefix lengths after each round.
LENGTHS = (25, 50, 100)
OPEN = "uid long, start long, windows long, data binary"


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _symbols() -> Callable[[str | None], np.ndarray]:
    table = _table()
    return lambda text: table[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]


def _take() -> Callable[[str, list], list[bytes]]:
    def run(text: str, spans: list[tuple[int, int]]) -> list[bytes]:
        data = text.encode("utf-8", "surrogatepass")
        return [data[s:e] for s, e in spans]

    return run


def refine(uid: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> tuple[list[np.ndarray], list[tuple[int, int, bytes]]]:
    """Cut a shard's pieces again at long grams: windows (uid, start, number) that equals settle, and (uid, start, data) still in doubt."""
    cutter, table = Cutter(WINDOW, FINE_GRAM), _table()
    parts = []
    for i, p in enumerate(pieces):
        a, c, s, k = cutter.cut(table[np.frombuffer(p, np.uint8)])
        parts.append((a, c, s, k, np.full(len(a), i)))
    if not parts:
        return [np.zeros(0, np.int64)] * 3, []
    a, c, s, k, i = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, at = uid[i], start[i] + s
    order, first = first_of_equals(a, c, u, at)
    a, u, at, s, k, i = a[order], u[order], at[order], s[order], k[order], i[order]
    gu, gs, ge = merged(u[~first], at[~first], at[~first] + k[~first])
    a, u, at, s, k, i = a[first], u[first], at[first], s[first], k[first], i[first]
    begin = np.flatnonzero(_starts_of_runs(a))
    runs = np.diff(np.append(begin, len(a)))
    open_ = []
    for j in np.flatnonzero(np.repeat(runs > 1, runs)):
        for w in range(k[j]):
            open_.append((int(u[j]), int(at[j]) + w, pieces[i[j]][s[j] + w : s[j] + w + WINDOW]))
    return [gu, gs, ge - gs], open_


def _rerank(size: int, last: bool) -> Callable:
    """Over rows sorted by (rank, piece, uid, start): a new rank for each run of equal pairs, unique ones dropped; in the last round, what is not first in its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: pa.RecordBatch | None = None  # the last row, whose run may go on
        running = False  # whether that row has equals before it
        for batch in _and_none(batches):
            rows = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks() if held is not None or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            n = rows.num_rows
            rank = rows.column("rank").to_numpy()
            piece = np.frombuffer(b"".join(rows.column("piece").to_pylist()), np.uint8).reshape(n, size)
            same = np.zeros(n, bool)
            same[1:] = (rank[1:] == rank[:-1]) & (piece[1:] == piece[:-1]).all(axis=1)
            same[0] = running and held is not None
            ready = n if batch is None else n - 1
            new = number + np.cumsum(~same)
            follows = np.append(same[1:], False)
            pick = (same if last else same | follows)[:ready]
            number = int(new[ready - 1]) if ready else number
            # the held row is counted again with the next rows: if it begins a run, that run has no number yet
            running = bool(same[n - 1])
            held = None if batch is None else rows.slice(n - 1).to_batches()[0]
            if pick.any():
                kept = rows.slice(0, ready).filter(pa.array(pick))
                yield pa.RecordBatch.from_arrays([kept.column("uid").combine_chunks(), kept.column("start").combine_chunks(), kept.column("data").combine_chunks(), pa.array(new[:ready][pick])], ["uid", "start", "data", "rank"])

    return run


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def double(rows: DataFrame, lengths: tuple[int, ...] = LENGTHS, partitions: int | None = None) -> DataFrame:
    """(uid, start) of rows (uid, start, data) whose data, as long as the last length, an earlier row equals.

    Every round sorts the positions by the pair of their rank and what follows
    at the offset reached so far, and ranks equal pairs anew; the offsets
    double. A position alone in its rank is unique and leaves.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked, done = rows.select("uid", "start", "data", F.lit(0).cast("long").alias("rank")), 0
    for length in lengths:
        pairs = ranked.withColumn("piece", F.substring("data", done + 1, length - done))
        dealt = pairs.repartitionByRange(partitions, "rank", "piece").sortWithinPartitions("rank", "piece", "uid", "start")
        ranked = save(dealt.mapInArrow(lean(_rerank(length - done, length == lengths[-1])), "uid long, start long, data binary, rank long"))
        done = length
    return ranked.select("uid", "start")


def _finish(text: str | None, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    kept, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(data[at:s])
        at = e
    kept = b"".join([*kept, data[at:]])
    return len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary) of docs (doc_id, text).

    Each byte covered by a string of 100 bytes that also starts earlier is
    removed. Equal segments and segments alone at their anchor are settled by
    content; the windows of the others, near the ends of what is repeated, are
    ranked by prefix doubling. A null text is empty; a null doc_id comes last;
    rows that repeat a doc_id are documents of their own, the one with the
    smaller text first. What is kept need not be valid UTF-8. An empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = unique_ids(docs, docs.sparkSession)
    facts = shared_segments(rows, _symbols, WINDOW, GRAM)
    pieces = residual(rows, facts, WINDOW, _take)

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        gone, open_ = refine(table.column("uid").to_numpy(), table.column("start").to_numpy(), table.column("data").to_pylist())
        n, u, s, d = len(gone[0]), *(zip(*open_, strict=True) if open_ else ((), (), ()))
        return pa.table({
            "uid": pa.array(np.concatenate([gone[0], np.array(u, np.int64)])), "start": pa.array(np.concatenate([gone[1], np.array(s, np.int64)])),
            "windows": pa.array(np.concatenate([gone[2], np.ones(len(u), np.int64)])), "data": pa.array([None] * n + list(d), pa.binary())})

    settled = save(pieces.groupBy("bucket").applyInArrow(settle, OPEN))
    ranked = double(settled.where("data is not null"))
    found = settled.where("data is null").select("uid", "start", "windows").unionByName(ranked.withColumn("windows", F.lit(1).cast("long")))
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    finish = _finish if with_kept else lambda *a: _finish(*a)[:4]
    return apply_removals(rows, facts, found, WINDOW, finish, schema)
