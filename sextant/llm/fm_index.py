"""Substring dedup of words: a compressed FM-index per shard, searched backward over its wavelet matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import save, skew_join, small_batches, unique_ids
from sextant.llm.segments import COPY, _starts_of_runs, apply_removals, residual, shared_segments

WINDOW = 20
#: Words of the gram that anchors a window.
GRAM = 5


class BitVector:
    """Bits with rank: a cumulative count per 64-bit word, and the word itself."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        self.n = n
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        self.zeros = n - int(counts.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << r) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """A sequence of small integers as one bit vector a level, most significant first."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels, self.bits = [], bits
        for level in range(bits - 1, -1, -1):
            b = ((seq >> level) & 1).astype(bool)
            self.levels.append(BitVector(b))
            seq = np.concatenate([seq[~b], seq[b]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each symbol: where its run begins in the last level, and lo and hi mapped there."""
        start = np.zeros_like(lo)
        for level, v in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            s, a, b = v.rank1(start), v.rank1(lo), v.rank1(hi)
            start = np.where(one, v.zeros + s, start - s)
            lo, hi = np.where(one, v.zeros + a, lo - a), np.where(one, v.zeros + b, hi - b)
        return start, lo, hi


class FMIndex:
    """Backward search over a text of integers 1..sigma, with longest-common-prefix bounds up to a depth.

    What stays is the wavelet matrix of the transform, a byte a position for
    the common prefixes, and of the suffix array one sample a group of suffixes
    that share `depth` symbols: the group's earliest position.
    """

    def __init__(self, text: np.ndarray, depth: int, whole: bool = True):
        """text: integers from 1, 0 as the end mark of each piece. Pieces' ends never match each other. whole: keep the suffix array, too."""
        self.depth, self.n = depth, len(text)
        n = self.n
        rank, h = text.astype(np.int64), 1
        # ends differ from each other, so no match goes beyond a piece
        ends = np.flatnonzero(text == 0)
        rank = rank + len(ends)
        rank[ends] = np.arange(len(ends))
        sa = np.argsort(rank, kind="stable")
        while True:
            r = rank[sa]
            new = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])]) if n else r
            rank = np.empty(n, np.int64)
            rank[sa] = new
            if h >= depth or (n and new[-1] == n - 1):
                break
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            pair = rank * (n + 1) + after
            sa = np.argsort(pair, kind="stable")
            rank = pair
            h *= 2
        self.sa = sa if whole else None
        # lcp of neighbours, capped at depth: bytes are enough
        self.lcp = np.zeros(n + 1, np.uint8)
        same = np.ones(max(0, n - 1), bool)
        padded = np.concatenate([text, np.full(depth, -1, text.dtype)])
        for d in range(depth):
            at = np.flatnonzero(same)
            x, y = padded[sa[at] + d], padded[sa[at + 1] + d]
            good = (x == y) & (x > 0)
            same[at[~good]] = False
            self.lcp[1:n][at[good]] = d + 1
        self.bounds: dict[int, np.ndarray] = {}
        last = text[sa - 1]
        bits = max(1, int(text.max(initial=0)).bit_length())
        self.bwt = WaveletMatrix(last.astype(np.int64), bits)
        counts = np.bincount(text, minlength=(1 << bits) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        groups = self.bound(depth)[:-1]
        self.earliest = (np.minimum.reduceat(sa, groups) if len(groups) else np.zeros(0, np.int64)).astype(np.uint32)

    def bound(self, d: int) -> np.ndarray:
        """Ranks at which the common prefix with the rank before is shorter than d."""
        if d not in self.bounds:
            self.bounds[d] = np.append(np.flatnonzero(self.lcp[: self.n] < d), self.n)
        return self.bounds[d]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranks of suffixes with the symbol before those from lo to hi."""
        start, a, b = self.bwt.rank(symbol, lo, hi)
        base = self.first[symbol]
        return base + a - start, base + b - start

    def widen(self, lo: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of all suffixes that share d symbols with the suffix at lo."""
        bounds = self.bound(d)
        i = np.searchsorted(bounds, lo, side="right")
        return bounds[i - 1], bounds[i]

    def matching_statistics(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position of each lane: the longest match that begins there, up to the depth, and its ranks.

        lanes: one document a row, padded with 0 at the right. All lanes move
        left together; one whose extension fails gives up its last symbol and
        tries again.
        """
        rows, width = lanes.shape
        length, low, high = (np.zeros((rows, width), np.int64) for _ in range(3))
        n = np.zeros(rows, np.int64)
        lo, hi = np.zeros(rows, np.int64), np.full(rows, self.n, np.int64)
        for c in range(width - 1, -1, -1):
            symbol = lanes[:, c]
            n[symbol <= 0] = 0
            todo = np.flatnonzero(symbol > 0)
            lo[symbol <= 0], hi[symbol <= 0] = 0, self.n
            at = todo[n[todo] == self.depth]
            if len(at):  # full: drop the last symbol
                lo[at], hi[at] = self.widen(lo[at], self.depth - 1)
                n[at] -= 1
            while len(todo):
                a, b = self.extend(symbol[todo], lo[todo], hi[todo])
                good = a < b
                done = todo[good]
                lo[done], hi[done] = a[good], b[good]
                n[done] += 1
                todo = todo[~good]
                out = todo[n[todo] == 0]
                lo[out], hi[out] = 0, self.n
                todo = todo[n[todo] > 0]
                for d in np.unique(n[todo]):
                    at = todo[n[todo] == d]
                    lo[at], hi[at] = self.widen(lo[at], int(d) - 1) if d > 1 else (np.zeros(len(at), np.int64), np.full(len(at), self.n))
                    n[at] = d - 1
            length[:, c], low[:, c], high[:, c] = n, lo, hi
        return length, low, high


def shard_matches(uid: np.ndarray, start: np.ndarray, pieces: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's pieces (words joined by a space): the piece and place of each window whose matching statistic reaches the threshold, and whether an earlier one equals it.

    The pieces are indexed in the order of (uid, start), then streamed against
    the index. Every window of a piece finds at least itself; it is repeated
    if the earliest occurrence in its interval comes before it.
    """
    order = np.lexsort((start, uid))
    names: dict[bytes, int] = {}
    coded = []
    for i in order:
        coded.append(np.fromiter((names.setdefault(w, len(names) + 1) for w in pieces[i].split()), np.int32))
    size = np.array([len(c) for c in coded], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int32)
    for b, c in zip(begin, coded, strict=True):
        text[b : b + len(c)] = c
    index = FMIndex(text, window, whole=False)
    bounds = index.bound(window)[:-1]
    piece, place, earlier = [], [], []
    by_size = np.argsort(size, kind="stable")
    for lo in range(0, len(by_size), 1 << 14):
        at = by_size[lo : lo + (1 << 14)]
        width = int(size[at].max())
        lanes = np.zeros((len(at), width), np.int64)
        inside = np.arange(width) < size[at][:, None]
        lanes[inside] = np.concatenate([coded[i] for i in at])
        length, low, _ = index.matching_statistics(lanes)
        lane, col = np.nonzero(length >= window)
        group = np.searchsorted(bounds, low[lane, col], side="right") - 1
        earlier.append(index.earliest[group] < begin[at[lane]] + col)
        piece.append(order[at[lane]])
        place.append(col)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (piece, place, earlier))


def _symbols() -> Callable[[str | None], np.ndarray]:
    import xxhash

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > 1 << 20:
                self.clear()
            self[word] = h = xxhash.xxh3_64_intdigest(word)
            return h

    of = Hashes()

    def run(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(of.__getitem__, words), np.uint64, len(words))

    return run


def _take() -> Callable[[str, list], list[bytes]]:
    def run(text: str, spans: list[tuple[int, int]]) -> list[bytes]:
        words = text.encode("utf-8", "surrogatepass").split()
        return [b" ".join(words[s:e]) for s, e in spans]

    return run


def _finish(text: str | None, start: np.ndarray, end: np.ndarray) -> tuple[int, int, str, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    kept, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        kept += words[at:s]
        at = e
    kept += words[at:]
    data = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of docs (doc_id, text).

    Each word covered by a window of 20 words that also starts earlier is
    removed. Anchors deal documents' segments out, so that equal windows meet
    in one shard. A segment with a copy or with another content at its anchor
    goes there, each content once; the shard builds an FM-index of them and
    streams them against it. The intervals that matching statistics report are
    removed from the segment itself where they start earlier, and from all
    copies of it, which follow what is reported of their content (segments are
    copies if two 64-bit hashes, of anchor and content, agree).

    A null text has no words; a doc_id that is null comes last; rows that
    repeat a doc_id are documents of their own, ordered as unique_ids says. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = unique_ids(docs, docs.sparkSession)
    facts = shared_segments(rows, _symbols, WINDOW, GRAM, follow=True)
    pieces = residual(rows, facts, WINDOW, _take)

    def runs(piece: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, first place and length of each run of places."""
        order = np.lexsort((place, piece))
        piece, place = piece[order], place[order]
        at = np.flatnonzero(_starts_of_runs(piece, place - np.arange(len(place))))
        return piece[at], place[at], np.diff(np.append(at, len(place)))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        uid, start, anchor, content = (table.column(c).to_numpy() for c in ("uid", "start", "anchor", "content"))
        piece, place, earlier = shard_matches(uid, start, table.column("data").to_pylist())
        p, s, n = runs(piece[earlier], place[earlier])
        q, t, m = runs(piece, place)
        own, all_ = pa.array(np.ones(len(p), bool)), pa.array(np.zeros(len(q), bool))
        return pa.table({
            "own": pa.chunked_array([own, all_]), "uid": np.concatenate([uid[p], uid[q]]), "anchor": np.concatenate([anchor[p], anchor[q]]), "content": np.concatenate([content[p], content[q]]),
            "start": np.concatenate([start[p] + s, t]), "windows": np.concatenate([n, m])})

    reported = save(pieces.groupBy("bucket").applyInArrow(search, "own boolean, uid long, anchor long, content long, start long, windows long"))
    copies = facts.where(F.col("state") == COPY).select("uid", "anchor", "content", F.col("start").alias("base"))
    followed = skew_join(copies, reported.where("not own").drop("own", "uid"), ["anchor", "content"]).select("uid", (F.col("base") + F.col("start")).alias("start"), "windows")
    found = reported.where("own").select("uid", "start", "windows").unionByName(followed)
    schema = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_kept
    finish = _finish if with_kept else lambda *a: _finish(*a)[:3]
    return apply_removals(rows, facts, found, WINDOW, finish, schema)
