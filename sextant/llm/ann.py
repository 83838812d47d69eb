"""Approximate nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import lean, save

#: Base rows and queries that meet at once.
BLOCK = 4096
#: Rows a part is meant to have, so that parts grow with the table; the fewest and the most parts; sample rows a part.
PART_ROWS, LEAST_PARTS, MOST_PARTS, PART_SAMPLE = 2048, 16, 2048, 32


@dataclass
class Router:
    """dim: of vectors. probes: parts a query goes to. W, b, V, c: the classifier's two layers (none with one part)."""

    dim: int
    parts: int
    probes: int
    net: tuple[np.ndarray, ...] | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.zeros((len(x), 1))
        W, b, V, c = self.net
        return np.maximum(_unit(x) @ W + b, 0) @ V + c

    def route(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and vectors of a list column's usable rows: not null, of the dimension, finite, not zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.nan_to_num(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    if dim is None:
        dim = Counter(size[size > 0].tolist()).most_common(1)[0][0] if (size > 0).any() else 0
    rows = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
    flat = pa.compute.list_flatten(col.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = np.asarray(flat, np.float64).reshape(len(rows), dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k rows of largest inner product, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """A part for each node: halved along principal directions, then moved to where most neighbours are while there is room."""
    part = np.zeros(len(x), np.int64)
    done = 1
    while done < parts:
        for p in range(done):
            at = np.flatnonzero(part == p)
            centred = x[at] - x[at].mean(0)
            axis = np.linalg.svd(centred[:2000], full_matrices=False)[2][0] if len(at) > 1 else np.ones(x.shape[1])
            order = at[np.argsort(centred @ axis, kind="stable")]
            part[order[len(order) // 2 :]] = p + done
        done *= 2
    room = int(np.ceil(slack * len(x) / parts))
    src = np.repeat(np.arange(len(x)), graph.shape[1])
    a, b = np.concatenate([src, graph.ravel()]), np.concatenate([graph.ravel(), src])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        votes = np.bincount(a * parts + part[b], minlength=len(x) * parts).reshape(len(x), parts).astype(float)
        gain = votes - votes[np.arange(len(x)), part][:, None]
        best = gain.argmax(1)
        value = gain[np.arange(len(x)), best] + rng.random(len(x)) * 0.01
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-value, kind="stable"):
            if value[i] < 1:
                break
            if size[best[i]] < room and rng.random() < 0.7:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int = 16, k: int = 20, recall: float = 0.93, hidden: int = 128, epochs: int = 40, seed: int = 11) -> Router:
    """Learn a router from sample vectors; the number of probes is the least with which the sample's recall at k reaches `recall`.

    Parts must be a power of two; with fewer than 8 * parts vectors there is one part, and search is exact.
    """
    n, dim = x.shape
    if n < 8 * parts or parts < 2:
        return Router(dim, 1, 1)
    graph = neighbour_graph(x, k)
    part = balanced_parts(x, graph, parts)
    goal = np.bincount(np.repeat(np.arange(n), k) * parts + part[graph.ravel()], minlength=n * parts).reshape(n, parts) * 0.5 / k
    goal[np.arange(n), part] += 0.5
    rng, u = np.random.default_rng(seed), _unit(x)
    net = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(n), max(1, n // 128)):
            h = np.maximum(u[at] @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - goal[at]) / len(at)
            dh = (dz @ net[2].T) * (h > 0)
            grads, t = [u[at].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)], t + 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * net[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                net[i] = net[i] - 0.005 * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(dim, parts, parts, tuple(net))
    order = router.route(x, parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(parts), order.shape), axis=1)
    home = order[:, 0]  # where the base rows are kept
    needed = rank[np.arange(n)[:, None], home[graph]]
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= recall:
            break
    router.probes = probes
    return router


def train(vectors: DataFrame, parts: int | None = None, **how) -> Router:
    """Fit on a bounded sample of (vec_id, embedding): those with the smallest hashes of vec_id, 32 a part, 4,096 at least and 65,536 at most.

    Parts: the power of two that makes them of 1,024 to 2,048 rows, from 16 to 2,048.
    """
    n = vectors.count()
    if parts is None:
        parts = LEAST_PARTS
        while parts < MOST_PARTS and parts * PART_ROWS < n:
            parts *= 2
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding", F.xxhash64(F.lit(4), "vec_id").alias("h"))
    table = rows.orderBy("h", "vec_id").limit(max(4096, PART_SAMPLE * parts)).select("vec_id", "embedding").toArrow().sort_by("vec_id")
    _, x = matrix(table.column("embedding"))
    return fit_router(x, parts=parts, **how) if len(x) else Router(0, 1, 1)


def nearest(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, qrow: int, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and exact scores of a query's k nearest of a block, ties to smaller ids; scores are preliminary.

    Exact scores are row sums of one fixed order, so equal vectors tie exactly
    wherever they are.
    """
    scores = np.where(rows == qrow, -np.inf, scores)
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth - 1e-9 * max(1.0, abs(kth)) if np.isfinite(kth) else np.isfinite(scores))
    else:
        at = np.flatnonzero(np.isfinite(scores))
    exact = (x[at] * q).sum(axis=1)
    best = np.lexsort((ids[at], -exact))[:k]
    return at[best], exact[best]


def search(vectors: DataFrame, is_query: Column, k: int = 20, router: Router | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that is_query marks, the k other rows of largest inner product found.

    vectors: (vec_id, embedding); other columns are ignored. Every row is kept
    in its most probable part; a query goes to its most probable parts, as
    many more as it takes to hold k + 1 rows, is scored there against every row, in blocks, and the blocks' best meet in a
    last ranking. Parts of any size are split into blocks by a hash, so one
    vector that a third of the rows share is spread like any other; a part's
    rows are sent again for every further block of queries that come to it,
    those of other parts aren't.

    Null, zero and non-finite vectors, those with null components and those of
    another length than most of the sample's take no part. Rows are told apart
    by their place in the table: rows that repeat a vec_id are candidates for
    each other, and each is a query. A null vec_id is no query and, as
    candidate, sorts after others that tie. An empty table gives no rows.
    """
    router = router or train(vectors)
    dim, parts = router.dim, router.parts
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(1), dim)
            if len(at):
                kept = batch.take(pa.array(at))
                order = router.route(x, parts).astype(np.int32)
                asks = kept.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(3), kept.column(2), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(order[:, 0]), pa.array([o if q else None for o, q in zip(order, asks, strict=True)], pa.list_(pa.int32()))],
                    ["vec_id", "row", "query", "vec", "part", "route"])

    placed = save(rows.mapInArrow(lean(place), "vec_id long, row long, query boolean, vec binary, part int, route array<int>"))
    counts = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as parts
    blocks = F.array(*[F.lit(-(-counts.get(p, 0) // block)) for p in range(parts)])
    sizes = F.array(*[F.lit(counts.get(p, 0)).cast("long") for p in range(parts)])
    before = lambda i: F.aggregate(F.slice("route", 1, i), F.lit(0).cast("long"), lambda n, p: n + F.get(sizes, p))
    probes = F.filter("route", lambda p, i: (i < router.probes) | (before(i) <= k))
    asked = {r.p: r.n for r in placed.where("query").select(F.explode(probes).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    turns = F.array(*[F.lit(max(1, -(-asked.get(p, 0) // block))) for p in range(parts)])
    share = lambda c, salt, n: F.pmod(F.xxhash64(F.lit(salt), c), n).cast("int")
    base = placed.select("vec_id", "row", "vec", "part", share("row", 1, F.get(blocks, F.col("part"))).alias("sub"), F.explode(F.sequence(F.lit(0), F.get(turns, F.col("part")) - 1)).alias("turn"))
    queries = placed.where("query").select(F.col("vec_id").alias("query_id"), F.col("row").alias("qrow"), F.col("vec").alias("qvec"), F.explode(probes).alias("qpart"))
    queries = queries.where(F.get(blocks, F.col("qpart")) > 0).withColumn("qturn", share("qrow", 2, F.get(turns, F.col("qpart"))))
    queries = queries.withColumn("qsub", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("qpart")) - 1)))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "qrow": [], "vec_id": [], "row": [], "score": []}
        if left.num_rows and right.num_rows:
            x = np.frombuffer(b"".join(left.column("vec").to_pylist()), np.float64).reshape(-1, dim)
            rows = left.column("row").to_numpy()
            ids = left.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            q = np.frombuffer(b"".join(right.column("qvec").to_pylist()), np.float64).reshape(-1, dim)
            qids, qrows = right.column("query_id").to_numpy(), right.column("qrow").to_numpy()
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ x.T
                for i in range(len(s)):
                    at, exact = nearest(x, ids, rows, q[lo + i], qrows[lo + i], s[i], k)
                    out["query_id"].append(np.full(len(at), qids[lo + i]))
                    out["qrow"].append(np.full(len(at), qrows[lo + i]))
                    out["vec_id"].append(ids[at])
                    out["row"].append(rows[at])
                    out["score"].append(exact)
        made = {c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64) for c, v in out.items()}
        return pa.table(made)

    found = base.groupBy("part", "sub", "turn").cogroup(queries.groupBy("qpart", "qsub", "qturn")).applyInArrow(meet, "query_id long, qrow long, vec_id long, row long, score double")
    order = Window.partitionBy("qrow").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    none = F.lit((1 << 63) - 1)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != none, F.col("vec_id")).alias("vec_id"), "score")
