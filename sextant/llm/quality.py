"""Quality classifier: attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm.common import lean, small_batches

#: Bytes of a passage; a document's passages are equally long.
PASSAGE = 512
#: Byte classes: lower, upper, digit, space, newline, stop, mark, symbol, bar, quote or bracket, high byte, other.
CLASSES = 12
HASHED = 16
LAGS = (1, 2, 3, 4)
FEATURES = CLASSES + HASHED + len(LAGS) + 4
SCORE = "__quality_score"


def _byte_table() -> np.ndarray:
    t = np.full(256, 11, np.uint8)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    for k, chars in ((3, b" \t\r\x0b\x0c"), (4, b"\n"), (5, b".,;:"), (6, b"!?"), (7, b"#*$%&<>"), (8, b"|"), (9, b"\"'()[]{}")):
        t[list(chars)] = k
    t[128:] = 10
    return t


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and each text's first passage's row. An empty text has one passage of zeros."""
    data = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    size = np.array([len(x) for x in data], np.int64)
    count = np.maximum(1, size // PASSAGE)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    n = int(count.sum())
    out = np.zeros((n, FEATURES), np.float32)
    arr = np.frombuffer(b"".join(data), np.uint8)
    if not len(arr):
        return out, first
    doc = np.repeat(np.arange(len(data)), size)
    place = np.arange(len(arr)) - np.repeat(np.cumsum(size) - size, size)
    row = first[doc] + place * count[doc] // size[doc]
    kind = _byte_table()[arr]
    length = np.bincount(row, minlength=n).astype(np.float64)
    out[:, :CLASSES] = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(length, 1)[:, None]
    inside = (kind != 3) & (kind != 4)
    begin = inside & ~(np.concatenate([[False], inside[:-1]]) & (place > 0))
    at = np.flatnonzero(begin)
    if len(at):
        word = np.cumsum(begin) - 1
        letters = np.flatnonzero(inside)
        mix = (arr[letters].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        turn = (letters - at[word[letters]]).astype(np.uint64)
        mix = (mix ^ (mix >> np.uint64(29))) * (turn * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1))
        edges = np.searchsorted(letters, at)
        h = np.add.reduceat(mix, edges)
        wlen = np.diff(np.append(edges, len(letters)))
        wrow, wdoc = row[at], doc[at]
        words = np.maximum(np.bincount(wrow, minlength=n), 1)
        out[:, CLASSES : CLASSES + HASHED] = np.bincount(wrow * HASHED + (h >> np.uint64(60)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) / words[:, None]
        k = CLASSES + HASHED
        for j, lag in enumerate(LAGS):
            same = (h[lag:] == h[:-lag]) & (wdoc[lag:] == wdoc[:-lag])
            out[:, k + j] = np.bincount(wrow[lag:], weights=same, minlength=n) / words
        k += len(LAGS)
        mean = np.bincount(wrow, weights=wlen, minlength=n) / words
        out[:, k] = mean / 10
        out[:, k + 1] = np.sqrt(np.maximum(np.bincount(wrow, weights=wlen.astype(float) ** 2, minlength=n) / words - mean**2, 0)) / 10
        out[:, k + 2] = np.bincount(wrow, weights=kind[at] == 1, minlength=n) / words
    out[:, FEATURES - 1] = np.log1p(length) / 10
    return out, first


@dataclass
class Model:
    """mean, scale: of features. The net: see forward. const: the score where there is nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    net: dict[str, np.ndarray]
    const: float | None = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.const is not None:
            return np.full(len(texts), self.const)
        x, first = passages(texts)
        return forward(self.net, (x - self.mean) / self.scale, first)[0]


def _sum(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(a, first, axis=0)


def forward(net: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of bags of rows: h encodes a passage, gated attention weighs it in its bag, the weighted sum is scored."""
    size = np.diff(np.append(first, len(x)))
    h = np.tanh(x @ net["W"] + net["b"])
    t, g = np.tanh(h @ net["V"]), 1 / (1 + np.exp(-(h @ net["U"])))
    e = (t * g) @ net["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    a = e / np.repeat(_sum(e, first), size)
    z = _sum(a[:, None] * h, first)
    logit = z @ net["c"] + net["d"][0]
    return 1 / (1 + np.exp(-logit)), (size, h, t, g, a, z)


def _gradients(net: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, (size, h, t, g, a, z) = forward(net, x, first)
    up = (p - y) / len(y)
    dz = up[:, None] * net["c"]
    dz_row = np.repeat(dz, size, axis=0)
    da = (dz_row * h).sum(1)
    de = a * (da - np.repeat(_sum(a * da, first), size))
    dt, dg = de[:, None] * net["w"] * g * (1 - t * t), de[:, None] * net["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz_row + dt @ net["V"].T + dg @ net["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": ((t * g) * de[:, None]).sum(0), "c": z.T @ up, "d": np.array([up.sum()])}


def fit_bags(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Train on bags: rows x, each bag's first row, labels in 0 to 1."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), {}, float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    near = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    net = {"W": near(FEATURES, hidden), "b": np.zeros(hidden), "V": near(hidden, gate), "U": near(hidden, gate), "w": near(gate), "c": near(hidden), "d": np.zeros(1)}
    m, v = ({k: np.zeros_like(p) for k, p in net.items()} for _ in range(2))
    step = 0
    ends = np.append(first[1:], len(x))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 128)):
            rows = np.concatenate([np.arange(first[i], ends[i]) for i in part])
            size = ends[part] - first[part]
            grads = _gradients(net, x[rows], np.cumsum(size) - size, y[part])
            step += 1
            lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k, grad in grads.items():
                grad = grad + decay * net[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                net[k] = net[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, net)


def fold() -> Column:
    """crc32 of doc_id as text, mod 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model:
    """Fit on at most `sample` labelled documents whose fold isn't 0, with all their passages.

    The sample is those with the smallest hashes of doc_id. Null labels are
    left out; a document labelled more than once has the mean of its labels.
    """
    known = labels.where("quality is not null and doc_id is not null").where(fold() != 0).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), F.col("id") == known.doc_id).select("id", "text", "y")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, _ = passages([batch.column(1)[i].as_py()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([x.tobytes()], pa.binary())], ["id", "y", "x"])

    got = sorted(rows.mapInArrow(lean(encode), "id long, y double, x binary").collect(), key=lambda r: (r.id, r.x))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    size = np.array([len(b) for b in bags], np.int64)
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    return fit_bags(x, np.cumsum(size) - size, np.array([r.y for r in got], float))


def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.const is not None:
            return np.full(len(texts), self.const)
        x, first = passages(texts)
        return forward(self.net, (x - self.mean) / self.scale, first)[0]


def _sum(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(a, first, axis=0)


def forward(net: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of bags of rows: h encodes a passage, gated attention weighs it in its bag, the weighted sum is scored."""
    size = np.diff(np.append(first, len(x)))
    h = np.tanh(x @ net["W"] + net["b"])
    t, g = np.tanh(h @ net["V"]), 1 / (1 + np.exp(-(h @ net["U"])))
    e = (t * g) @ net["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    a = e / np.repeat(_sum(e, first), size)
    z = _sum(a[:, None] * h, first)
    logit = z @ net["c"] + net["d"][0]
    return 1 / (1 + np.exp(-logit)), (size, h, t, g, a, z)


def _gradients(net: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, (size, h, t, g, a, z) = forward(net, x, first)
    up = (p - y) / len(y)
    dz = up[:, None] * net["c"]
    dz_row = np.repeat(dz, size, axis=0)
    da = (dz_row * h).sum(1)
    de = a * (da - np.repeat(_sum(a * da, first), size))
    dt, dg = de[:, None] * net["w"] * g * (1 - t * t), de[:, None] * net["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz_row + dt @ net["V"].T + dg @ net["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": ((t * g) * de[:, None]).sum(0), "c": z.T @ up, "d": np.array([up.sum()])}


def fit_bags(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Train on bags: rows x, each bag's first row, labels in 0 to 1."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), {}, float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    near = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    net = {"W": near(FEATURES, hidden), "b": np.zeros(hidden), "V": near(hidden, gate), "U": near(hidden, gate), "w": near(gate), "c": near(hidden), "d": np.zeros(1)}
    m, v = ({k: np.zeros_like(p) for k, p in net.items()} for _ in range(2))
    step = 0
    ends = np.append(first[1:], len(x))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 128)):
            rows = np.concatenate([np.arange(first[i], ends[i]) for i in part])
            size = ends[part] - first[part]
            grads = _gradients(net, x[rows], np.cumsum(size) - size, y[part])
            step += 1
            lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k, grad in grads.items():
                grad = grad + decay * net[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                net[k] = net[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, net)


def fold() -> Column:
    """crc32 of doc_id as text, mod 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, passages_each: int = 48) -> Model:
    """Fit on at most about `sample` labelled documents whose fold isn't 0.

    The sample is those with the smallest hashes of doc_id; a document gives
    at most passages_each passages, evenly spread. Null labels are left out;
    a document labelled more than once has the mean of its labels.
    """
    known = labels.where("quality is not null and doc_id is not null").where(fold() != 0).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    part = sample / max(sample, known.count())
    known = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).limit(2 * sample)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), F.col("id") == known.doc_id).select("id", "text", "y")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, first = passages(batch.column(1).to_pylist())
            ends = np.append(first[1:], len(x))
            kept = [x[np.unique(np.linspace(a, b - 1, min(passages_each, b - a)).astype(int))].tobytes() for a, b in zip(first, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(kept, pa.binary())], ["id", "y", "x"])

    got = sorted(rows.mapInArrow(lean(encode), "id long, y double, x binary").collect(), key=lambda r: (r.id, r.x))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    size = np.array([len(b) for b in bags], np.int64)
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    return fit_bags(x, np.cumsum(size) - size, np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column of scores, from the text alone; null and empty texts are scored as one empty passage.

    Every row has a score between 0 and 1; rows with equal texts have equal
    scores; an empty table gives no rows.
    """
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, lo = batch.column(at).to_pylist(), [], 0
            while lo < len(texts):  # so that long texts don't pile up
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 1 << 20):
                    size += len(texts[hi] or "")
                    hi += 1
                found.append(model.scores(texts[lo:hi]))
                lo = hi
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(values, 0, 1))], [*batch.schema.names, SCORE])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for docs (doc_id, text), learnt from labels (doc_id, quality)."""
    docs = docs.select("doc_id", "text")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold() == 0).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))
