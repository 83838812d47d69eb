"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, star-shaped edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm.common import free_name, has_odd_ids, lean, save, skew_join, small_batches, unique_ids
from sextant.llm.graphs import components

SHINGLE = 5
#: Bands of ROWS bins each. A pair of similarity 0.75 meets in no band with a probability of 2.5e-7.
BANDS, ROWS = 40, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of five lower-cased words."""

    def __init__(self, size: int = SHINGLE, words: int = 1 << 18):
        import xxhash

        class Hashes(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= words:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.size, self.known = size, Hashes()
        self.factors = _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes(words)
        n = len(h) - self.size + 1
        if n < 1:  # the whole sequence is one shingle, unlike any of full size
            return _mix(np.array([(h * self.factors[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
        total = h[:n] * self.factors[0]
        for j in range(1, self.size):
            total = total + h[j : j + n] * self.factors[j]
        return np.unique(_mix(total))


class Signer:
    """Bucket keys of a set: a hash of each band's bins.

    The set is permuted once and split into as many bins as there are rows of
    all bands; a bin's value is its smallest hash. An empty bin takes the value
    of the first full one in an order of its own, so bins stay independent.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 5):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.detour = np.stack([rng.permutation(self.bins) for _ in range(self.bins)])
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], np.uint64)
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.factors = _mix(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        first = np.searchsorted(hashes, self.edges)
        full = first < np.append(first[1:], len(hashes))
        values = hashes[np.minimum(first, len(hashes) - 1)]
        if not full.all():
            donor = self.detour[np.arange(self.bins), full[self.detour].argmax(axis=1)]
            values = np.where(full, values, values[donor])
        return _mix((values.reshape(self.bands, self.rows) * self.factors).sum(axis=1) + self.salt).view(np.int64)


SIGNED = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType()))])


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    shingle, sign = Shingler(), Signer(bands, rows)
    for batch in batches:
        n, key, buckets = [], [], []
        for text in batch.column(2).to_pylist():
            hashes = shingle(text)
            n.append(len(hashes))
            key.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            buckets.append(sign(hashes) if len(hashes) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["uid", "doc_id", "n", "key", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["uid", "set"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            good.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of each set: (uid, n, label, token)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()]
            size = [len(x) for x in sets]
            cols = [pa.array(np.repeat(part.column(i).to_numpy(), size)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(sets))], ["uid", "n", "label", "token"])


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): candidates of different labels among sets (uid, n, label, set), a superset of all pairs of similarity 0.75 or more.

    An exact prefix filter. Hashes stand in one order for all sets: first
    those that only sets of one label hold, then the rarer ones first. Of two
    sets that similar, the one that is not the larger has a shared hash among
    its first n - ceil(6n/7) + 1, the other among its first n - ceil(3n/4) + 1,
    and enough may follow the first shared one. Texts that share passages but
    are not similar differ in the rare hashes that come first, so a family of
    them makes hardly a candidate, however large it is. Hashes of one label
    are only counted, never joined.
    """
    rows = sets.select("uid", "n", "label", "set").mapInArrow(lean(_tokens), "uid long, n long, label long, token long")
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token", "df")
    met = skew_join(rows, held, ["token"])
    listed = met.groupBy("uid").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    # what only one label holds comes before, so the first of t has the place n - size(t)
    listed = listed.withColumn("skip", F.col("n") - F.size("t")).withColumn("probe", F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1)
    first = F.slice("t", 1, F.greatest(F.lit(0), F.col("probe") - F.col("skip")).cast("int"))
    prefix = save(listed.where("skip < probe").select("uid", "n", "label", "skip", F.posexplode(first).alias("i", "x")).select("uid", "n", "label", (F.col("skip") + F.col("i")).alias("pos"), F.col("x.token").alias("token")))
    side = lambda mark: prefix.select(*[F.col(c).alias(c + mark) for c in ("uid", "n", "label", "pos")], "token")
    # the smaller set (of equal ones, that with the smaller uid) needs a shared hash in its shorter prefix
    low = side("a").where("posa < na - ceil(na * 6 / 7) + 1").withColumn("h", F.xxhash64(F.lit(23), "token"))
    high = side("b").withColumn("h", F.xxhash64(F.lit(23), "token"))
    on = [low.h == high.h, low.token == high.token, F.col("labela") != F.col("labelb"), F.struct("na", "uida") < F.struct("nb", "uidb"), F.expr("100 * na >= 75 * nb"), F.expr("175 * least(na - posa, nb - posb) >= 75 * (na + nb)")]
    return low.join(high, on).select(F.least("uida", "uidb").alias("a"), F.greatest("uida", "uidb").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, first of docs (doc_id, text); other columns are ignored.

    Documents with equal sets form a class; its first document (smallest
    doc_id) stands for it. Classes meet in the buckets of their bands. In each
    bucket every class gets an edge to the smallest one only, and edges are
    confirmed on full sets. A star can miss a link of two classes that both
    differ from the hub; it would join two components of a bucket. So classes
    of buckets that still hold several components go through an exact prefix
    filter (prefix_pairs), and what it leaves is confirmed on full sets too:
    no link of two classes that share a band is lost, and a family without
    links is not paired off.

    Sets are of 64-bit hashes of shingles, and sets are equal if a 128-bit
    digest of them is. A document without words has an empty set, is linked
    with nothing and kept. Rows that repeat a doc_id are documents of their
    own, ordered as unique_ids says; `first` marks one row of each component.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = unique_ids(docs, docs.sparkSession)
    signed = save(rows.select("uid", "doc_id", "text").mapInArrow(lean(lambda x: _sign(x, bands, band_rows)), SIGNED))
    classes = signed.where("key is not null").groupBy("key").agg(F.min("uid").alias("rep"))
    member = save(skew_join(signed.where("key is not null").select("uid", "key"), classes, ["key"]).select("uid", "rep"))
    reps = signed.join(member.where("uid = rep").select("uid"), "uid", "left_semi")
    rowed = reps.select("uid", "n", F.explode("buckets").alias("bucket"))
    shared = rowed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("uid").alias("hub")).where("m > 1")
    buckets = save(skew_join(rowed, shared.select("bucket", "hub"), ["bucket"]))
    wanted = buckets.select("uid").distinct()
    sets = save(rows.select("uid", "text").join(wanted.hint("shuffle_hash"), "uid", "left_semi").mapInArrow(lean(_sets), "uid long, set binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = skew_join(pairs, sets.select(F.col("uid").alias("a"), F.col("set").alias("x")), ["a"])
        two = skew_join(one, sets.select(F.col("uid").alias("b"), F.col("set").alias("y")), ["b"])
        return save(two.select("a", "b", "x", "y").mapInArrow(lean(_confirm), "a long, b long"))

    hubs = buckets.where("uid = hub").select("bucket", F.col("uid").alias("a"), F.col("n").alias("na"))
    stars = skew_join(buckets.where("uid <> hub").select("bucket", F.col("uid").alias("b"), F.col("n").alias("nb")), hubs, ["bucket"])
    edges = confirmed(stars.where("100 * least(na, nb) >= 75 * greatest(na, nb)").select("a", "b").distinct())
    labels = components(edges)
    named = buckets.select("bucket", "uid", "n").join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    open_ = skew_join(named, several, ["bucket"]).select("uid", "n", "label").distinct()
    more = confirmed(prefix_pairs(save(open_.join(sets, "uid"))))
    if not more.isEmpty():
        # a component is one node now
        known = labels.withColumnRenamed("label", "rep")
        at = lambda df, c: df.join(known.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("rep", c)).drop("rep")
        joined = components(at(at(more, "a"), "b")).select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = save(labels.join(joined, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
                      .unionByName(joined.select(F.col("label").alias("node"), F.col("top").alias("label")).join(labels.select("node"), "node", "left_anti")))
    final = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("uid", F.coalesce("label", "rep").alias("label"))
    out = signed.select("uid", "doc_id", "n").join(final, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    names = signed.select(F.col("uid").alias("label"), F.col("doc_id").alias("component_id"))
    out = skew_join(out, names, ["label"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), (F.col("uid") == F.col("label")).alias("first"), "uid")


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that near_duplicates doesn't keep: one row of each component stays, with all its columns.

    Where a doc_id is null or repeated, rows are told apart by a number that is
    written down first, in a column whose name docs doesn't have.
    """
    key = "doc_id"
    if has_odd_ids(docs):
        key = free_name(docs, "row")
        docs = save(docs.withColumn(key, F.monotonically_increasing_id()))
    found = near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"))
    gone = found.where(~F.col("first")).select(F.col("doc_id").alias(key))
    out = docs.join(gone, key, "left_anti")
    return out if key == "doc_id" else out.drop(key)
