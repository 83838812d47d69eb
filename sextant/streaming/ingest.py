"""Structured Streaming: trace ingest with upserted state, event-time windows, bounded latency rings, change watching."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sextant.operators.changes import evict_oldest, upsert_counts
from sextant.operators.runtime import batch_aggregate

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Trace events as a stream of Parquet files; ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windows(stream: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, total by event-time window; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: turns that end after a gap without events."""
    out = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Buckets of the state, by a hash of the symbol: a batch rewrites those that it touches.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, state: str) -> dict[int, list[int]]:
    """Complete versions of the state and the buckets that each replaced (at most BUCKETS)."""
    root, fs = _fs(spark, state)
    found: dict[int, list[int]] = {}
    if fs.exists(root):
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("covers-"):  # covers-<version>-<bucket>.<bucket>...; written after the version itself
                version, _, buckets = name[7:].partition("-")
                found[int(version)] = [int(x) for x in buckets.split(".") if x]
    return found


def _newest(spark: SparkSession, state: str, before: int, buckets: list[int] | None = None) -> DataFrame | None:
    """The state before a batch, or the given buckets of it: of each bucket the newest version."""
    last: dict[int, int] = {}
    for version, covered in sorted(_versions(spark, state).items()):
        if version < before:
            last |= dict.fromkeys(covered, version)
    root, fs = _fs(spark, state)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    paths = [f"{state}/v{v}/bucket={b}" for b, v in sorted(last.items()) if buckets is None or b in buckets]
    there = [p for p in paths if fs.exists(path(p))]
    return spark.read.parquet(*there) if there else None


def _mark(spark: SparkSession, state: str, version: int, buckets: list[int]) -> None:
    """Say that a version is complete, and drop versions of which a newer one has every bucket."""
    root, fs = _fs(spark, state)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for v, covered in _versions(spark, state).items():
        if v == version:  # an earlier try of the same batch
            fs.delete(path(f"{state}/covers-{v}-{'.'.join(map(str, covered))}"), False)
    fs.create(path(f"{state}/covers-{version}-{'.'.join(map(str, buckets))}"), True).close()
    seen: set[int] = set()
    for v, covered in sorted(_versions(spark, state).items(), reverse=True):
        if v < version - 1 and set(covered) <= seen:  # the batch before may be tried again and read what it replaced
            fs.delete(path(f"{state}/v{v}"), True)
            fs.delete(path(f"{state}/covers-{v}-{'.'.join(map(str, covered))}"), False)
        seen |= set(covered) if v < version else set()


def trace_counts(batch: DataFrame) -> DataFrame:
    return batch_aggregate(batch.select(F.col("user_id").alias("symbol_id"), F.col("event_type").alias("source"), F.col("value").alias("duration_ms"), "ts"))


def statement_counts(batch: DataFrame) -> DataFrame:
    """Tables as symbols, of a batch of SQL log lines (value, ts)."""
    from sextant.operators.runtime import sql_tables

    j = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    kept = batch.where(~F.trim("value").rlike(r"^($|#|//)")).select(F.explode(sql_tables(j("sql", "query", "statement"))).alias("symbol_id"), F.lit("sql").alias("source"), j("duration_ms", "mean_ms", "elapsed_ms").cast("double").alias("duration_ms"), "ts")
    return batch_aggregate(kept)


def frame_counts(batch: DataFrame) -> DataFrame:
    """file:function as symbols, of a batch of stack logs (id, text, ts)."""
    from sextant.operators.runtime import stack_frames

    found = stack_frames(batch).join(batch.select("id", "ts"), "id")
    return batch_aggregate(found.select(F.concat_ws(":", "file", "function").alias("symbol_id"), F.lit("stack").alias("source"), F.lit(0.0).alias("duration_ms"), "ts"))


def upsert_batch(batch: DataFrame, batch_id: int, state: str, max_rows: int | None = None, counts: Callable[[DataFrame], DataFrame] = trace_counts) -> None:
    """Merge one batch into the state; batch and stream share it.

    The state lies in BUCKETS buckets. A batch writes the buckets that its
    symbols fall into as a version of its own, named by its number, so a batch
    that is tried again writes the same again; other buckets stay as they are.
    Keeping to max_rows concerns all rows, so then all buckets are written.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("symbol_id"), F.lit(BUCKETS)).cast("int")
    fresh = counts(batch)
    touched = None if max_rows is not None else sorted(r.b for r in fresh.select(bucket.alias("b")).distinct().collect())  # at most BUCKETS
    old = _newest(spark, state, batch_id, touched)
    merged = upsert_counts(old, fresh) if old is not None else fresh
    if max_rows is not None:
        merged = evict_oldest(merged, max_rows, "last_seen", "symbol_id", "source")
    merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/v{batch_id}")
    _mark(spark, state, batch_id, list(range(BUCKETS)) if touched is None else touched)


def ingest(stream: DataFrame, state: str, checkpoint: str, max_rows: int | None = None, counts: Callable[[DataFrame], DataFrame] = trace_counts) -> StreamingQuery:
    """Keep runtime state (symbol_id, source, count, percentiles, first and last seen) up to date from a stream of traces, statements or stacks."""
    return stream.writeStream.foreachBatch(lambda b, i: upsert_batch(b, i, state, max_rows, counts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_of(spark: SparkSession, state: str) -> DataFrame | None:
    return _newest(spark, state, 1 << 62)


def wait_until_fresh(query: StreamingQuery, timeout_ms: int = 500) -> bool:
    """Wait for what has arrived to be worked in, no longer than the limit; whether it was."""
    end = time.monotonic() + timeout_ms / 1000
    while time.monotonic() < end:
        if not query.isActive or not (query.status["isDataAvailable"] or query.status["isTriggerActive"]):
            return True
        time.sleep(0.01)
    return False


class Watchers:
    """One streaming query a watched folder; those that failed are started again, at most `retries` times each."""

    def __init__(self, start: Callable[[str], StreamingQuery], retries: int = 3):
        self.start, self.retries = start, retries
        self.queries: dict[str, StreamingQuery] = {}
        self.failures: dict[str, int] = {}

    def add(self, folder: str) -> None:
        if folder not in self.queries or not self.queries[folder].isActive:
            self.queries[folder] = self.start(folder)

    def remove(self, folder: str) -> None:
        if (q := self.queries.pop(folder, None)) is not None:
            q.stop()

    def tend(self) -> list[str]:
        """Start failed queries again; the folders that were."""
        again = [f for f, q in self.queries.items() if not q.isActive and q.exception() is not None and self.failures.get(f, 0) < self.retries]
        for f in again:
            self.failures[f] = self.failures.get(f, 0) + 1
            self.queries[f] = self.start(f)
        return again

    def stop(self) -> None:
        for f in list(self.queries):
            self.remove(f)


def latency_ring(stream: DataFrame, keep: int = 512) -> DataFrame:
    """tool, n, p50, p95, max_ms over each tool's last `keep` calls, kept in state between batches."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        ring = (ring + rows["value"].tolist())[-keep:]
        state.update((ring,))
        s, n = sorted(ring), len(ring)
        yield pd.DataFrame({"tool": [key[0]], "n": [n], "p50": [s[n // 2]], "p95": [s[min(n - 1, int(0.95 * n))]], "max_ms": [s[-1]]})

    return stream.groupBy("event_type").applyInPandasWithState(update, "tool string, n long, p50 double, p95 double, max_ms double", "ring array<double>", "update", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files of a folder as they come: path, time of change, content."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return raw.select("path", "modificationTime", F.decode("content", "UTF-8").alias("content"))
