"""What several corpus operators share: scratch tables, joins that bear hot keys, row identity."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the operators' contracts have it: bytes.split() cuts at exactly these bytes too.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join with at most this many rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (local tests) the warehouse folder is used.
    The folder is removed when the driver's JVM ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:16]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def trim() -> None:
    """Give memory that a finished task used back to the system: a Python worker outlives its tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, a function of batches for mapInArrow, with trim() after it."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def save(df: DataFrame) -> DataFrame:
    """Write df as a scratch table and read it again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """df itself if it only scans, filters and projects, so that rows have the same place each time it runs; otherwise df written down."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    names = {line.lstrip(" :+-").split(" ")[0].split("(")[0] for line in plan.splitlines() if line.strip()}
    return df if names <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "Range"} else save(df)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, a small saved table, has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def narrow(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A saved table of few rows (counted: narrow keys, not texts) as one partition, so that steps over it shuffle nothing; a larger one as it is."""
    return df.coalesce(1) if fits_broadcast(df, rows) else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on, unless the session has another setting than Spark's default: they hold whole texts, in the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """df joined with a saved table of one row a key: broadcast if its counted rows fit, else by skew_join."""
    if fits_broadcast(small):
        return df.join(F.broadcast(small), on, how)
    return skew_join(df, small, on, how)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that AQE can split where one key holds a large share of left's rows.

    The hash column makes both sides shuffle anew for the join: a side that an
    aggregation has already dealt out by the key could not be split.
    """
    h = "__join_hash"
    left = left.withColumn(h, F.xxhash64(F.lit(17), *on))
    right = right.withColumn(h, F.xxhash64(F.lit(17), *on))
    return left.join(right, [h, *on], how).drop(h)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def has_odd_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether an id is null or repeated."""
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty()


def unique_ids(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc_id, text): uid orders rows by doc_id.

    uid is doc_id itself while it is neither null nor repeated. Otherwise rows
    are written down once and numbered in the order of doc_id (null last), then
    of the text's digest (null first); equal rows in any order. Only ids and
    digests are sorted, and numbers follow the order without being gapless.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not has_odd_ids(docs):
        return docs.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    rows = save(docs.withColumn("row", F.monotonically_increasing_id()))
    keys = rows.select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("digest").asc_nulls_first(), F.col("row").asc()]
    numbered = save(keys.sort(*order).select("row", F.monotonically_increasing_id().alias("uid")))
    return save(rows.join(numbered, "row").select("uid", "doc_id", "text"))
