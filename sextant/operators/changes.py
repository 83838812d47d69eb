"""Change analytics: diffs, overlays, incremental saves, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change of two tables (key, content): added, removed or modified; one full outer join."""
    both = before.select("key", F.col("content").alias("old"), F.lit(True).alias("was")).join(after.select("key", F.col("content").alias("new"), F.lit(True).alias("is")), "key", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.withColumn("change", change).where("change is not null").select("key", "change")


def renamed(before: DataFrame, after: DataFrame) -> DataFrame:
    """old_key, new_key of removed and added keys that share a content no other removed or added key has."""
    gone, come = before.join(after, "key", "left_anti"), after.join(before, "key", "left_anti")
    once = lambda df, name: df.groupBy("content").agg(F.min("key").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return once(gone, "old_key").join(once(come, "new_key"), "content").select("old_key", "new_key")


def hash_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, state of (path, hash): new, changed or deleted; a stored null hash counts as absent."""
    both = stored.where("hash is not null").select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("state", state).where("state is not null").select("path", "state")


def overlay(base: DataFrame, delta: DataFrame, key: str = "file") -> DataFrame:
    """base without the keys that delta (key, action, ...) changes or deletes, and delta's rows that it adds or changes."""
    kept = base.join(delta.select(key).distinct(), key, "left_anti")
    return kept.unionByName(delta.where("action <> 'delete'").select(*base.columns))


def replace_files(stored: DataFrame, fresh: DataFrame, key: str = "file") -> DataFrame:
    """stored with all rows of fresh's files replaced."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*stored.columns))


def freshness(stored_hash: Column, current_hash: Column, modified: Column, indexed: Column, slack_seconds: float = 1.0) -> Column:
    """stale_index if hashes differ, edited_uncommitted if modified over a second after indexing, else fresh."""
    return F.when(~stored_hash.eqNullSafe(current_hash), "stale_index").when(modified.cast("double") > indexed.cast("double") + slack_seconds, "edited_uncommitted").otherwise("fresh")


def upsert_counts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Runtime state merged with a batch, both (symbol_id, source, count, p50_ms, p95_ms, first_seen, last_seen).

    Counts add up, percentiles are the batch's, first_seen stays, last_seen moves.
    """
    keys = ["symbol_id", "source"]
    old = state.select(*keys, *[F.col(c).alias(f"o_{c}") for c in state.columns if c not in keys])
    both = old.join(batch, keys, "full")
    return both.select(
        *keys, (F.coalesce("o_count", F.lit(0)) + F.coalesce("count", F.lit(0))).alias("count"), F.coalesce("p50_ms", "o_p50_ms").alias("p50_ms"), F.coalesce("p95_ms", "o_p95_ms").alias("p95_ms"),
        F.coalesce("o_first_seen", "first_seen").alias("first_seen"), F.coalesce("last_seen", "o_last_seen").alias("last_seen"))


def evict_oldest(state: DataFrame, most: int, seen: str = "last_seen", *ties: str) -> DataFrame:
    """The newest `most` rows: a top-k, no global window."""
    return state.orderBy(F.desc(seen), *ties).limit(most)
