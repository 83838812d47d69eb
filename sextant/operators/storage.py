"""Indexes as partitioned tables: save, load, deltas, embeddings, seats, ledgers; and compact encodings of tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_index(tables: dict[str, DataFrame], root: str, repo: str) -> None:
    """Write an index's tables (symbols, imports, sections, ...) as partitions repo= of one Parquet table each; the repository's former rows go, others stay."""
    for name, df in tables.items():
        writer = df.withColumn("repo", F.lit(repo)).write.mode("overwrite").partitionBy("repo").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{root.rstrip('/')}/{name}")


def load_index(spark: SparkSession, root: str, name: str, repo: str | None = None) -> DataFrame:
    """A table of an index, of one repository (only its partition is read) or all."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return df if repo is None else df.where(F.col("repo") == repo)


def delete_index(spark: SparkSession, root: str, repo: str, names: list[str]) -> None:
    """Remove a repository's partitions."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}/repo={repo}")
        path.getFileSystem(conf).delete(path, True)


def branch_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, action, hash: what a branch changes against its base, from (file, hash) tables."""
    both = before.select("file", F.col("hash").alias("was")).join(after.select("file", F.col("hash").alias("now")), "file", "full")
    action = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "delete").when(F.col("was") != F.col("now"), "modify")
    return both.select("file", action.alias("action"), F.col("now").alias("hash")).where("action is not null")


def save_branch_delta(delta: DataFrame, root: str, repo: str, branch: str) -> None:
    df = delta.withColumns({"repo": F.lit(repo), "branch": F.lit(branch)})
    df.write.mode("overwrite").partitionBy("repo", "branch").option("partitionOverwriteMode", "dynamic").parquet(f"{root.rstrip('/')}/deltas")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys new doesn't have, and all of new: an embedding store's update, one row a key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def missing_embeddings(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a cache (content_hash, vec) has for rows (id, content_hash), and the distinct contents that still have to be encoded."""
    found = rows.join(cache, "content_hash").select("id", "vec")
    return found, rows.select("content_hash").distinct().join(cache.select("content_hash"), "content_hash", "left_anti")


def seat_report(seats: DataFrame, reports: DataFrame) -> DataFrame:
    """org, seat, day, tokens, calls: reports added to what is known of their (org, seat, day)."""
    return seats.unionByName(reports).groupBy("org", "seat", "day").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))


def append_ledger(events: DataFrame, root: str) -> None:
    """Append ranking events as day partitions; nothing that is there is read or rewritten."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(root)


def session_stats(events: DataFrame, cost_per_million: float = 15.0) -> DataFrame:
    """session, calls, tokens_saved, cost_avoided of events (session, saved): sums a session, dollars at 6 places."""
    per = events.groupBy("session").agg(F.count(F.lit(1)).alias("calls"), F.sum("saved").alias("tokens_saved"))
    return per.withColumn("cost_avoided", F.round(F.col("tokens_saved") / 1e6 * cost_per_million, 6))


# ---- compact encodings ---------------------------------------------------------------------


def size_gate(json_bytes: Column, compact_bytes: Column, least: float = 0.15) -> Column:
    """Whether a compact form saves at least such a share of the JSON's bytes."""
    return F.when(json_bytes > 0, 1 - compact_bytes / json_bytes >= F.lit(least)).otherwise(F.lit(False))


def encode_rows(rows: DataFrame, columns: list[str], interned: list[str], least_uses: int = 2, least_saved: int = 1) -> tuple[DataFrame, DataFrame]:
    """(line) and (code, value): rows as lines of tab-separated fields, values that are used often enough in interned columns as @code.

    A value earns a code if it is used least_uses times and the codes save
    least_saved characters. Codes number the values by use, then by value.
    Nulls are empty, booleans T and F; tabs, line ends and backslashes are
    escaped, and a leading @ or @@ of a plain value doubled.
    """
    used = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in interned])).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    worth = used.where((F.col("n") >= least_uses) & ((F.length("value") - 3) * F.col("n") - F.length("value") >= least_saved))
    from sextant.operators.search import first_ranks

    legend = first_ranks(worth, [F.desc("n"), F.col("value")]).select((F.col("rank") - 1).alias("code"), "value")
    out = rows
    for c in interned:
        out = out.join(legend.select(F.col("value").alias(c), F.col("code").alias(f"__{c}")), c, "left")

    def escaped(c: str) -> Column:
        kind = dict(rows.dtypes)[c]
        text = F.when(F.col(c), "T").otherwise("F") if kind == "boolean" else F.col(c).cast("string")
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n"), "^@", "@@")
        field = F.when(F.col(f"__{c}").isNotNull(), F.concat(F.lit("@"), F.col(f"__{c}").cast("string"))).otherwise(plain) if c in interned else plain
        return F.coalesce(field, F.lit(""))

    return out.select(F.concat_ws("\t", *[escaped(c) for c in columns]).alias("line")), legend


def decode_rows(lines: DataFrame, legend: DataFrame, columns: dict[str, str], interned: list[str]) -> DataFrame:
    """The rows of encode_rows again, columns given with their types; an empty field is null."""
    field = F.split("line", "\t")
    out = lines.select(*[F.get(field, F.lit(i)).alias(c) for i, c in enumerate(columns)])
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^@@", "@"), r"\\\\", "\u0000"), r"\\n", "\n"), r"\\t", "\t"), "\u0000", r"\\")
    for c in interned:
        coded = F.regexp_extract(c, r"^@(\d+)$", 1)
        out = out.withColumn("__code", F.nullif(coded, F.lit("")).cast("int")).join(legend.select(F.col("code").alias("__code"), F.col("value").alias("__value")), "__code", "left")
        out = out.withColumn(c, F.when(F.col("__code").isNotNull(), F.col("__value")).otherwise(plain(F.col(c)))).drop("__code", "__value")
    typed = lambda c, t: F.when(F.col(c) != "", F.col(c) == "T" if t == "boolean" else (F.col(c) if c in interned else plain(F.col(c))).cast(t))
    return out.select(*[typed(c, t).alias(c) for c, t in columns.items()])


def encode_response(scalars: dict, keys: list[str]) -> str:
    """One line of the chosen scalars of an answer, types told where they aren't text."""
    kept = {k: scalars[k] for k in keys if k in scalars}
    types = {k: type(v).__name__ for k, v in kept.items() if v is not None and not isinstance(v, str)}
    return json.dumps({"values": {k: None if v is None else str(v) for k, v in kept.items()}, "types": types}, separators=(",", ":"))


def decode_response(line: str) -> dict:
    data = json.loads(line)
    make = {"int": int, "float": float, "bool": lambda x: x == "True"}
    return {k: make[data["types"][k]](v) if k in data["types"] and v is not None else v for k, v in data["values"].items()}


def radar_diff(before: DataFrame, after: DataFrame, least: float = 0.01) -> DataFrame:
    """axis, was, now, delta, verdict of two radars (axis, score): improved, regressed or unchanged."""
    both = before.select("axis", F.col("score").alias("was")).join(after.select("axis", F.col("score").alias("now")), "axis", "full")
    delta = F.round(F.coalesce("now", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)), 6)
    return both.select("axis", "was", "now", delta.alias("delta"), F.when(delta > least, "improved").when(delta < -least, "regressed").otherwise("unchanged").alias("verdict"))


def recent_runs(runs: DataFrame, slug: str, most: int) -> DataFrame:
    w = Window.partitionBy("slug").orderBy(F.desc("ts"), "sha")
    return runs.where(F.col("slug") == slug).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
