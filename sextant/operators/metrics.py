"""Change, coupling, latency, risk and health metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def churn(commit_files: DataFrame, since: str) -> DataFrame:
    """file, churn: commits that touch a file from a time on."""
    return commit_files.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).groupBy("file").agg(F.countDistinct("sha").alias("churn"))


def churn_rate(commit_files: DataFrame, since: str, days: int) -> DataFrame:
    """Per file: commits, authors, first, last, commits a week and what that is called."""
    recent = commit_files.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    out = recent.groupBy("file").agg(F.countDistinct("sha").alias("commits"), F.countDistinct("author").alias("authors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    per_week = F.round(F.col("commits") / F.lit(days / 7), 4)
    return out.withColumn("per_week", per_week).withColumn("assessment", F.when(F.col("per_week") <= 1, "stable").when(F.col("per_week") <= 3, "active").otherwise("volatile"))


def hotspots(symbols: DataFrame, churned: DataFrame, top: int = 20, min_complexity: int = 2) -> DataFrame:
    """Symbols by cyclomatic * ln(1 + churn); churned: (file, churn) by symbol id."""
    out = symbols.where(F.col("cyclomatic") >= min_complexity).join(churned.withColumnRenamed("file", "id"), "id", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    score = F.round(F.col("cyclomatic") * F.log1p(F.col("churn").cast("double")), 4)
    out = out.withColumn("score", score).withColumn("assessment", F.when(F.col("score") > 10, "high").when(F.col("score") > 3, "medium").otherwise("low"))
    return out.select("id", "name", "cyclomatic", "churn", "score", "assessment").orderBy(F.desc("score"), "id").limit(top)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree of distinct edges, zero-filled."""
    edges = edges.distinct()
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(out, "node", "left").join(into, "node", "left").na.fill(0, ["out_degree", "in_degree"])


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, ca, ce, instability = ce / (ca + ce), null for an isolated node."""
    d = degrees(nodes, edges).select("node", F.col("in_degree").alias("ca"), F.col("out_degree").alias("ce"))
    return d.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 6)))


def unstable_modules(coupled: DataFrame, limit: float = 0.7) -> DataFrame:
    return coupled.agg(F.count(F.when(F.col("instability") > limit, 1)).alias("unstable"), F.count(F.lit(1)).alias("total"))


def average_complexity(symbols: DataFrame) -> DataFrame:
    return symbols.where("cyclomatic > 0").agg(F.round(F.avg("cyclomatic"), 2).alias("avg_complexity"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: count, p50 = s[(n-1) div 2], p95 = s[round-half-even(0.95 (n-1))]."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("__i", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    mid, high = F.floor((F.col("__n") - 1) / 2), F.bround(F.lit(0.95) * (F.col("__n") - 1), 0)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("__i") == mid, F.col(value))).alias("p50"), F.max(F.when(F.col("__i") == high, F.col(value))).alias("p95"))


def recent_latency(calls: DataFrame, keep: int = 512) -> DataFrame:
    """Per tool over its last `keep` calls (ts, event_id): p50 = s[n div 2], p95 = s[min(n-1, floor(.95 n))], max, error rate."""
    last = calls.withColumn("__r", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("__r") <= keep)
    w = Window.partitionBy("tool")
    ranked = last.withColumn("__i", F.row_number().over(w.orderBy("duration_ms")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    high = F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.lit(0.95)))
    pick = lambda at: F.max(F.when(F.col("__i") == at, F.col("duration_ms")))
    return ranked.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), pick(F.floor(F.col("__n") / 2)).alias("p50"), pick(high).alias("p95"), F.max("duration_ms").alias("max_ms"), F.round(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)), 6).alias("error_rate"))


def radar(axes: dict[str, Column]) -> list[Column]:
    """Columns for axis scores, their mean over those present, and its grade."""
    got = F.array_compact(F.array(*axes.values()))
    mean = F.when(F.size(got) > 0, F.round(F.aggregate(got, F.lit(0.0), lambda s, x: s + x) / F.size(got), 2))
    grade = F.when(mean >= 90, "A").when(mean >= 80, "B").when(mean >= 70, "C").when(mean >= 60, "D").when(mean.isNotNull(), "F")
    return [*[c.alias(k) for k, c in axes.items()], mean.alias("composite"), grade.alias("grade")]


def confidence(top1: Column, top2: Column, identity: Column, stale: Column) -> Column:
    """Weighted geometric mean of gap, strength, identity (null: unknown) and freshness, rounded to 3 places; 0 without results (top1 null)."""
    floor = lambda c: F.greatest(c, F.lit(1e-6))
    gap = F.when(top1 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top1 - F.coalesce(top2, F.lit(0.0))) / top1))).otherwise(0.0)
    strength = F.when(top1.isNotNull(), F.greatest(F.lit(0.0), 1 - F.exp(-top1 / 4)))
    ident, fresh = F.when(identity, 1.0).when(identity.isNull(), 0.7).otherwise(0.6), F.when(stale, 0.6).otherwise(1.0)
    parts = ((0.35, gap), (0.35, strength), (0.15, ident), (0.15, fresh))
    return F.coalesce(F.round(F.exp(sum((F.lit(w) * F.log(floor(c)) for w, c in parts), F.lit(0.0))), 3), F.lit(0.0))


def risk(blast: Column, complexity: Column, churned: Column, gap: Column, volume: Column) -> Column:
    return F.round(0.30 * blast + 0.25 * complexity + 0.15 * churned + 0.20 * gap + 0.10 * volume, 4)


def traffic_score(hits: Column) -> Column:
    """Mean of ln(1 + hits) / ln(1 + 10^6), at most 1."""
    return F.least(F.lit(1.0), F.avg(F.log1p(hits.cast("double")) / F.log1p(F.lit(1e6))))


def tune_weight(events: DataFrame, flag: str, step: float = 0.05, threshold: float = 0.03, now: float = 0.5, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean confidence with and without a signal, and its weight moved one step towards what does better."""
    m = events.agg(F.avg(F.when(F.col(flag), F.col("confidence"))).alias("on"), F.avg(F.when(~F.col(flag), F.col("confidence"))).alias("off"))
    delta = F.col("on") - F.col("off")
    moved = F.when(delta >= threshold, F.lit(now + step)).when(delta <= -threshold, F.lit(now - step)).otherwise(F.lit(now))
    return m.select(F.round("on", 6).alias("mean_on"), F.round("off", 6).alias("mean_off"), F.round(F.least(F.lit(high), F.greatest(F.lit(low), moved)), 6).alias("weight"))


# From where on a query's history is held against retrieval.
CHURN, CHURN_HIGH, LOW, THIN, AMBIGUOUS, STALE, STALE_EVENTS, VOCABULARY, AGAIN = 5, 8, 0.30, 0.10, 0.05, 0.20, 5, 0.30, 2
#: Events of one query from which a kind is severe; it is medium from AGAIN on.
SEVERE = {"low_confidence": 6, "thin_result": 5, "ambiguous_top": 6, "vocabulary_gap": 6}
CLUSTERS = 5


def regret(events: DataFrame, clusters: int | None = CLUSTERS) -> DataFrame:
    """query_hash, kind, n, severity: what went badly in ranking events (query_hash, confidence, returned, top1, top2, semantic_used, identity_hit, stale).

    Of each kind the `clusters` queries with most such events (low confidence:
    then the lower mean), ties by query_hash; None for all. stale_at_query is
    about all events together and has a null query_hash.
    """
    when = {
        "low_confidence": (F.col("confidence") < LOW) & (F.col("returned") > 0), "thin_result": (F.col("returned") == 0) | ((F.col("returned") <= 1) & (F.col("top1").isNull() | (F.col("top1") < THIN))),
        "ambiguous_top": (F.col("top1") - F.col("top2")) < AMBIGUOUS, "vocabulary_gap": ~F.col("identity_hit") & F.col("semantic_used") & (F.col("confidence") >= VOCABULARY)}
    per = events.groupBy("query_hash").agg(F.count(F.lit(1)).alias("requery_churn"), *[F.count(F.when(c, 1)).alias(k) for k, c in when.items()], F.coalesce(F.avg(F.when(when["low_confidence"], F.col("confidence"))), F.lit(0.0)).alias("mean"))
    kinds = [F.struct(F.lit("requery_churn").alias("kind"), F.col("requery_churn").alias("n"), F.lit(CHURN).alias("least"), F.lit(CHURN_HIGH).alias("high"), F.lit(0.0).alias("mean"))]
    kinds += [F.struct(F.lit(k).alias("kind"), F.col(k).alias("n"), F.lit(AGAIN).alias("least"), F.lit(SEVERE[k]).alias("high"), (F.round("mean", 3) if k == "low_confidence" else F.lit(0.0)).alias("mean")) for k in when]
    found = per.select("query_hash", F.inline(F.array(*kinds))).where(F.col("n") >= F.col("least"))
    if clusters is not None:
        best = Window.partitionBy("kind").orderBy(F.desc("n"), "mean", "query_hash")
        found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= clusters)
    found = found.select("query_hash", "kind", "n", F.when(F.col("n") >= F.col("high"), "high").otherwise("medium").alias("severity"))
    stale = events.agg(F.count(F.when(F.col("stale"), 1)).alias("n"), F.count(F.lit(1)).alias("m")).where((F.col("m") >= STALE_EVENTS) & (F.col("n") > STALE * F.col("m")))
    return found.unionByName(stale.select(F.lit(None).cast(events.schema["query_hash"].dataType).alias("query_hash"), F.lit("stale_at_query").alias("kind"), "n", F.when(F.col("n") > 2 * STALE * F.col("m"), "high").otherwise("medium").alias("severity")))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """nDCG@k, MRR@k and recall@k per query. ranked: (query, id, rank); relevant: (query, id)."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), ["query", "id"], "left").na.fill(0, ["rel"])
    per = hits.groupBy("query").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum("rel").alias("found"))
    goal = relevant.groupBy("query").agg(F.countDistinct("id").alias("total"))
    out = goal.join(per, "query", "left").na.fill(0, ["dcg", "found"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    return out.select("query", F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("found") / F.col("total"), 6).alias("recall"))
