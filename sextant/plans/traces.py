"""Queries over runtime events: percentiles, hot paths, windows, merges, regret."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import changes, metrics, runtime
from sextant.plans.registry import registry
from sextant.sources import tables
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

EV = "(select user_id symbol_id, event_type source, value duration_ms, ts, event_id from events)"
RANKED = f"(select *, row_number() over (partition by symbol_id, source order by duration_ms) - 1 i, count(*) over (partition by symbol_id, source) n from {EV})"
BATCH = f"""(select symbol_id, source, count(*) as count, max(duration_ms) filter (i = (n - 1) // 2) p50_ms, max(duration_ms) filter (i = round_even(0.95 * (n - 1), 0)) p95_ms, min(ts) first_seen, max(ts) last_seen from {RANKED} group by all)"""


@query(f"select symbol_id, source, count as n, p50_ms p50, p95_ms p95 from {BATCH}")
def percentiles(spark, sf):
    return metrics.nearest_rank(tables.runtime_events(spark, sf), ["symbol_id", "source"], "duration_ms")


@query(f"select * from {BATCH}")
def runtime_aggregate(spark, sf):
    return runtime.batch_aggregate(tables.runtime_events(spark, sf))


@query(f"""select symbol_id, sum(count)::bigint hits, max(p95_ms) p95_ms, max(last_seen) last_seen, array_to_string(list_sort(list(distinct source)), ',') sources from {BATCH} group by 1 order by hits desc, symbol_id limit 20""")
def hot_paths(spark, sf):
    return runtime.hot_paths(runtime.batch_aggregate(tables.runtime_events(spark, sf)))


def _state_sql(test):
    return BATCH.replace("from events", f"from events where {test}")


@query(f"""select coalesce(o.symbol_id, b.symbol_id) symbol_id, coalesce(o.source, b.source) source, coalesce(o.count, 0) + coalesce(b.count, 0) as count, coalesce(b.p50_ms, o.p50_ms) p50_ms, coalesce(b.p95_ms, o.p95_ms) p95_ms, coalesce(o.first_seen, b.first_seen) first_seen, coalesce(b.last_seen, o.last_seen) last_seen
from {_state_sql('event_id % 3 <> 0')} o full join {_state_sql('event_id % 3 = 0')} b on o.symbol_id = b.symbol_id and o.source = b.source""")
def runtime_merge(spark, sf):
    ev = tables.runtime_events(spark, sf)
    return changes.upsert_counts(runtime.batch_aggregate(ev.where("event_id % 3 <> 0")), runtime.batch_aggregate(ev.where("event_id % 3 = 0")))


@query(f"select symbol_id, source, last_seen from {BATCH} order by last_seen desc, symbol_id, source limit 100")
def evict_oldest(spark, sf):
    return changes.evict_oldest(runtime.batch_aggregate(tables.runtime_events(spark, sf)).select("symbol_id", "source", "last_seen"), 100, "last_seen", "symbol_id", "source")


@query("""with l as (select event_type tool, value duration_ms, event_type <> 'error' ok, row_number() over (partition by event_type order by ts desc, event_id desc) r from events), k as (select *, row_number() over (partition by tool order by duration_ms) - 1 i, count(*) over (partition by tool) n from l where r <= 512)
select tool, count(*) n, max(duration_ms) filter (i = n // 2) p50, max(duration_ms) filter (i = least(n - 1, floor(n * 0.95))) p95, max(duration_ms) max_ms, round(avg(case when ok then 0.0 else 1.0 end), 6) error_rate from k group by tool""")
def tool_latency(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("ok"), "ts", "event_id")
    return metrics.recent_latency(calls)


@query("""select user_id symbol_id, count(*) filter (event_type = 'error') n_error, count(*) filter (event_type = 'view') n_warn, count(*) filter (event_type = 'click') n_info, min(ts) first_ts, max(ts) last_ts from events where ts >= (timestamp '2024-01-10') group by 1""")
def stack_frequency(spark, sf):
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warn").when(F.col("event_type") == "click", "info")
    ev = table(spark, sf, "events").select(F.col("user_id").alias("symbol_id"), severity.alias("severity"), "ts")
    return runtime.stack_frequency(ev, "2024-01-10 00:00:00")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts, event_id) k from g)
select user_id, min(ts) turn_start, max(ts) + interval 30 minutes turn_end, count(*) n, round(sum(value), 6) total from s group by user_id, k""")
def turn_windows(spark, sf):
    return runtime.turns(table(spark, sf, "events"))


@query("select event_type, date_trunc('day', ts) as day, count(*) n, round(sum(value), 6) total from events group by all")
def tumbling_days(spark, sf):
    w = F.window("ts", "1 day")
    return table(spark, sf, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("""select start, count(*) n, max(value) top from (select value, unnest([date_trunc('hour', ts) - interval 12 hours * i - interval 1 hour * (extract(hour from ts)::int % 12) for i in [0, 1]]) as start from events) group by 1""")
def sliding_days(spark, sf):
    w = F.window("ts", "1 day", "12 hours")
    return table(spark, sf, "events").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), "n", "top")


@query("""select event_id, user_id, round(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)), 3) gap_s from events""")
def event_gaps(spark, sf):
    return runtime.gaps(table(spark, sf, "events")).withColumn("gap_s", F.round("gap_s", 3))


@query("""with s as (select p_partkey symbol_id, p_brand as file, p_size::bigint * 20 as s, p_size::bigint * 20 + 5 + p_partkey % 90 as e from part), p as (select event_id point_id, 'Brand#' || (1 + user_id % 25) as file, floor(value * 4)::bigint as line from events)
select point_id, symbol_id from (select point_id, symbol_id, row_number() over (partition by point_id order by e - s, symbol_id) r from p join s on p.file = s.file and line between s and e) where r = 1""")
def frame_to_symbol(spark, sf):
    spans = table(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file"), (F.col("p_size").cast("long") * 20).alias("start"), (F.col("p_size").cast("long") * 20 + 5 + F.col("p_partkey") % 90).alias("end"))
    points = table(spark, sf, "events").select(F.col("event_id").alias("point_id"), F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("file"), F.floor(F.col("value") * 4).alias("line"))
    return runtime.innermost(points, spans)


_RANKING = "(select user_id query_hash, value / 100 confidence, (event_id % 3)::int returned, value / 50 top1, value / 51 top2, event_type = 'click' semantic_used, event_id % 2 = 0 identity_hit, event_id % 4 = 0 stale from events)"


def _ranking(spark, sf):
    v, e = F.col("value"), F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("query_hash"), (v / 100).alias("confidence"), (e % 3).cast("int").alias("returned"), (v / 50).alias("top1"), (v / 51).alias("top2"), (F.col("event_type") == "click").alias("semantic_used"),
        (e % 2 == 0).alias("identity_hit"), (e % 4 == 0).alias("stale"))


_REGRET = f"""with p as (select query_hash, count(*) n, count(*) filter (confidence < 0.3 and returned > 0) low, coalesce(round(avg(confidence) filter (confidence < 0.3 and returned > 0), 3), 0) mean, count(*) filter (returned = 0 or (returned <= 1 and (top1 is null or top1 < 0.10))) thin,
count(*) filter (top1 - top2 < 0.05) amb, count(*) filter (not identity_hit and semantic_used and confidence >= 0.3) voc from {_RANKING} group by 1),
k as (select query_hash, 'requery_churn' as kind, n, 0 mean, 5 least, 8 high from p union all select query_hash, 'low_confidence', low, mean, 2, 6 from p union all select query_hash, 'thin_result', thin, 0, 2, 5 from p
union all select query_hash, 'ambiguous_top', amb, 0, 2, 6 from p union all select query_hash, 'vocabulary_gap', voc, 0, 2, 6 from p),
r as (select *, row_number() over (partition by kind order by n desc, mean, query_hash) r from k where n >= least), t as (select count(*) m, count(*) filter (stale) n from {_RANKING})
select query_hash, kind, n, case when n >= high then 'high' else 'medium' end severity from r where {{most}} union all select null, 'stale_at_query', n, case when n > 0.4 * m then 'high' else 'medium' end from t where m >= 5 and n > 0.2 * m"""


@query(_REGRET.format(most="true"))
def regret(spark, sf):
    return metrics.regret(_ranking(spark, sf), clusters=None)


@query(_REGRET.format(most="r <= 5"))
def regret_clusters(spark, sf):
    return metrics.regret(_ranking(spark, sf))


@query(f"""with m as (select avg(confidence) filter (semantic_used) a, avg(confidence) filter (not semantic_used) b from {_RANKING}) select round(a, 6) mean_on, round(b, 6) mean_off, round(least(0.9, greatest(0.1, case when a - b >= 0.001 then 0.55 when a - b <= -0.001 then 0.45 else 0.5 end)), 6) weight from m""")
def weight_tuner(spark, sf):
    return metrics.tune_weight(_ranking(spark, sf), "semantic_used", threshold=0.001)


@query("select event_type, k, count(*) n from (select event_type, (props->>'k')::int k from events) group by all")
def trace_properties(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
