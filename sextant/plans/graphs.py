"""Graph queries: parts as modules, the part on an order's next line as what one imports; parts of one order as co-changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import composites, graph, metrics
from sextant.plans.registry import registry
from sextant.sources import tables
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

EDGES = "(select distinct src, dst from (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) dst from lineitem) where src <> dst)"
COCHANGE = """(select x.l_partkey a, y.l_partkey b, count(*) together from (select distinct l_orderkey, l_partkey from lineitem) x join (select distinct l_orderkey, l_partkey from lineitem) y on x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey
where x.l_orderkey in (select l_orderkey from lineitem group by 1 having count(distinct l_partkey) between 2 and 20) group by 1, 2)"""


@query(f"select src, dst from {EDGES}")
def import_edges(spark, sf):
    return tables.part_steps(spark, sf)


@query(f"""select p_partkey as node, coalesce(o, 0) out_degree, coalesce(i, 0) in_degree from part left join (select src, count(*) o from {EDGES} group by 1) on src = p_partkey left join (select dst, count(*) i from {EDGES} group by 1) on dst = p_partkey""")
def degrees(spark, sf):
    return metrics.degrees(tables.part_nodes(spark, sf), tables.part_steps(spark, sf))


@query(f"""with d as (select p_partkey as node, coalesce(i, 0) ca, coalesce(o, 0) ce from part left join (select src, count(*) o from {EDGES} group by 1) on src = p_partkey left join (select dst, count(*) i from {EDGES} group by 1) on dst = p_partkey)
select *, case when ca + ce > 0 then round(ce / (ca + ce), 6) end instability from d""")
def coupling(spark, sf):
    return metrics.coupling(tables.part_nodes(spark, sf), tables.part_steps(spark, sf))


@query(f"""with d as (select coalesce(i, 0) ca, coalesce(o, 0) ce from part left join (select src, count(*) o from {EDGES} group by 1) on src = p_partkey left join (select dst, count(*) i from {EDGES} group by 1) on dst = p_partkey)
select count(*) filter (ca + ce > 0 and round(ce / (ca + ce), 6) > 0.7) unstable, count(*) total from d""")
def unstable_modules(spark, sf):
    return metrics.unstable_modules(metrics.coupling(tables.part_nodes(spark, sf), tables.part_steps(spark, sf)))


@query(f"""with recursive e as materialized {EDGES}, r as (select 0 as node, 0 as depth union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 3)
select node, min(depth) depth from r group by node""")
def blast_radius(spark, sf):
    return graph.bfs(tables.part_steps(spark, sf), spark.createDataFrame([(0,)], "node bigint"), 3)


@query(f"""with recursive e as materialized {EDGES}, r as (select 0 as node union select e.dst from r join e on e.src = r.node) select p_partkey as node, p_partkey in (select node from r) reached from part""")
def reachability(spark, sf):
    found = graph.bfs(tables.part_steps(spark, sf), spark.createDataFrame([(0,)], "node bigint")).select("node", F.lit(True).alias("reached"))
    return tables.part_nodes(spark, sf).join(found, "node", "left").na.fill(False, ["reached"])


_RANK_STEP = "select n.node, 0.15 / c.n + 0.85 * (coalesce(g.given, 0) + l.loose / c.n) rank from n cross join c cross join (select coalesce(sum(rank), 0) loose from r{i} where node not in (select src from e)) l left join (select dst, sum(rank / d) given from e join o using (src) join r{i} on r{i}.node = src group by dst) g on g.dst = n.node"


@query(f"with e as materialized {EDGES}, n as (select p_partkey as node from part), c as (select count(*) n from n), o as (select src, count(*) d from e group by src), r0 as (select node, 1.0::double / c.n rank from n, c)" + "".join(
    f", r{i + 1} as materialized ({_RANK_STEP.format(i=i)})" for i in range(20)) + " select node, round(rank, 6) rank from r20")
def pagerank_20_rounds(spark, sf):
    out = graph.pagerank(tables.part_nodes(spark, sf), tables.part_steps(spark, sf), rounds=20, tolerance=0.0)
    return out.select("node", F.round("rank", 6).alias("rank"))


@query()
def pagerank(spark, sf):
    return graph.pagerank(tables.part_nodes(spark, sf), tables.part_steps(spark, sf)).select("node", F.round("rank", 6).alias("rank"))


@query()
def import_cycles(spark, sf):
    return graph.strong_components(tables.part_steps(spark, sf))


@query(f"""select src, dst, a.p_size src_layer, b.p_size dst_layer from {EDGES} join part a on a.p_partkey = src join part b on b.p_partkey = dst where b.p_size > a.p_size + 1""")
def layer_violations(spark, sf):
    layers = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("layer"))
    sizes = layers.select("layer").distinct()
    rules = sizes.alias("a").join(sizes.alias("b"), F.col("b.layer") > F.col("a.layer") + 1).select("a.layer", F.col("b.layer").alias("forbidden"))
    return graph.layer_violations(tables.part_steps(spark, sf), layers, rules)


@query(f"select a, b, together from {COCHANGE} where together >= 2")
def co_changes(spark, sf):
    return graph.co_changes(tables.commit_files(spark, sf)).where("together >= 2")


def fused(spark, sf):
    """a, b, weight of parts: next to each other in orders (structural), in deliveries of a supplier's day (behavioural), in the same orders (temporal)."""
    steps = tables.part_steps(spark, sf).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    shared = composites.shared_names(tables.deliveries(spark, sf))
    together = graph.co_changes(tables.commit_files(spark, sf))
    return graph.fuse_edges(graph.share_of_max(graph.cut(steps), "n"), graph.share_of_max(graph.cut(shared), "shared"), graph.share_of_max(graph.cut(together), "together"))


@query(f"""with t as (select * from {COCHANGE}), s as (select least(src, dst) a, greatest(src, dst) b, count(*) n from {EDGES} group by all),
d as (select distinct l_partkey as file, l_suppkey || ' ' || l_shipdate::date as name from lineitem), f as (select name from d group by name having count(*) <= 30),
k as (select x.file a, y.file b, count(*) n from d x join d y on x.name = y.name and x.file < y.file where x.name in (select name from f) group by all),
u as (select a, b, 0.4 * (n / (select max(n) from s)) part from s union all select a, b, 0.3 * (n / (select max(n) from k)) from k union all select a, b, 0.3 * (together / (select max(together) from t)) from t)
select a, b, round(sum(part), 6) weight from u group by a, b having round(sum(part), 6) > 0.01""")
def tectonic_edges(spark, sf):
    return fused(spark, sf)


@query()
def communities(spark, sf):
    e = graph.cut(fused(spark, sf))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return graph.plates(graph.label_propagation(nodes, e), e)


@query(f"""with recursive p as materialized (select a, b from {COCHANGE} where together >= 2), u as (select a x, b y from p union select b, a from p), r as (select x as node, x as label from u union select u.y, r.label from r join u on u.x = r.node)
select node, min(label) label from r group by node""")
def components(spark, sf):
    e = graph.co_changes(tables.commit_files(spark, sf)).where("together >= 2")
    return graph.connected(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query(f"""with e as materialized {EDGES}, s as (select p_partkey as node, p_partkey not in (select dst from e) a, p_partkey not in (select src from e) b, p_partkey not in (select l_partkey from lineitem) c from part)
select node, round((a::int + b::int + c::int) / 3.0, 6) vote from s""")
def dead_code_vote(spark, sf):
    e = tables.part_steps(spark, sf)
    mark = lambda df, c, name: df.select(F.col(c).alias("node")).distinct().withColumn(name, F.lit(1))
    out = tables.part_nodes(spark, sf).join(mark(e, "dst", "a"), "node", "left").join(mark(e, "src", "b"), "node", "left").join(mark(table(spark, sf, "lineitem"), "l_partkey", "c"), "node", "left")
    signals = [F.when(F.col(c).isNull(), 1).otherwise(0) for c in "abc"]
    return out.select("node", F.round(sum(signals[1:], signals[0]) / 3, 6).alias("vote"))


@query(f"""with h as (select count(*) filter (i > 0.7) unstable, count(*) total from (select coalesce(o, 0) / nullif(coalesce(o, 0) + coalesce(i, 0), 0) i from part left join (select src, count(*) o from {EDGES} group by 1) on src = p_partkey left join (select dst, count(*) i from {EDGES} group by 1) on dst = p_partkey)),
c as (select avg(p_size) a from part where p_size > 0)
select round(greatest(0, 100 - a * 2), 2) complexity, round(100 * (1 - unstable / total), 2) stability, round((round(greatest(0, 100 - a * 2), 2) + round(100 * (1 - unstable / total), 2)) / 2, 2) composite from h, c""")
def health_radar(spark, sf):
    unstable = metrics.unstable_modules(metrics.coupling(tables.part_nodes(spark, sf), tables.part_steps(spark, sf)))
    c = table(spark, sf, "part").where("p_size > 0").agg(F.avg("p_size").alias("a"))
    axes = {"complexity": F.round(F.greatest(F.lit(0.0), 100 - F.col("a") * 2), 2), "stability": F.round(100 * (1 - F.col("unstable") / F.col("total")), 2)}
    return unstable.crossJoin(c).select(*metrics.radar(axes)).drop("grade")
