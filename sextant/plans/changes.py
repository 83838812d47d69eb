"""Queries over what changed: diffs, overlays, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import changes
from sextant.plans.registry import registry
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

_BEFORE = "(select o_custkey as key, count(*)::varchar as content from orders where o_orderdate < timestamp '1998-06-01' group by 1)"
_AFTER = "(select o_custkey as key, count(*)::varchar as content from orders where o_orderdate >= timestamp '1998-06-01' group by 1)"


def _half(spark, sf, test):
    return table(spark, sf, "orders").where(test).groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("content"))


def _halves(spark, sf):
    return _half(spark, sf, "o_orderdate < timestamp_ntz '1998-06-01'"), _half(spark, sf, "o_orderdate >= timestamp_ntz '1998-06-01'")


@query(f"""select * from (select coalesce(a.key, b.key) as key, case when a.key is null then 'added' when b.key is null then 'removed' when a.content is distinct from b.content then 'modified' end change from {_BEFORE} a full join {_AFTER} b on a.key = b.key) where change is not null""")
def symbol_diff(spark, sf):
    return changes.symbol_diff(*_halves(spark, sf))


@query(f"""with g as (select content, min(key) old_key, count(*) n from {_BEFORE} where key not in (select key from {_AFTER}) group by 1), c as (select content, min(key) new_key, count(*) n from {_AFTER} where key not in (select key from {_BEFORE}) group by 1)
select old_key, new_key from g join c using (content) where g.n = 1 and c.n = 1""")
def renamed_symbols(spark, sf):
    return changes.renamed(*_halves(spark, sf))


@query(f"""select * from (select coalesce(a.key, b.key) as path, case when a.key is null then 'new' when b.key is null then 'deleted' when md5(a.content) <> md5(b.content) then 'changed' end state from {_BEFORE} a full join {_AFTER} b on a.key = b.key) where state is not null""")
def hash_changes(spark, sf):
    a, b = (h.select(F.col("key").alias("path"), F.md5(F.col("content").cast("binary")).alias("hash")) for h in _halves(spark, sf))
    return changes.hash_changes(a, b)


_DELTA = "(select p_partkey as file, case p_partkey % 3 when 0 then 'delete' when 1 then 'modify' else 'add' end as action, 'changed' as body from part where p_size > 40)"


@query(f"select p_partkey as file, p_name as body from part where p_partkey not in (select file from {_DELTA}) union all select file, body from {_DELTA} where action <> 'delete'")
def branch_overlay(spark, sf):
    base = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("body"))
    action = F.when(F.col("p_partkey") % 3 == 0, "delete").when(F.col("p_partkey") % 3 == 1, "modify").otherwise("add")
    delta = table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("file"), action.alias("action"), F.lit("changed").alias("body"))
    return changes.overlay(base, delta)


@query("select p_partkey as file, p_name as body from part where p_brand <> 'Brand#4' union all select p_partkey, upper(p_name) from part where p_brand = 'Brand#4'")
def incremental_save(spark, sf):
    base = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("body"))
    fresh = table(spark, sf, "part").where("p_brand = 'Brand#4'").select(F.col("p_partkey").alias("file"), F.upper("p_name").alias("body"))
    return changes.replace_files(base, fresh)


@query("""select state, count(*) n from (select case when md5(o_orderstatus) <> md5('F') then 'stale_index' when o_orderdate > timestamp '1998-01-01' + interval 1 second then 'edited_uncommitted' else 'fresh' end state from orders) group by state""")
def freshness(spark, sf):
    state = changes.freshness(F.md5(F.col("o_orderstatus").cast("binary")), F.md5(F.lit("F").cast("binary")), F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "orders").select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
