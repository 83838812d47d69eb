"""Queries that put several operators together."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import composites, docs, graph
from sextant.plans.graphs import EDGES
from sextant.plans.registry import registry
from sextant.plans.symbols import COMMITS, SYMBOLS
from sextant.sources import tables
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

_PHRASES = ", ".join("({}, '{}', '{}', {!r}::double)".format(i, n, p.replace("'", "''"), 1 + len(p) / 30) for i, (n, listed) in enumerate(composites.INTENTS.items()) for p in listed)


@query(f"""with p(place, intent, phrase, w) as (values {_PHRASES}), t as (select conv_id * 1000 + turn id, lower(text) || case turn % 4 when 0 then ' why isn''t the failing test fixed' when 1 then ' explain and find' when 2 then ' security audit of dead code' else '' end task from conversations),
s as (select id, place, intent, round(sum(w), 9) w, count(*) n from t join p on contains(task, phrase) group by all), b as (select *, row_number() over (partition by id order by w desc, place) r from s)
select t.id, coalesce(intent, 'explore') intent, coalesce(round(least(0.95, 0.55 + 0.1 * n), 2), 0.5) confidence from t left join b on b.id = t.id and r = 1""")
def task_intents(spark, sf):
    more = F.when(F.col("turn") % 4 == 0, " why isn't the failing test fixed").when(F.col("turn") % 4 == 1, " explain and find").when(F.col("turn") % 4 == 2, " security audit of dead code").otherwise("")
    return composites.intents(table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", more).alias("task")))


@query(f"""with h as (select user_id, count(*) hits from events group by 1), c as (select p_brand file, count(distinct l_orderkey) churn from lineitem join part on l_partkey = p_partkey group by 1),
o as (select distinct l_orderkey from lineitem join part on l_partkey = p_partkey where p_brand = 'Brand#4' and l_quantity = 50), r as (select distinct p_brand file from o join lineitem using (l_orderkey) join part on l_partkey = p_partkey),
x as (select cyclomatic, id % 5 = 0 test, id % 2 = 0 covered, hits from {SYMBOLS} s left join h on h.user_id = s.id where s.file = 'Brand#4'),
m as (select coalesce(max(cyclomatic), 0) c, count(*) n, coalesce(avg(case when covered then 0.0 else 1.0 end) filter (not test), 0) gap, coalesce(avg(ln(1 + hits) / ln(1 + 1e6)), 0) t from x),
f as (select coalesce(avg(churn) filter (c.file = 'Brand#4'), 0) h, count(r.file) / count(*)::double ratio from c left join r using (file)),
p as (select least(1.0, 1 - exp(-5 * ratio)) blast, least(1.0, ln(1 + c) / ln(31)) complexity, least(1.0, ln(1 + h) / ln(26)) churn, gap::double gap, least(1.0, ln(1 + n) / ln(61)) volume, least(1.0, t) runtime from m, f),
k as (select *, round(0.85 * (0.30 * blast + 0.25 * complexity + 0.15 * churn + 0.20 * gap + 0.10 * volume) + 0.15 * runtime, 4) risk from p)
select round(blast, 4) blast, round(complexity, 4) complexity, round(churn, 4) churn, round(gap, 4) gap, round(volume, 4) volume, round(runtime, 4) runtime, risk, case when risk <= 0.25 then 'low' when risk <= 0.5 then 'medium' when risk <= 0.75 then 'high' else 'critical' end level from k""")
def change_risk(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(parts, "l_partkey")
    touched = lines.where("file = 'Brand#4' and l_quantity = 50").select("l_orderkey").distinct()
    reached = lines.join(touched, "l_orderkey", "left_semi").select("file").distinct().withColumn("reached", F.lit(True))
    files = lines.groupBy("file").agg(F.countDistinct("l_orderkey").alias("churn")).join(reached, "file", "left").select("churn", (F.col("file") == "Brand#4").alias("changed"), F.coalesce("reached", F.lit(False)).alias("reached"))
    hits = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    changed = tables.symbols(spark, sf).where("file = 'Brand#4'").join(hits, "id", "left").select("cyclomatic", (F.col("id") % 5 == 0).alias("test"), (F.col("id") % 2 == 0).alias("covered"), "hits")
    return composites.change_risk(changed, files, runtime=True)


@query(f"""with u as (select user_id, count(*) n from events where event_type = 'error' group by 1), i as (select l_partkey, count(*) n, count(*) filter (l_returnflag = 'R') returned, count(*) filter (l_linestatus = 'O') opened from lineitem group by 1),
d as (select s.id, cyclomatic, coalesce(u.n, 0) hits, kind = 'promo' and s.id % 9 = 0 entry, coalesce(i.n, 0) n, case when coalesce(returned, 0) > 14 then 1 else 0 end cross_repo, case when coalesce(opened, 0) > 18 then 1 else 0 end ext, case when coalesce(i.n, 0) > 30 then 1 else 0 end internal, case when coalesce(i.n, 0) > 22 then 1 else 0 end tests, s.id % 2 = 0 tested, (s.id % 11) / 10.0::double dead
from {SYMBOLS} s left join u on u.user_id = s.id left join i on i.l_partkey = s.id),
v as (select *, case when hits > 0 then 'runtime_observed' when entry then 'entry_point' when cross_repo > 0 then 'cross_repo_blocking' when ext > 0 then 'external_uses_blocking' when internal > 0 then 'internal_uses_blocking' when tests > 0 then 'test_coverage_only' else 'safe_to_delete' end verdict,
case when hits > 0 then 'runtime_critical' when ext + cross_repo > 0 then 'signature_impact' when cyclomatic >= 11 then 'complexity_risk' when internal > 0 and not tested then 'untested' else 'safe_to_edit' end edit from d)
select id, verdict, case verdict when 'runtime_observed' then 0.05 when 'cross_repo_blocking' then 0.1 when 'entry_point' then 0.2 when 'external_uses_blocking' then 0.25 when 'internal_uses_blocking' then 0.45 when 'test_coverage_only' then 0.65 else greatest(0.5, dead, case when dead < 0.9 then 0.85 else 0.95 end) end sure,
edit, case edit when 'runtime_critical' then 0.15 when 'signature_impact' then 0.4 when 'complexity_risk' then 0.45 when 'untested' then 0.55 else case when tested then 0.95 else 0.9 end end edit_sure from v""")
def check_safe(spark, sf):
    used = table(spark, sf, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    refs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"), F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("opened"))
    s = tables.symbols(spark, sf).join(used, "id", "left").join(refs, "id", "left").na.fill(0, ["hits", "n", "returned", "opened"])
    over = lambda c, least: F.when(F.col(c) > least, 1).otherwise(0)
    entry, tested, dead = (F.col("kind") == "promo") & (F.col("id") % 9 == 0), F.col("id") % 2 == 0, (F.col("id") % 11) / 10.0
    gone, sure = composites.delete_verdict(F.col("hits"), entry, over("returned", 14), over("opened", 18), over("n", 30), over("n", 22), dead)
    edit, edit_sure = composites.edit_verdict(F.col("hits"), over("returned", 14), over("opened", 18), over("n", 30), F.col("cyclomatic"), tested)
    return s.select("id", gone.alias("verdict"), sure.alias("sure"), edit.alias("edit"), edit_sure.alias("edit_sure"))


@query(f"""select file, array_to_string(list(n || ' ' || kind order by n desc, kind), ', ') summary from (select file, kind, count(*) n from {SYMBOLS} group by all) group by file""")
def file_summaries(spark, sf):
    return composites.file_summaries(tables.symbols(spark, sf))


@query("""select doc_id id, substr(trim(regexp_extract(trim(text), '^[^.\\n]*\\.?', 0)), 1, 120) summary from documents""")
def docstring_summaries(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), composites.docstring_summary(F.col("text")).alias("summary"))


@query("""with recursive s as (select conv_id doc, turn id, case when turn > 0 then (turn - 1) // 2 end parent_id from conversations), t as (select doc, id, 0 depth, id::varchar path from s where parent_id is null union all select s.doc, s.id, t.depth + 1, t.path || '/' || s.id from s join t on s.doc = t.doc and s.parent_id = t.id where t.depth < 20)
select * from t""")
def table_of_contents(spark, sf):
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    return composites.contents(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), parent.alias("parent_id")))


@query(f"""with recursive e as materialized {EDGES}, t as (select dst as node, 1 depth, '0>' || dst path from e where src = 0 and dst <> 0 union all select e.dst, t.depth + 1, t.path || '>' || e.dst from e join t on e.src = t.node where t.depth < 3 and not list_contains(string_split(t.path, '>'), e.dst::varchar)) select * from t""")
def impact_paths(spark, sf):
    return composites.impact_paths(tables.part_steps(spark, sf), 0)


@query(f"""with recursive e as materialized {EDGES}, r as (select 3::bigint as node, 0 as depth union select e.src, r.depth + 1 from r join e on e.dst = r.node where r.depth < 2) select node, min(depth) depth from r group by node""")
def callers(spark, sf):
    return graph.bfs(graph.invert(tables.part_steps(spark, sf)), spark.createDataFrame([(3,)], "node bigint"), 2)


@query("select p_name package, array_to_string(list_sort(list(distinct p_brand)), ',') repos from part group by p_name")
def package_registry(spark, sf):
    return composites.registry(table(spark, sf, "part").select(F.col("p_name").alias("package"), F.col("p_brand").alias("repo")))


@query("""with o as (select o_custkey slug, o_orderstatus sha, o_orderdate ts, o_orderkey run from orders), a as (select *, row_number() over (partition by slug, sha order by ts, run) r from o), b as (select slug, sha, ts, run, row_number() over (partition by slug order by ts desc, run desc) k from a where r = 1) select slug, sha, ts, run from b where k <= 2""")
def run_history(spark, sf):
    return composites.history(table(spark, sf, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderstatus").alias("sha"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("run")), 2)


@query("""with p as (select event_type kind, user_id thing, count(*) n, max(ts) last from events where event_type in ('view', 'click') group by all) select kind, thing, n, last from (select *, row_number() over (partition by kind order by last desc, thing) r from p) where r <= 20""")
def session_journal(spark, sf):
    return composites.journal(table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("thing"), "ts"), ["view", "click"])


@query("select event_id, ts, value from events where ts >= timestamp '2024-01-05' and event_type = 'click' order by ts desc, event_id desc limit 100")
def ranking_ledger(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value", F.col("event_type").alias("tool"))
    return composites.ledger(e, "2024-01-05 00:00:00", "click", 100).drop("tool")


@query("""with n as (select distinct l_suppkey as file, l_partkey as name from lineitem), f as (select name from n group by name having count(*) <= 30) select x.file a, y.file b, count(*) shared from n x join n y on x.name = y.name and x.file < y.file where x.name in (select name from f) group by all having count(*) >= 25""")
def shared_imports(spark, sf):
    n = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("name"))
    return composites.shared_names(n).where("shared >= 25")


@query(f"""with t as (select file tf, string_split(lower(name), ' ') tw from {SYMBOLS} where id = 17), i as (select distinct p_brand as file, l_suppkey importer from lineitem join part on l_partkey = p_partkey),
n as (select distinct file from i where importer in (select importer from i, t where file = tf)),
s as (select id, round(case when file = tf then 3.0 when file in (select file from n) then 1.5 else 0 end + 0.5 * len(list_intersect(list_distinct(string_split(lower(name), ' ')), tw)), 2) score from {SYMBOLS}, t where id <> 17)
select id, score from s where score > 0 order by score desc, id limit 20""")
def related_symbols(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"))
    importers = table(spark, sf, "lineitem").join(parts, "l_partkey").select("file", F.col("l_suppkey").alias("importer"))
    return composites.related(tables.symbols(spark, sf), 17, importers=importers)


@query("select doc_id id, sha256(text) = case when doc_id % 7 = 0 then 'stale' else sha256(text) end ok from documents")
def verify_index(spark, sf):
    stored = F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.sha2("text", 256))
    return composites.verify(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), stored.alias("content_hash")))


@query("""with p as (select regexp_extract(url, '^(.*[/#])[^/#]*$', 1) prefix from pages) select prefix, count(*) uses, (length(prefix) - 2) * (count(*) - 1) saved from p where prefix <> '' group by prefix having count(*) >= 2 and (length(prefix) - 2) * (count(*) - 1) >= 4""")
def prefix_legend(spark, sf):
    return composites.legend(table(spark, sf, "pages"), "url")


@query("""select doc_id id, len(list_distinct(regexp_extract_all(text, '(?m)(?:^|\\s)#([A-Za-z][A-Za-z0-9_-]*)', 1))) tags, substr(text, 1, 20) head from documents""")
def document_tags(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.size(docs.tags(F.col("text"))).alias("tags"), F.substring("text", 1, 20).alias("head"))


@query()
def byte_excerpts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), composites.utf8_cut(F.col("text"), 101).alias("excerpt"))


@query()
def hashed_embeddings(spark, sf):
    words = F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), composites.hashed_embedding(words, 16).alias("vec"))
