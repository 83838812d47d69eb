"""Queries over smaller questions: trees, compact rows, indexes of names, flows, chains, pages, catalogues, eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import code_analysis, indexing, lookups, parsing
from sextant.operators.graph import cut
from sextant.plans.registry import registry
from sextant.plans.symbols import SYMBOLS
from sextant.sources import generated, tables
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

_STEPS = "(select distinct l_partkey caller, lead_part callee from (select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) lead_part from lineitem) where l_partkey <> lead_part)"


def _calls(spark, sf):
    return tables.part_steps(spark, sf).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))


@query("""with f as (select 'r/' || p_brand || '/' || p_type || '/f' || p_partkey path, p_size n from part), x as (select path, n, unnest([0, 1, 2, 3]) d from f)
select array_to_string(string_split(path, '/')[1:d], '/') folder, d as depth, count(*) files, sum(n)::bigint as bytes from x group by all""")
def file_tree(spark, sf):
    path = F.concat(F.lit("r/"), "p_brand", F.lit("/"), "p_type", F.lit("/f"), F.col("p_partkey").cast("string"))
    return lookups.file_tree(table(spark, sf, "part").select(path.alias("path"), F.col("p_size").cast("long").alias("bytes")))


@query("""select doc_id id, source as name, lang kind, source as file, case when length(text) > 160 then rtrim(substr(text, 1, 160), ' ') || '…' else text end summary from documents""")
def compact_rows(spark, sf):
    d = table(spark, sf, "documents")
    return lookups.compact(d.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("kind"), F.col("source").alias("file"), F.col("text").alias("summary"), F.lit("").alias("signature")))


@query("select p_partkey id, p_size cyclomatic, p_size % 7 max_nesting, p_size % 5 param_count, case when p_size <= 5 then 'low' when p_size <= 10 then 'medium' else 'high' end as level from part where p_partkey % 3 = 0")
def symbol_complexity(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cyclomatic"), (F.col("p_size") % 7).alias("max_nesting"), (F.col("p_size") % 5).alias("param_count"))
    return lookups.complexity_of(s, s.where("id % 3 = 0").select("id"))


_DECORATORS = ["@app.route('/x')", "@click.command()", "@receiver(x)", "@celery.task", "@cache", "@GetMapping", "@typer.x.command"]
_KINDS = " ".join(f"when regexp_matches(d, '{p}') then '{k}'" for k, p in lookups.GATEWAYS)


@query(f"""with s as (select p_partkey id, {_DECORATORS!r}[1 + p_partkey % 7] d, p_size n from part) select id, case {_KINDS} when n % 10 = 3 then 'main' when n % 4 = 1 then 'test' end gateway from s""".replace('"@app.route(\'/x\')"', "'@app.route(''/x'')'"))
def gateway_kinds(spark, sf):
    p, n = F.col("p_partkey"), F.col("p_size")
    decorators = F.array(F.element_at(F.array(*map(F.lit, _DECORATORS)), (1 + p % 7).cast("int")))
    kind = lookups.gateway(decorators, F.when(n % 4 == 1, "test_x").otherwise("x"), F.lit("function"), F.when(n % 10 == 3, "a/main.py").otherwise("a/b.py"), tests=True)
    return table(spark, sf, "part").select(p.alias("id"), kind.alias("gateway"))


@query("""with x as (select distinct l_suppkey src, 'n' || l_partkey % 50 as name from lineitem) select name, count(*) n, array_to_string(list_sort(list(src::varchar)), ',') files from x group by name""")
def import_name_index(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.array(F.concat(F.lit("N"), (F.col("l_partkey") % 50).cast("string"))).alias("names"))
    return lookups.name_index(rows)


@query("""with n as (select 'w' || p_partkey % 40 as name from part group by 1 union select unnest(['the', 'and', 'zzz'])), i as (select 'w' || l_partkey % 30 as name, count(distinct l_suppkey) imported from lineitem group by 1),
m as (select w as name, count(*) mentioned from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_]\\w*'))) w from documents) group by 1)
select name, coalesce(imported, 0) imported, coalesce(mentioned, 0) mentioned, coalesce(imported, 0) + coalesce(mentioned, 0) > 0 referenced from n left join i using (name) left join m using (name)""")
def quick_reference_check(spark, sf):
    names = table(spark, sf, "part").select(F.concat(F.lit("w"), (F.col("p_partkey") % 40).cast("string")).alias("name")).distinct().union(spark.createDataFrame([("the",), ("and",), ("zzz",)], "name string"))
    imports = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.array(F.concat(F.lit("w"), (F.col("l_partkey") % 30).cast("string"))).alias("names"))
    return lookups.quick_check(names, imports, table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"))


_P = "(select p_partkey + 10 p from part)"
_PATH = "'pkg' || p % 7 || '/m' || p || '.py'"


@query(f"""select {_PATH} || '::C' || p || '.run#method' caller, {_PATH} || '::f' || p || '#function' callee from {_P} union all select {_PATH} || '::C' || p || '.run#method', 'pkg' || p % 7 || '/m' || (p - 7) || '.py::f' || (p - 7) || '#function' from {_P} where p > 16
union all select 'tests/test_m' || p || '.py::test_f' || p || '#function', {_PATH} || '::f' || p || '#function' from {_P} where p % 50 = 0""")
def text_callers(spark, sf):
    files = generated.modules(spark, sf)
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")
    return lookups.text_callers(lines, cut(parsing.symbols(files).select("id", "name", "file", "line", "end_line")))


@query(f"""with c as {_STEPS}, d as (select p_partkey method, (p_partkey * 3 + 1) % 1000003 + 1000000 implementation from part where p_partkey % 4 = 0) select caller, callee, 'direct' resolution from c union select caller, implementation, 'dispatched' from c join d on callee = method""")
def dispatched_calls(spark, sf):
    dispatch = table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("method"), ((F.col("p_partkey") * 3 + 1) % 1000003 + 1000000).alias("implementation"))
    return lookups.dispatched(_calls(spark, sf), dispatch)


@query(f"select s.id, s.name from {SYMBOLS} s where id in (select user_id from events where event_type = 'error')")
def traced_symbols(spark, sf):
    return lookups.with_runtime(tables.symbols(spark, sf), table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("symbol_id"))).select("id", "name")


@query("""with p as (select p_partkey + 10 p from part), e as (select case p % 6 when 0 then 'py' when 1 then 'js' when 2 then 'go' when 3 then 'php' when 4 then 'rb' else 'java' end x, p from p)
select 'r' || p || '.' || x src_file, case p % 6 when 0 then 'GET' when 1 then 'POST' when 2 then 'GET' when 3 then 'PUT' when 4 then 'DELETE' else 'GET' end || ' /r' || p as label,
case when p % 6 <> 4 and p % 5 <> 3 then 's' || p end dst, case when p % 6 = 4 or p % 5 = 3 then null when p % 5 = 0 then 0.9 when p % 5 = 1 then 0.8 else 0.6 end confidence from e""")
def flow_edges(spark, sf):
    files = generated.routers(spark, sf)
    routes = code_analysis.routes(files)
    p = F.regexp_extract("path", r"^r(\d+)\.", 1).cast("long")
    own = files.where(p % 5 != 3)
    symbols = own.select(F.concat(F.lit("s"), p.cast("string")).alias("id"), F.when(p % 5 == 0, F.col("path")).otherwise(F.concat(F.lit("views"), p.cast("string"))).alias("file"), F.concat(F.lit("h"), p.cast("string")).alias("name"), F.lit("function").alias("kind"))
    edges = files.where(p % 5 == 1).select(F.col("path").alias("src"), F.concat(F.lit("views"), p.cast("string")).alias("dst"))
    return lookups.flow_edges(routes, symbols, edges)


@query(f"""with recursive c as materialized {_STEPS}, g as (select p_partkey gateway, case p_partkey % 2 when 0 then 'http' else 'cli' end kind from part where p_partkey % 40 = 1), t as (select gateway, gateway as node, 0 depth from g union select gateway, callee, depth + 1 from t join c on caller = node where depth < 2),
m as (select gateway, node, min(depth) depth from t group by all) select gateway, kind, max(depth) depth, count(*) reach, count(distinct p_brand) files from m join part on p_partkey = node join g using (gateway) group by all""")
def signal_chains(spark, sf):
    g = table(spark, sf, "part").where("p_partkey % 40 = 1").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "http").otherwise("cli").alias("kind"))
    return lookups.signal_chains(g, _calls(spark, sf), tables.symbols(spark, sf), 2)


@query(f"""with recursive c as materialized {_STEPS}, d as (select 7::bigint as node, 0 depth union select callee, depth + 1 from d join c on caller = node where depth < 2), u as (select 7::bigint as node, 0 depth union select caller, depth + 1 from u join c on callee = node where depth < 2)
select node, min(depth) depth, 'callee' direction from d group by node having min(depth) > 0 union all select node, min(depth), 'caller' from u group by node having min(depth) > 0""")
def call_hierarchy(spark, sf):
    return lookups.call_hierarchy(_calls(spark, sf), 7, 2)


@query("""with recursive r as (select p_partkey src, p_partkey + 1 dst, case when p_partkey % 4 = 0 then null else 'x' || (p_partkey + 1) // 3 end as name from part where p_partkey % 12 <> 11), d as (select p_partkey as file, 'x' || p_partkey // 3 as name from part),
t as (select src as file, d.name from r join d on d.file = r.dst where r.name is null or r.name = d.name union select r.src, t.name from r join t on t.file = r.dst where r.name is null or r.name = t.name) select distinct file, name from t""")
def barrel_export_names(spark, sf):
    p = F.col("p_partkey")
    named = lambda n: F.concat(F.lit("x"), F.floor(n / 3).cast("string"))
    re_exports = table(spark, sf, "part").where("p_partkey % 12 <> 11").select(p.alias("src"), (p + 1).alias("dst"), F.when(p % 4 != 0, named(p + 1)).alias("name"))
    return lookups.barrel_exports(re_exports, table(spark, sf, "part").select(p.alias("file"), named(p).alias("name")))


@query("""select coalesce(a.p_partkey, b.p_partkey) path, case when a.p_partkey is null then 'new' when b.p_partkey is null then 'deleted' else 'changed' end state from (select p_partkey, p_size m from part where p_partkey % 5 <> 0) a full join (select p_partkey, p_size + p_partkey % 3 as m from part where p_partkey % 7 <> 0) b on a.p_partkey = b.p_partkey
where a.p_partkey is null or b.p_partkey is null or b.m > a.m + 1""")
def mtime_changes(spark, sf):
    p, n = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf, "part")
    return lookups.mtime_changes(part.where("p_partkey % 5 <> 0").select(p.alias("path"), n.alias("mtime")), part.where("p_partkey % 7 <> 0").select(p.alias("path"), (n + p % 3).alias("mtime")))


@query(f"select id, cyclomatic from {SYMBOLS} order by cyclomatic desc, id limit 25")
def two_stage_top(spark, sf):
    return lookups.two_stage_top(tables.symbols(spark, sf).select("id", "cyclomatic"), [F.desc("cyclomatic"), F.col("id")], 25)


@query(f"select id, cyclomatic from {SYMBOLS} order by cyclomatic desc, id limit 20 offset 40")
def result_page(spark, sf):
    return lookups.page(tables.symbols(spark, sf).select("id", "cyclomatic"), [F.desc("cyclomatic"), F.col("id")], 40, 20)


@query("""select 's' || p || '.py' path, 'reassigned_param' preset, 2 line, 's' || p || '.py::g#function' symbol_id from (select p_partkey + 10 p from part) where p % 7 = 0 union all
select 's' || p || '.py', x.preset, x.line, null from (select p_partkey + 10 p from part) join (values (1, 'bare_except', 3), (1, 'empty_catch', 3), (2, 'hardcoded_secret', 1), (3, 'eval_exec', 1), (4, 'nested_loops', 3), (5, 'deeply_nested', 5), (6, 'magic_number', 1)) x(k, preset, line) on p % 7 = k""")
def enriched_findings(spark, sf):
    files = generated.smelly(spark, sf)
    return lookups.enriched(parsing.findings(files).select("path", "preset", "line"), parsing.symbols(files))


@query("select 'symbols' what, count(*) n from part union all select 'documents', count(*) from documents union all select 'lines', count(*) from lineitem")
def index_overview(spark, sf):
    return lookups.overview({"symbols": table(spark, sf, "part"), "documents": table(spark, sf, "documents"), "lines": table(spark, sf, "lineitem")})


@query("""with t as (select p_partkey as name, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) w from part), h as (select name, unnest(w) term from t), k as (select * from h where term in ('promo', 'widget', 'hot')), d as (select term, ln(1 + (select count(*) from t) / count(*)) idf from k group by term)
select name, round(sum(idf), 6) score from k join d using (term) group by name order by score desc, name limit 15""")
def catalogue_search(spark, sf):
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return lookups.catalogue_search(table(spark, sf, "part").select(F.col("p_partkey").alias("name"), words.alias("words")), ["promo", "widget", "hot"], 15)


@query("""with p as (select 'home/r' || p_size % 6 || '/x/f' || p_partkey path, p_size % 6 k from part) select path, case when k = 1 then 'inner' when k in (0, 2) then 'r' || k end repo from p""")
def resolved_repos(spark, sf):
    paths = table(spark, sf, "part").select(F.concat(F.lit("home/r"), (F.col("p_size") % 6).cast("string"), F.lit("/x/f"), F.col("p_partkey").cast("string")).alias("path"))
    return lookups.resolve_repo(paths, spark.createDataFrame([("r0", "home/r0"), ("r1", "home/r1"), ("inner", "home/r1/x"), ("r2", "home/r2")], "repo string, root string"))


@query("""select g as "group", p_brand repo, count(*) n from part join (values ('a', 'Brand#1'), ('a', 'Brand#2'), ('b', 'Brand#2'), ('b', 'none')) x(g, repo) on p_brand = repo group by all""")
def repo_groups(spark, sf):
    groups = spark.createDataFrame([("a", "Brand#1"), ("a", "Brand#2"), ("b", "Brand#2"), ("b", "none")], "group string, repo string")
    return lookups.in_groups(table(spark, sf, "part").select(F.col("p_brand").alias("repo")), groups).groupBy("group", "repo").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select p_partkey id, lower(p_name) n, lower(p_type) m from part) select id, case when n = 'hot rod' then 20 when contains(n, 'hot rod') then 10 else 0 end + case when contains(m, 'hot rod') then 8 else 0 end + case when contains(n || ' ' || m, 'hot rod') then 5 else 0 end
+ case when contains(n, 'hot') then 5 else 0 end + case when contains(n, 'rod') then 5 else 0 end + case when contains(m, 'hot') then 2 else 0 end + case when contains(m, 'rod') then 2 else 0 end + case when contains(n || ' ' || m, 'hot') then 1 else 0 end + case when contains(n || ' ' || m, 'rod') then 1 else 0 end
+ 3 * len(list_intersect(string_split(n, ' '), ['hot', 'rod'])) score from s""")
def legacy_scores(spark, sf):
    p = table(spark, sf, "part")
    score = lookups.legacy_score("hot rod", F.col("p_name"), F.col("p_type"), F.concat_ws(" ", "p_name", "p_type"), F.split(F.lower("p_name"), " "), F.lit(""))
    return p.select(F.col("p_partkey").alias("id"), score.alias("score"))


@query("""select 'src/' || case p_partkey % 8 when 0 then 'a.py' when 1 then 'node_modules/a.js' when 2 then 'a.lock' when 3 then '.env' when 4 then 'tmp/x.py' when 5 then 'tmp/keep.py' when 6 then 'big.go' else 'yarn.lock' end path, case p_partkey % 8 when 1 then 'skipped_folder' when 2 then 'unsupported' when 3 then 'secret' when 4 then 'ignored' when 6 then 'too_large' when 7 then 'skipped_name' end reason, count(*) n from part group by all""")
def file_eligibility(spark, sf):
    k = F.col("p_partkey") % 8
    names = ["a.py", "node_modules/a.js", "a.lock", ".env", "tmp/x.py", "tmp/keep.py", "big.go", "yarn.lock"]
    path = F.concat(F.lit("src/"), F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int")))
    reason = indexing.skip_reason(path, F.when(k == 6, 600_000).otherwise(10), F.lit(b"x"), rules=indexing.ignore_rules("# c\ntmp/\n!keep.py\n"))
    return table(spark, sf, "part").select(path.alias("path"), reason.alias("reason")).groupBy("path", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("select file, author, ts from (select l_partkey as file, o_custkey author, o_orderdate ts, row_number() over (partition by l_partkey order by o_orderdate desc, o_orderkey desc) r from orders join lineitem on o_orderkey = l_orderkey) where r = 1")
def last_authors(spark, sf):
    return parsing.blame(tables.commit_files(spark, sf))


@query("""select 'api' || p || '.json::GET /p' || p || '#function' id, 'function' kind, 's' || p signature from (select p_partkey + 10 p from part) union all select 'api' || p || '.json::A' || p || '#class', 'class', 'd' from (select p_partkey + 10 p from part) union all select 'api' || p || '.json::B#class', 'class', '' from (select p_partkey + 10 p from part)""")
def api_symbols(spark, sf):
    return parsing.api_symbols(generated.specifications(spark, sf)).select("id", "kind", "signature")


@query("select p_partkey as query, 3 - case when p_partkey % 3 = 0 then 1 else 0 end kept from part")
def replayed_queries(spark, sf):
    p = F.col("p_partkey")
    log = table(spark, sf, "part").select(p.alias("query"), F.array(p, p + 1, p + 2, p + 3).alias("ids"))
    rank = lambda k: table(spark, sf, "part").select(p.alias("query"), (p + k).alias("id"), F.lit(k + 1).alias("rank"))
    return lookups.replay(log, rank(0).union(rank(1)).union(rank(2).where("query % 3 <> 0")), 3)
