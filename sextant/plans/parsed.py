"""Queries over what parsers find in files written from the tables; SQL tells the same from the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import code_analysis, docs, parsing, runtime
from sextant.operators.graph import cut
from sextant.plans.registry import registry
from sextant.sources import generated

QUERIES, ORACLE, query = registry()

_PART = "(select p_partkey + 10 p_partkey, p_name, p_size from part)"

_PATH = "'pkg' || p_partkey % 7 || '/m' || p_partkey || '.py'"
_BACK, _NEXT = "'pkg' || p_partkey % 7 || '/m' || (p_partkey - 7) || '.py'", "'pkg' || (p_partkey + 1) % 7 || '/m' || (p_partkey + 1) || '.py'"
_TESTS = f"(select * from {_PART} where p_partkey % 50 = 0)"


@query(f"""with p as (select p_partkey p, {_PATH} f from {_PART}), t as (select p_partkey p, 'tests/test_m' || p_partkey || '.py' f from {_TESTS})
select f || '::LIMIT_' || p || '#constant' id, 'LIMIT_' || p as name, 'constant' kind, 4 line, 4 end_line, null parent, 0 cyclomatic, 0 max_nesting, 0 param_count, '' docstring, '' calls from p
union all select f || '::C' || p || '#class', 'C' || p, 'class', 6, 11, null, 3, 3, 0, 'Doc of ' || p || '.', '' from p
union all select f || '::C' || p || '.run#method', 'run', 'method', 8, 11, f || '::C' || p || '#class', 3, 3, 2, '', 'f' || (p - 7) || ',f' || p || ',join,str' from p
union all select f || '::f' || p || '#function', 'f' || p, 'function', 14, 17, null, 2, 1, 2, '', 'range,print' from p
union all select f || '::test_f' || p || '#function', 'test_f' || p, 'function', 3, 4, null, 1, 1, 0, '', 'f' || p from t""")
def parsed_symbols(spark, sf):
    found = parsing.symbols(generated.modules(spark, sf))
    return found.select("id", "name", "kind", "line", "end_line", "parent", "cyclomatic", "max_nesting", "param_count", "docstring", F.array_join("call_references", ",").alias("calls"))


@query(f"""with p as (select *, {_PATH} f from {_PART}) select f src, 'os' specifier, 'os' as names from p union all select f, '.m' || (p_partkey - 7), 'f' || (p_partkey - 7) || ',Base' from p
union all select f, case when p_partkey % 10 = 9 then 'sys' else 'pkg' || (p_partkey + 1) % 7 || '.m' || (p_partkey + 1) end, case when p_partkey % 10 = 9 then 'sys' else 'C' || (p_partkey + 1) end from p
union all select 'tests/test_m' || p_partkey || '.py', 'pkg' || p_partkey % 7 || '.m' || p_partkey, 'f' || p_partkey from {_TESTS}""")
def parsed_imports(spark, sf):
    return parsing.imports(generated.modules(spark, sf)).select("src", "specifier", F.array_join("names", ",").alias("names"))


_EDGES = f"""(select {_PATH} src, {_BACK} dst from {_PART} where p_partkey > 16 union all select {_PATH}, {_NEXT} from {_PART} where p_partkey % 10 <> 9 and p_partkey < (select max(p_partkey) from {_PART})
union all select 'tests/test_m' || p_partkey || '.py', {_PATH} from {_TESTS})"""


def _parsed(spark, sf):
    """Symbols and edges of the modules, which are parsed once."""
    files = generated.modules(spark, sf)
    symbols, imports = parsing.parsed(files)
    return symbols, parsing.edges(imports, files)


def _edges(spark, sf):
    files = generated.modules(spark, sf)
    return parsing.edges(parsing.imports(files), files)


@query(f"select * from {_EDGES}")
def parsed_import_edges(spark, sf):
    return _edges(spark, sf)


@query(f"""select {_PATH} || '::C' || p_partkey || '.run#method' caller, {_PATH} || '::f' || p_partkey || '#function' callee, 'ast_resolved' resolution from {_PART}
union all select {_PATH} || '::C' || p_partkey || '.run#method', {_BACK} || '::f' || (p_partkey - 7) || '#function', 'ast_inferred' from {_PART} where p_partkey > 16
union all select 'tests/test_m' || p_partkey || '.py::test_f' || p_partkey || '#function', {_PATH} || '::f' || p_partkey || '#function', 'ast_inferred' from {_TESTS}""")
def parsed_call_edges(spark, sf):
    return parsing.calls(*_parsed(spark, sf))


@query(f"select 'C' || p_partkey as class, b base from {_PART}, (values ('K'), ('Mixin')) x(b)")
def parsed_class_bases(spark, sf):
    return parsing.class_hierarchy(parsing.symbols(generated.modules(spark, sf)))


@query(f"""select {_PATH} as file, x.place, x.depth, replace(x.name, '$', p_partkey::varchar) as name from {_PART}, (values (1, 0, 'LIMIT_$'), (2, 0, 'C$'), (3, 1, 'run'), (4, 0, 'f$')) x(place, depth, name)
union all select 'tests/test_m' || p_partkey || '.py', 1, 0, 'test_f' || p_partkey from {_TESTS}""")
def parsed_outline(spark, sf):
    return parsing.outline(parsing.symbols(generated.modules(spark, sf))).select("file", "place", "depth", "name")


@query(f"""with m as (select max(p_partkey) top from {_PART}), p as (select *, {_PATH} f, case when p_partkey > 19 then 1 else 0 end s1, case when p_partkey + 7 <= top or (p_partkey > 10 and (p_partkey - 1) % 10 <> 9) or p_partkey % 50 = 0 then 0 else 1 end s3 from {_PART}, m)
select f || '::C' || p_partkey || '#class' id, round((s1 + 1 + s3) / 3, 6) confidence from p union all select f || '::C' || p_partkey || '.run#method', round((s1 + 1 + s3) / 3, 6) from p union all select f || '::f' || p_partkey || '#function', round((s1 + s3) / 3, 6) from p
union all select 'tests/test_m' || p_partkey || '.py::test_f' || p_partkey || '#function', 1.0 from {_TESTS}""")
def parsed_dead_code(spark, sf):
    start = spark.createDataFrame([("pkg3/m10.py",)], "node string")
    return code_analysis.dead_code(*_parsed(spark, sf), start)


@query(f"""select {_PATH} || '::C' || p_partkey || '.run#method' id, case when p_partkey % 50 = 0 then 0.7 else 1.0 end confidence from {_PART} union all select {_PATH} || '::f' || p_partkey || '#function', 1.0 from {_PART} where p_partkey % 50 <> 0""")
def parsed_untested(spark, sf):
    return code_analysis.untested(*_parsed(spark, sf))


@query(f"select {_PATH} || '::C' || p_partkey || '.run#method' id from {_PART}")
def parsed_never_called(spark, sf):
    symbols = cut(parsing.symbols(generated.modules(spark, sf)).select("id", "name", "file", "kind", "call_references"))
    return code_analysis.never_called(symbols).select("id")


_SMELL_SQL = f"""with x(k, preset, line) as (values (0, 'reassigned_param', 2), (1, 'bare_except', 3), (1, 'empty_catch', 3), (2, 'hardcoded_secret', 1), (3, 'eval_exec', 1), (4, 'nested_loops', 3), (5, 'deeply_nested', 5), (6, 'magic_number', 1))
select 's' || p_partkey || '.py' path, preset, line from {_PART} join x on k = p_partkey % 7 """


@query(_SMELL_SQL)
def code_findings(spark, sf):
    return parsing.findings(generated.smelly(spark, sf)).select("path", "preset", "line")


@query(f"""select 's' || p_partkey || '.py' path, 'call:go' preset, case p_partkey % 7 when 1 then 2 when 4 then 4 when 5 then 6 else 1 end line from {_PART} where p_partkey % 7 in (1, 4, 5, 6)""")
def code_calls_of(spark, sf):
    return parsing.custom(generated.smelly(spark, sf), "call:go").select("path", "preset", "line")


_DOC = "'docs/d' || p_partkey || case p_partkey % 3 when 0 then '.md' when 1 then '.rst' else '.adoc' end"


@query(f"""with d as (select {_DOC} doc_path, p_partkey p, p_name t, replace(lower(p_name), ' ', '-') g from {_PART})
select doc_path || '::' || g || '#1' id, doc_path, t title, 1 level, null parent_id, 'tag' || p % 3 tags, 0 blocks from d
union all select doc_path || '::' || g || '/usage#2', doc_path, 'Usage', 2, doc_path || '::' || g || '#1', '', case when p % 3 = 0 then 1 else 0 end from d
union all select doc_path || '::' || g || '/notes#2', doc_path, 'Notes', 2, doc_path || '::' || g || '#1', '', 0 from d""")
def parsed_sections(spark, sf):
    found = parsing.sections(generated.documents(spark, sf))
    return found.select("id", "doc_path", "title", "level", "parent_id", F.array_join("tags", ",").alias("tags"), F.size("code_blocks").alias("blocks"))


@query(f"""select 'docs/d' || p_partkey || '.md' path, 'd' || (p_partkey + 1) || '.md,https://ex.org/' || p_partkey links, 'fn' || p_partkey codes from {_PART} where p_partkey % 3 = 0""")
def parsed_links(spark, sf):
    d = generated.documents(spark, sf).where("path like '%.md'")
    return d.select("path", F.array_join(docs.references(F.col("content")), ",").alias("links"), F.array_join(docs.inline_code(F.col("content")), ",").alias("codes"))


@query("""select 'src/f' || user_id || '.py' as file, (event_id % 100)::int line, 'fn' as function, round(floor(value * 1000) / 1000, 6) duration_ms from events where event_id % 100 <> 0""")
def otel_spans(spark, sf):
    return runtime.otel_spans(generated.span_logs(spark, sf)).withColumn("duration_ms", F.round("duration_ms", 6))


@query("""select case when user_id % 20 = 2 then 't2' else 't' || user_id % 20 || ',t2' end tables, event_id % 5 calls, round(value, 6) mean_ms from events where event_id % 10 <> 0""")
def sql_log(spark, sf):
    log = runtime.sql_log_json(generated.statement_logs(spark, sf))
    return log.select(F.array_join(runtime.sql_tables(F.col("query")), ",").alias("tables"), "calls", F.round("mean_ms", 6).alias("mean_ms"))


@query("""with e as (select 't' || user_id % 20 t from events where event_id % 10 <> 0) select x.tab, x.col, count(*) n from e, (select unnest([{'tab': 'a', 'col': 'x'}, {'tab': 'app', 'col': t}, {'tab': 'a', 'col': 'id'}, {'tab': 'b', 'col': 'id'}, {'tab': 'b', 'col': 'size'},
{'tab': '', 'col': 'y'}, {'tab': '', 'col': 'z'}, {'tab': '', 'col': 'kind'}, {'tab': '', 'col': 'coun'}]) x) group by all""")
def sql_log_columns(spark, sf):
    log = runtime.sql_log_json(generated.statement_logs(spark, sf))
    pairs = log.select(F.explode(runtime.sql_columns(F.col("query"))).alias("x")).select(F.col("x.table").alias("tab"), F.col("x.column").alias("col"))
    return pairs.groupBy("tab", "col").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'id' as "column", 'b' model, count(*) uses from events where event_id % 10 <> 0 union all select 'kind', 't2', count(*) from events where event_id % 10 <> 0""")
def column_models(spark, sf):
    log = runtime.sql_log_json(generated.statement_logs(spark, sf)).select(runtime.sql_tables(F.col("query")).alias("tables"), F.explode(runtime.sql_columns(F.col("query"))).alias("x"))
    models = spark.createDataFrame([("b", "id"), ("b", "gone"), ("t2", "kind")], "model string, column string")
    return runtime.column_models(log.select("tables", "x.table", "x.column"), models)


@query("""select 't' || p_partkey as "table", p_partkey symbol_id, n calls from part join (select user_id % 20 u, sum(event_id % 5)::bigint n from events where event_id % 10 <> 0 group by 1) on u = p_partkey where p_partkey <> 2
union all select 't2', 2, sum(event_id % 5)::bigint + coalesce(sum(event_id % 5) filter (user_id % 20 = 2 and false), 0)::bigint from events where event_id % 10 <> 0""")
def table_symbols(spark, sf):
    log = runtime.sql_log_json(generated.statement_logs(spark, sf)).select(runtime.sql_tables(F.col("query")).alias("tables"), "calls")
    return runtime.table_symbols(log, generated.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("name")))


@query("""with e as (select event_id id, user_id u, 1 + event_id % 90 l, event_id % 3 k from events)
select id, 1::bigint trace, case k when 0 then 'python' when 1 then 'jvm' else 'node' end language, case k when 0 then 'src/f' || u || '.py' when 1 then 'F' || u || '.java' else '/srv/f' || u || '.js' end as file, l line, 'load' as function from e
union all select id, 1, case k when 0 then 'python' when 1 then 'jvm' else 'node' end, case k when 0 then 'src/g.py' when 1 then 'G.java' else '/srv/g.js' end, 7, 'save' from e""")
def stack_frames(spark, sf):
    return runtime.stack_frames(generated.stack_logs(spark, sf))


@query("""select event_id id, case event_id % 4 when 0 then 'error' when 1 then 'warn' when 2 then 'info' else case event_id % 3 when 1 then 'error' else 'info' end end severity, 'm' || event_id message, 2 frames from events where event_id % 10 <> 0""")
def stack_json_frames(spark, sf):
    e = F.col("id")
    level = F.when(e % 4 == 0, "FATAL").when(e % 4 == 1, "Warning").when(e % 4 == 2, "debug")
    logs = generated.stack_logs(spark, sf).select("id", F.when(e % 10 == 0, "  ").otherwise(F.to_json(F.struct(level.alias("level"), F.concat(F.lit("m"), e.cast("string")).alias("message"), F.col("text").alias("stack")))).alias("value"))
    events = runtime.stack_json(logs)
    frames = runtime.stack_frames(events).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("frames"))
    return events.join(frames, "id").select("id", "severity", "message", "frames")


@query(f"""select 'r' || p_partkey || case p_partkey % 6 when 0 then '.py' when 1 then '.js' when 2 then '.go' when 3 then '.php' when 4 then '.rb' else '.java' end path, case p_partkey % 6 when 0 then 'GET' when 1 then 'POST' when 2 then 'GET' when 3 then 'PUT' when 4 then 'DELETE' else 'GET' end verb,
'/r' || p_partkey route, 'h' || p_partkey || case when p_partkey % 6 = 4 then '#go' else '' end handler from {_PART}""")
def web_routes(spark, sf):
    return code_analysis.routes(generated.routers(spark, sf)).select("path", "verb", "route", "handler")


@query(f"""with p as (select p_partkey p, p_size s from {_PART}) select 'd' || p || '/Dockerfile' path, 'docker' category, 'FROM' as key, 'base:' || s as value from p where p % 6 = 0 union all select 'd' || p || '/Dockerfile', 'docker', 'EXPOSE', p::varchar from p where p % 6 = 0
union all select 'd' || p || '/package.json', 'script', 'build', 'b ' || s from p where p % 6 = 1 union all select 'd' || p || '/package.json', 'package', 'name', 'n' || p from p where p % 6 = 1 union all select 'd' || p || '/package.json', 'workspace', 'w/' || s, 'npm' from p where p % 6 = 1
union all select 'd' || p || '/Makefile', 'make', 'all', 'x' || s from p where p % 6 = 2 union all select 'd' || p || '/Makefile', 'make', 'clean', '' from p where p % 6 = 2
union all select 'd' || p || '/Cargo.toml', 'workspace', 'c' || s, 'cargo' from p where p % 6 = 3 union all select 'd' || p || '/Cargo.toml', 'workspace', 'd', 'cargo' from p where p % 6 = 3
union all select 'd' || p || '/.env.example', 'env', 'KEY_' || p, s::varchar from p where p % 6 = 4 union all select 'd' || p || '/compose.yml', 'service', 'web' || p, '' from p where p % 6 = 5""")
def project_manifests(spark, sf):
    return code_analysis.manifests(generated.manifests(spark, sf))


@query(f"""select 'api' || p_partkey || '.json' path, 'operation' kind, 'GET /p' || p_partkey as name, 's' || p_partkey summary, 'A' || p_partkey refs from {_PART} union all select 'api' || p_partkey || '.json', 'schema', 'A' || p_partkey, 'd', 'B' from {_PART}
union all select 'api' || p_partkey || '.json', 'schema', 'B', '', '' from {_PART}""")
def api_specifications(spark, sf):
    return parsing.api(generated.specifications(spark, sf)).withColumn("refs", F.array_join("refs", ","))


@query(f"""select 'models/m' || p_partkey || '.sql' path, 'ref' kind, 'm' || (p_partkey + 1) as name from {_PART} union all select 'models/m' || p_partkey || '.sql', 'source', 'raw.r' || p_partkey % 4 from {_PART}""")
def model_directives(spark, sf):
    return parsing.directives(generated.templates(spark, sf))


@query(f"""select 'models/m' || p_partkey || '.sql' src, 'models/m' || (p_partkey + 1) || '.sql' dst from {_PART} where p_partkey < (select max(p_partkey) from {_PART})""")
def model_edges(spark, sf):
    files = generated.templates(spark, sf)
    return parsing.model_edges(parsing.directives(files), files)


@query(f"""select 'models/m' || p_partkey || '.sql' path, 'select __jinja__ from m' || (p_partkey + 1) || ' join r' || p_partkey % 4 || ' where 1' as sql from {_PART}""")
def plain_models(spark, sf):
    return parsing.plain_sql(generated.templates(spark, sf))
