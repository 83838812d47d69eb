"""Queries over nested sections (conversations), stores and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import runtime, sections, storage
from sextant.plans.registry import registry
from sextant.sources import tables
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

_S = """s as (select conv_id * 1000 + turn id, conv_id doc, turn, case when turn > 0 then conv_id * 1000 + (turn - 1) // 2 end parent_id, (floor(log2(turn + 1.0 + 1e-9)) + 1)::int level, role || ' ' || turn title, text as content,
sum(strlen(text)) over (partition by conv_id order by turn) - strlen(text) byte_start, sum(strlen(text)) over (partition by conv_id order by turn) byte_end from conversations)"""
_PATHS = f"with recursive {_S}, b as (select id, 0 depth, [title] path from s where parent_id is null union all select s.id, depth + 1, list_append(path, title) from s join b on s.parent_id = b.id)"


@query(_PATHS + " select id, depth, array_to_string(path, ' > ') path from b")
def breadcrumbs(spark, sf):
    return sections.breadcrumbs(tables.threads(spark, sf)).withColumn("path", F.array_join("path", " > "))


@query(_PATHS + " select doc, row_number() over (partition by doc order by byte_start, id) place, id, depth, title from s join b using (id)")
def document_outline(spark, sf):
    return sections.outline(tables.threads(spark, sf))


@query(_PATHS + ", k as (select parent_id id, count(*) children from s where parent_id is not null group by 1) select s.id, array_to_string(path, ' > ') path, coalesce(children, 0) children, row_number() over (partition by doc, parent_id order by byte_start, s.id) place from s join b on b.id = s.id left join k on k.id = s.id")
def toc_tree(spark, sf):
    return sections.toc_tree(tables.threads(spark, sf))


@query(_PATHS + ", k as (select parent_id id, count(*) children from s where parent_id is not null group by 1) select s.id, array_to_string(path, ' > ') breadcrumb, coalesce(children, 0) children, lag(s.id) over w prev_id, lead(s.id) over w next_id, (byte_end - byte_start)::bigint as bytes from s join b on b.id = s.id left join k on k.id = s.id window w as (partition by doc order by byte_start, s.id)")
def described_sections(spark, sf):
    return sections.describe(tables.threads(spark, sf))


@query(f"with {_S} select id, content, id % 5 <> 0 ok from s where turn % 2 = 0")
def verified_sections(spark, sf):
    s = tables.threads(spark, sf)
    hashes = s.select("id", F.when(F.col("id") % 5 != 0, F.sha2(F.col("content").cast("binary"), 256)).otherwise("old").alias("content_hash"))
    return sections.get(s, s.where("turn % 2 = 0").select("id"), hashes)


@query(f"""with recursive {_S}, w as (select id from s where turn = 3), up as (select w.id, s.id other, s.parent_id above, 0 step from w join s using (id) union all select up.id, s.id, s.parent_id, step - 1 from up join s on s.id = up.above),
o as (select id, other, step from up union all select w.id, s.id, 1 from w join s on s.parent_id = w.id), c as (select o.*, greatest(1, floor(strlen(content) / 4))::int tokens, byte_start from o join s on s.id = other),
q as (select *, row_number() over (partition by id order by step, byte_start, other) r from c),
p as (select id, r, other, step, tokens, case when tokens <= 150 then tokens else 0 end used, tokens <= 150 took from q where r = 1 union all select q.id, q.r, q.other, q.step, q.tokens, p.used + case when p.used + q.tokens <= 150 then q.tokens else 0 end, p.used + q.tokens <= 150 from p join q on q.id = p.id and q.r = p.r + 1)
select id, other, case when step < 0 then 'ancestor' when step = 0 then 'self' else 'child' end part, tokens from p where took""")
def section_context(spark, sf):
    s = tables.threads(spark, sf)
    return sections.context(s, s.where("turn = 3").select("id"), 150)


@query(f"with recursive {_S}, t as (select id as node, 0 depth from s where turn = 1 union all select s.id, depth + 1 from s join t on s.parent_id = t.node) select node, depth from t where depth > 0")
def section_descendants(spark, sf):
    s = tables.threads(spark, sf)
    return sections.descendants(s, s.where("turn = 1").select("id"))


@query(f"""with {_S}, w as (select id, parent_id above from s where turn % 3 = 0), n as (select id, 'parent' kind, above other from w where above is not null union all select w.id, 'child', s.id from w join s on s.parent_id = w.id
union all select w.id, 'sibling', s.id from w join s on s.parent_id = w.above where s.id <> w.id
union all select w.id, 'cousin', s.id from w join s p on p.id = w.above join s a on a.parent_id = p.parent_id and a.id <> p.id join s on s.parent_id = a.id)
select id, kind, other from (select *, row_number() over (partition by id, kind order by other) r from n) where r <= 10""")
def section_neighbourhood(spark, sf):
    s = tables.threads(spark, sf)
    return sections.neighbours(s, s.where("turn % 3 = 0").select("id"), cousins=True)


@query("""with c as (select doc_id id, split_part(text, chr(10), 1) title, regexp_replace(text, '(?m)^\\s*(?:#.*|```.*|[-*>|].*)$', '', 'g') t from documents), l as (select id, title, trim(regexp_extract(t, '(?s)^\\s*([^\\n]*)', 1)) line from c)
select id, substr(case when regexp_extract(line, '^(.*?[.!?])(?:\\s|$)', 1) <> '' then regexp_extract(line, '^(.*?[.!?])(?:\\s|$)', 1) when line <> '' then line else title end, 1, 120) summary from l""")
def section_summaries(spark, sf):
    return tables.sections(spark, sf).select("id", sections.summary(F.col("title"), F.col("content")).alias("summary"))


_BLOCKS = "(select p_partkey id, 'd' || p_size doc, case p_partkey % 3 when 0 then 'Py' when 1 then 'sh' else 'md' end lang, string_split(lower(p_name || ' ' || p_type), ' ') words from part)"


@query(f"""with b as (select * from {_BLOCKS} where lower(lang) = 'py' and (doc like 'd1%')), d as (select count(*)::double n, avg(len(words)) avgdl from b), t as (select id, len(words) dl, unnest(words) term from b), f as (select id, dl, term, count(*) tf from t where term in ('widget', 'promo') group by all),
g as (select term, count(*) df from f group by term) select id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score from f join g using (term), d group by id order by score desc, id limit 10""")
def code_examples(spark, sf):
    p = F.col("p_partkey")
    blocks = table(spark, sf, "part").select(p.alias("id"), F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("doc"), F.when(p % 3 == 0, "Py").when(p % 3 == 1, "sh").otherwise("md").alias("lang"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("words"))
    return sections.code_examples(blocks, ["widget", "promo"], "py", "d1*")


def _code(spark, sf):
    return table(spark, sf, "part").select(F.when(F.col("p_partkey") % 4 == 0, "md").otherwise("py").alias("lang"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x\n## "), "p_name")).otherwise(F.col("p_name")).alias("content"))


_SKIPS = f"{_S}, j as (select id, level - lag(level) over (partition by doc order by byte_start, id) jump from (select *, case when turn % 5 = 4 then level + 2 else level end as l2 from s) where level > 0)"


@query(f"with {_SKIPS} select (select count(*) from part where p_partkey % 3 = 0 and p_partkey % 4 <> 0) swallowed, (select count(*) from j where jump > 1) level_skips, (select count(*) from part where p_partkey % 3 = 0 and p_partkey % 4 <> 0) + (select count(*) from j where jump > 1) warnings")
def outline_warnings(spark, sf):
    return sections.structure(tables.threads(spark, sf), _code(spark, sf))


@query(f"""with {_SKIPS}, h as (select id, 'r' || turn % 3 role, case when turn % 4 = 0 then 'stale' when turn % 4 = 1 then 'edited' else 'fresh' end state from s)
select 'sections' measure, '' what, count(*) n from s union all select 'documents', '', count(distinct doc) from s union all select 'role', role, count(*) from h group by role union all select 'freshness', state, count(*) from h group by state
union all select 'broken_links', '', count(*) from s where turn = 5 union all select 'orphans', '', count(*) from s where turn = 6 union all select 'structure', 'warnings', (select count(*) from part where p_partkey % 3 = 0 and p_partkey % 4 <> 0) + (select count(*) from j where jump > 1)""")
def doc_health(spark, sf):
    s, t = tables.threads(spark, sf), F.col("turn")
    roles = s.select("id", F.concat(F.lit("r"), (t % 3).cast("string")).alias("role"))
    states = s.select("id", F.when(t % 4 == 0, "stale").when(t % 4 == 1, "edited").otherwise("fresh").alias("state"))
    return sections.health(s, roles, states, s.where("turn = 5"), s.where("turn = 6"), _code(spark, sf))


_LINKS = "(select p_partkey src, (p_partkey * 7 + 3) % (select count(*) from part) target from part where p_partkey % 4 <> 0)"


@query(f"with recursive l as {_LINKS}, t as (select 5::bigint node, 0 depth union select src, depth + 1 from l join t on target = node where depth < 3) select node, min(depth) depth from t group by node having min(depth) > 0")
def doc_blast_radius(spark, sf):
    n, p = table(spark, sf, "part").count(), F.col("p_partkey")
    links = table(spark, sf, "part").where("p_partkey % 4 <> 0").select(p.alias("src"), ((p * 7 + 3) % n).alias("target"))
    return sections.blast_radius(links, spark.createDataFrame([(5,)], "node long"))


@query(f"""with {_S}, d as (select id, turn = 2 path, case when turn % 3 = 1 then turn else 0 end anchors, doc % 5 inbound, turn * 5 as days, doc from s)
select id, case when path then 'tutorial_path_blocking' when anchors > 0 then 'anchor_referenced' when inbound >= 3 then 'backlinks_blocking' when days <= 14 then 'recently_edited_blocking' else 'safe_to_delete' end verdict,
array_to_string(list_filter([case when path then 'tutorial_path_membership' end, case when anchors > 0 then 'anchor_reference' end, case when inbound >= 3 then 'transitive_backlinks' end, case when days <= 14 then 'recently_edited' end], lambda x: x is not null), ',') blockers from d""")
def section_delete_checks(spark, sf):
    s = tables.threads(spark, sf)
    inbound = s.select("doc").distinct().select("doc", (F.col("doc") % 5).alias("n"))
    return sections.delete_check(s, s.where("turn = 2"), s.where("turn % 3 = 1").select("id", F.col("turn").alias("n")), inbound, s.select("id", (F.col("turn") * 5).alias("days_ago")))


@query("""select id as section, p_partkey as symbol, count(*) uses from (select doc_id id, unnest(['f' || doc_id % 50, 'f' || doc_id % 50, 'g' || doc_id % 7]) as name from documents) join part on 'f' || p_partkey = name group by all""")
def code_block_symbols(spark, sf):
    d = F.col("doc_id")
    text = F.concat(F.lit("x = f"), (d % 50).cast("string"), F.lit("(1)\nf"), (d % 50).cast("string"), F.lit(" (g"), (d % 7).cast("string"), F.lit("())"))
    blocks = table(spark, sf, "documents").select(d.alias("section"), text.alias("content"))
    return sections.code_links(blocks, table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name")))


@query("select p_partkey as symbol from part where p_partkey not in (select doc_id % 100 from documents)")
def undocumented_symbols(spark, sf):
    spans = table(spark, sf, "documents").select(F.col("doc_id").alias("section"), F.concat(F.lit("f"), (F.col("doc_id") % 100).cast("string"), F.lit("()")).alias("code"))
    return sections.undocumented(table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name")), spans)


@query("""select page_id page, 'p' || k source, case when k % 4 = 0 then 'missing' else 'changed' end reason from (select page_id, unnest([page_id % 20, page_id % 20 + 1]) k from pages) where k % 4 = 0 or k % 3 = 0""")
def stale_pages(spark, sf):
    p = F.col("page_id")
    source = lambda k: F.struct(F.concat(F.lit("p"), k.cast("string")).alias("path"), F.concat(F.lit("h"), k.cast("string")).alias("hash"))
    pages = table(spark, sf, "pages").select(p.alias("page"), F.array(source(p % 20), source(p % 20 + 1)).alias("sources"))
    now = spark.range(0, 21).where("id % 4 <> 0").select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.concat(F.when(F.col("id") % 3 == 0, "new").otherwise("h"), F.col("id").cast("string")).alias("hash"))
    return sections.stale_pages(pages, now)


@query(f"with {_S} select id, case when turn % 4 = 0 then 'stale' else 'edited' end state from s where turn % 4 in (0, 1)")
def recent_doc_changes(spark, sf):
    t = F.col("turn")
    return sections.recent_changes(tables.threads(spark, sf).select("id", F.when(t % 4 == 0, "stale").when(t % 4 == 1, "edited").otherwise("fresh").alias("state")))


@query(f"""with {_S}, l as (select conv_id src, conv_id + 1 target from conversations where turn > 0 and turn % 2 = 0), o as (select src, count(*) n from l group by 1), d as (select doc, count(*) k from s group by 1)
select count(*) documents, sum(k)::bigint sections, coalesce(sum(n), 0)::bigint links, round(avg(coalesce(n, 0)), 6) mean_links, count(*) filter (n is null) silent from d left join o on src = doc""")
def wiki_stats(spark, sf):
    s = tables.threads(spark, sf)
    return sections.wiki_stats(s, s.where("turn > 0 and turn % 2 = 0").select(F.col("doc").alias("src"), (F.col("doc") + 1).alias("target")))


@query("select p_partkey id, round(case when p_partkey % 2 = 0 then 0.60 * p_size / 50 + 0.25 * 0.5 + 0.15 * 0.25 else 0.70 * 0.5 + 0.30 * 0.25 end, 4) score from part")
def section_pair_scores(spark, sf):
    cos = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 50)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), sections.combined_score(F.lit(0.25), F.lit(0.5), cos).alias("score"))


@query("""select coalesce(a.p_brand, b.p_brand) as file, case when a.p_brand is null then 'add' when b.p_brand is null then 'delete' else 'modify' end as action, b.h as hash from (select p_brand, count(*)::varchar h from part where p_size <= 25 and p_brand not like '%1' group by 1) a
full join (select p_brand, count(*)::varchar h from part where p_size > 25 and p_brand not like '%2' group by 1) b on a.p_brand = b.p_brand where a.h is null or b.h is null or a.h <> b.h""")
def branch_delta(spark, sf):
    half = lambda test: table(spark, sf, "part").where(test).groupBy(F.col("p_brand").alias("file")).agg(F.count(F.lit(1)).cast("string").alias("hash"))
    return storage.branch_delta(half("p_size <= 25 and p_brand not like '%1'"), half("p_size > 25 and p_brand not like '%2'"))


@query("""select 'found' as part, count(*) n from documents where length(text) % 3 = 0 union all select 'to do', count(distinct sha256(text)) from documents where sha256(text) not in (select sha256(text) from documents where length(text) % 3 = 0)""")
def embedding_cache(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.length("text").alias("n"))
    cache = d.where("n % 3 = 0").select("content_hash", F.array(F.lit(1.0)).alias("vec")).dropDuplicates(["content_hash"])
    found, rest = storage.missing_embeddings(d.select("id", "content_hash"), cache)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return one(found, "found").union(one(rest, "to do"))


@query("""select o_custkey % 10 org, o_orderpriority seat, o_orderdate::date as day, sum(o_orderkey % 1000)::bigint tokens, count(*) calls from orders group by all""")
def seat_reports(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("org"), F.col("o_orderpriority").alias("seat"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 1000).alias("tokens"), F.lit(1).cast("long").alias("calls"), "o_orderkey")
    return storage.seat_report(o.where("o_orderkey % 2 = 0").drop("o_orderkey"), o.where("o_orderkey % 2 = 1").drop("o_orderkey"))


@query("select user_id as session, count(*) calls, sum(event_id % 500)::bigint tokens_saved, round(sum(event_id % 500) / 1e6 * 15, 6) cost_avoided from events group by 1")
def session_statistics(spark, sf):
    return storage.session_stats(table(spark, sf, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 500).alias("saved")))


_COLUMNS = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "big": "boolean", "note": "string", "p_retailprice": "double"}


def _rows(spark, sf):
    p = F.col("p_partkey")
    note = F.when(p % 5 == 0, F.lit("a\tb\\c\nd")).when(p % 5 == 1, F.lit("@at")).when(p % 5 == 2, F.lit("@@7"))
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", (F.col("p_size") > 25).alias("big"), note.alias("note"), "p_retailprice")


@query("""select p_partkey, p_name, p_brand, p_size > 25 big, case p_partkey % 5 when 0 then 'a' || chr(9) || 'b\\c' || chr(10) || 'd' when 1 then '@at' when 2 then '@@7' end note, p_retailprice from part""")
def encoded_rows_decoded(spark, sf):
    lines, legend = storage.encode_rows(_rows(spark, sf), list(_COLUMNS), ["p_name", "p_brand"])
    return storage.decode_rows(lines, legend, _COLUMNS, ["p_name", "p_brand"])


@query("""with j as (select sum(strlen('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '"}')) n, sum(strlen(p_partkey || chr(9) || p_name || chr(9) || p_brand)) m from part) select 1 - m / n >= 0.15 compact from j""")
def size_gate(spark, sf):
    cols = ["p_partkey", "p_name", "p_brand"]
    p = table(spark, sf, "part").select(F.octet_length(F.to_json(F.struct(*cols))).alias("n"), F.octet_length(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols])).alias("m"))
    return p.agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select(storage.size_gate(F.col("n"), F.col("m")).alias("compact"))


@query("""with a as (select p_type axis, round(avg(p_size), 4) score from part where p_partkey % 2 = 0 group by 1), b as (select p_type axis, round(avg(p_size), 4) score from part where p_partkey % 2 = 1 group by 1)
select coalesce(a.axis, b.axis) axis, a.score was, b.score now, round(coalesce(b.score, 0) - coalesce(a.score, 0), 6) delta, case when round(coalesce(b.score, 0) - coalesce(a.score, 0), 6) > 0.5 then 'improved' when round(coalesce(b.score, 0) - coalesce(a.score, 0), 6) < -0.5 then 'regressed' else 'unchanged' end verdict from a full join b on a.axis = b.axis""")
def radar_changes(spark, sf):
    half = lambda k: table(spark, sf, "part").where(F.col("p_partkey") % 2 == k).groupBy(F.col("p_type").alias("axis")).agg(F.round(F.avg("p_size"), 4).alias("score"))
    return storage.radar_diff(half(0), half(1), 0.5)


@query("""with s as (select p_partkey symbol_id, p_brand as file, p_size::bigint * 20 as s, case when p_partkey % 3 > 0 then p_size::bigint * 20 + 5 + p_partkey % 90 end as e from part), p as (select event_id, 'Brand#' || (1 + user_id % 25) as file, 1 + event_id % 1500 as line from events),
c as (select event_id, symbol_id, row_number() over (partition by event_id order by e - s, symbol_id) r from p join s on p.file = s.file and line between s and e where e is not null), o as (select event_id, symbol_id, row_number() over (partition by event_id order by s desc, symbol_id) r from p join s on p.file = s.file and line >= s where e is null and event_id not in (select event_id from c))
select event_id point_id, symbol_id from c where r = 1 union all select event_id, symbol_id from o where r = 1""")
def innermost_with_open_ends(spark, sf):
    e, p = F.col("event_id"), F.col("p_partkey")
    points = table(spark, sf, "events").select(e.alias("point_id"), F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("file"), (1 + e % 1500).alias("line"))
    start = F.col("p_size").cast("long") * 20
    spans = table(spark, sf, "part").select(p.alias("symbol_id"), F.col("p_brand").alias("file"), start.alias("start"), F.when(p % 3 > 0, start + 5 + p % 90).alias("end"))
    return runtime.innermost(points, spans, few=100_000)
