"""Queries over ranked search: token bags, BM25 by field, channels, fusion, context, barrels, implementations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import imports, parsing, ranking, search
from sextant.plans.registry import registry
from sextant.plans.symbols import _STEM_SQL
from sextant.sources import generated, tables
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

_SHORT = ", ".join(f"('{k}', '{x}')" for k, v in ranking.ABBREVIATIONS.items() for x in v)
_TOKS = "list_transform(regexp_extract_all(regexp_replace({x}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[a-zA-Z0-9]{{2,}}'), lambda v: lower(v))"
#: Symbols with fields: a camel-case name, key words, a signature and a summary.
_FIELDS = "(select p_partkey id, p_brand as file, p_name || ' getConfigs' as name, [p_brand, lower(p_type)] keywords, 'def ' || p_name || '(params, db)' signature, p_type || ' printing sizes of ' || p_name || 's' summary from part)"
_BAG = f"""with recursive short(a, b) as (values {_SHORT}), s as (select * from {_FIELDS}),
f as (select id, 'name' field, 3 times, {_TOKS.format(x='name')} w from s union all select id, 'signature', 2, {_TOKS.format(x='signature')} from s union all select id, 'summary', 1, {_TOKS.format(x='summary')} from s),
t as (select id, field, times, unnest(w) tok, unnest(range(len(w))) i from f), d as (select tok, {_STEM_SQL} st from (select distinct tok, tok as w from t)),
m as (select tok, st form from d where st <> tok union select tok, b from d join short on a = tok union select tok, b from d join short on a = st where st <> tok),
x as (select id, field, times, form, min(i) i0 from t join m using (tok) group by all), r as (select id, field, tok, min(i) r0 from t group by all),
bag as (select id, field, term, sum(tf)::bigint tf from (select id, field, tok term, times tf from t union all select x.id, x.field, form, times from x left join r on r.id = x.id and r.field = x.field and r.tok = x.form where r0 is null or r0 > i0
union all select id, 'keywords', lower(unnest(keywords)), 2 from s) group by all),
dl as (select id, count(distinct term) dl from bag group by id), av as (select count(*) n, avg(dl) avgdl from dl), idf as (select term, ln((max(n) - count(distinct id) + 0.5) / (count(distinct id) + 0.5) + 1) idf, count(distinct id) df from bag, av group by term)"""


def _fields(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.concat("p_name", F.lit(" getConfigs")).alias("name"), F.array("p_brand", F.lower("p_type")).alias("keywords"),
        F.concat(F.lit("def "), "p_name", F.lit("(params, db)")).alias("signature"), F.concat("p_type", F.lit(" printing sizes of "), "p_name", F.lit("s")).alias("summary"))


TERMS = ["widget", "configs", "database", "print"]
_IN = ", ".join(f"'{t}'" for t in TERMS)


@query(_BAG + " select id, field, term, tf from bag")
def token_bags(spark, sf):
    return ranking.token_bag(_fields(spark, sf))


@query(_BAG + " select term, df, round(idf, 9) idf from idf")
def term_statistics(spark, sf):
    return ranking.corpus(ranking.token_bag(_fields(spark, sf)))[0].withColumn("idf", F.round("idf", 9))


@query(_BAG + " select b.term, md5(array_to_string(list_sort(list(distinct b.id)), ',')) ids from bag b join idf using (term) where df <= 500 group by b.term")
def postings(spark, sf):
    found = ranking.postings(ranking.token_bag(_fields(spark, sf)), 500)
    return found.select("term", F.md5(F.array_join("ids", ",").cast("binary")).alias("ids"))


_HIT = f"k as (select id, 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)) k from dl, av), w as (select id, term, sum(tf) tf from bag where term in ({_IN}) group by all), lex as (select id, sum(idf * tf * 2.5 / (tf + k)) score from w join idf using (term) join k using (id) group by id)"


@query(_BAG + f", {_HIT} select id, field, round(sum(idf * tf * 2.5 / (tf + k)), 3) score from bag join idf using (term) join k using (id) where term in ({_IN}) group by all")
def bm25_breakdown(spark, sf):
    return ranking.breakdown(ranking.token_bag(_fields(spark, sf)), TERMS).withColumn("score", F.round("score", 3))


@query(_BAG + f", {_HIT} select id, round(score, 6) score from lex")
def lexical_scores(spark, sf):
    return ranking.lexical(ranking.token_bag(_fields(spark, sf)), TERMS).withColumn("score", F.round("score", 6))


_IDENT = "case when lower(name) = 'big widget getconfigs' then 50.0 when starts_with(lower(name), 'big widget') then 30.0 when contains(id::varchar, 'big widget') then 20.0 else 0.0 end"


@query(_BAG + f""", w as (select id, term, sum(tf) tf from bag where term in ('big', 'widget') group by all), k as (select id, 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)) k from dl, av), lex as (select id, sum(idf * tf * 2.5 / (tf + k)) score from w join idf using (term) join k using (id) group by id)
select id, round(score + {_IDENT.replace("lower(name) = 'big widget getconfigs'", "lower(name) = 'big widget'")}, 6) score from lex join s using (id) order by score desc, id limit 20""")
def weighted_search(spark, sf):
    return ranking.search_symbols(_fields(spark, sf), "big widget", ["big", "widget"])


_CENTRAL = "c as (select p_brand as file, 0.3 * ln(1 + count(*)) bonus from lineitem join part on p_partkey = l_partkey group by 1)"


@query(f"with {_CENTRAL} select file, round(bonus, 6) bonus from c")
def file_centrality(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dst")), "l_partkey")
    return ranking.centrality(lines.select(F.col("l_suppkey").alias("src"), "dst")).withColumn("bonus", F.round("bonus", 6))


def _channels(spark, sf):
    symbols = _fields(spark, sf)
    lex = ranking.lexical(ranking.token_bag(symbols), TERMS).withColumn("score", F.round("score", 6))
    ident = symbols.select("id", ranking.identity_of(F.col("name"), F.col("id"), "big", ["big"]).alias("score"))
    ranks = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("score"))
    return lex, ident, ranks


_CHANNELS = _BAG + f""", {_HIT}, l as (select 'lexical' ch, id, row_number() over (order by round(score, 6) desc, id) r from lex), i as (select 'identity' ch, id, row_number() over (order by id) r from s where starts_with(lower(name), 'big')),
u as (select 'structural' ch, p_partkey id, row_number() over (order by p_size / 50 desc, p_partkey) r from part where p_size > 0), a as (select * from l union all select * from i union all select * from u),
z as (select id, round(sum(case ch when 'lexical' then 1.0 when 'identity' then 2.0 else 0.4 end / (60 + r)), 9) score, array_to_string(list_sort(list(ch)), ',') channels from a group by id)"""


@query(_CHANNELS + " select id, score, channels from z")
def fusion_search(spark, sf):
    lex, ident, ranks = _channels(spark, sf)
    return ranking.fused([ranking.channel(lex, "lexical"), ranking.channel(ident, "identity"), ranking.channel(ranks, "structural")])


@query(_BAG + f", {_HIT}, b as (select max(score) ws from lex), q as (select max(p_size / 50) rs from part) select lex.id, round(0.5 * score / ws + 0.5 * (p_size / 50) / rs, 6) score from lex join part on p_partkey = lex.id, b, q")
def combined_context_scores(spark, sf):
    lex, _, ranks = _channels(spark, sf)
    plain = ranking.lexical(ranking.token_bag(_fields(spark, sf)), TERMS)
    return ranking.combined(plain, ranks.withColumnRenamed("score", "rank"))


@query()
def ranked_context(spark, sf):
    """What fits a budget of 400 tokens, by the combined score, at most three of a file."""
    lex, _, ranks = _channels(spark, sf)
    scored = ranking.combined(lex, ranks.withColumnRenamed("score", "rank"))
    sized = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), (F.col("p_size") + 1).cast("long").alias("tokens"))
    return search.pack(scored.join(sized, "id"), 400).select("id", "file")


_COS = "list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q)))"


@query(f"with v as (select [((i * 7) % 11 - 5)::double for i in range(64)] q) select vec_id id, round({_COS}, 6) score from embeddings, v where {_COS} >= 0.1")
def similarity_channel(spark, sf):
    q = [float((i * 7) % 11 - 5) for i in range(64)]
    return ranking.similar(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q).withColumn("score", F.round("score", 6))


@query(_BAG + f""", {_HIT}, b as (select max(score) ws from lex), v as (select [((i * 7) % 11 - 5)::double for i in range(64)] q), e as (select vec_id id, {_COS} m from embeddings, v where {_COS} >= 0.1)
select coalesce(lex.id, e.id) id, round(0.5 * coalesce(score / ws, 0) + 0.5 * coalesce(m, 0), 6) score from lex cross join b full join e on e.id = lex.id""")
def hybrid_search(spark, sf):
    lex = ranking.lexical(ranking.token_bag(_fields(spark, sf)), TERMS)
    q = [float((i * 7) % 11 - 5) for i in range(64)]
    return ranking.hybrid(lex, ranking.similar(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q))


@query("""with q as (select vec_id id, embedding::double[] v from embeddings where vec_id % 20 = 0), s as (select q.id, e.vec_id other, round(list_cosine_similarity(v, embedding::double[]), 6) score from q join embeddings e on q.id <> e.vec_id)
select id, other, score from (select *, row_number() over (partition by id order by score desc, other) r from s where score >= 0.2) where r <= 5""")
def semantic_neighbours(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return ranking.semantic_neighbours(e, e.where("id % 20 = 0").select("id"), least=0.2)


#: Re-exports among numbered files: file n hands on all of n + 1 (every third), or one name of it under another (others); n % 10 ends a chain.
_RAW = "select n src, n + 1 dst, case when n % 3 = 0 then 'wildcard' else 'selective' end kind, case when n % 3 <> 0 then 'x' || n % 4 end exposed, case when n % 3 <> 0 then 'x' || (n + 1) % 4 end original from (select p_partkey n from part) where n % 10 <> 9"


def _re_exports(spark, sf):
    n = F.col("p_partkey")
    one = lambda k: F.when(n % 3 != 0, F.concat(F.lit("x"), ((n + k) % 4).cast("string")))
    return table(spark, sf, "part").where("p_partkey % 10 <> 9").select(n.alias("src"), (n + 1).alias("dst"), F.when(n % 3 == 0, "wildcard").otherwise("selective").alias("kind"), one(0).alias("exposed"), one(1).alias("original"))


@query(f"with r as ({_RAW}) select 'wildcard' as map, src barrel, null exposed, dst leaf, null original from r where kind = 'wildcard' union all select 'named', src, exposed, dst, original from r where kind = 'selective'")
def re_export_maps(spark, sf):
    wild, named = imports.re_export_maps(_re_exports(spark, sf))
    none = F.lit(None).cast("string")
    return wild.select(F.lit("wildcard").alias("map"), "barrel", none.alias("exposed"), "leaf", none.alias("original")).unionByName(named.select(F.lit("named").alias("map"), "barrel", "exposed", "leaf", "original"))


@query(f"""with recursive r as ({_RAW}), u as (select p_partkey + 100000 src, p_partkey direct, case p_partkey % 5 when 0 then '' else 'x' || p_partkey % 4 end as name from part),
t as (select src, direct, direct as at, name from u union
select t.src, t.direct, r.dst, case when r.kind = 'wildcard' then t.name else r.original end from t join r on r.src = t.at where t.name = '' or r.kind = 'wildcard' or r.exposed = t.name)
select distinct src, t.at as leaf from t""")
def barrel_leaves(spark, sf):
    n = F.col("p_partkey")
    uses = table(spark, sf, "part").select((n + 100000).alias("src"), n.alias("direct"), F.when(n % 5 != 0, F.concat(F.lit("x"), (n % 4).cast("string"))).alias("name"))
    return imports.expand_barrels(uses, *imports.re_export_maps(_re_exports(spark, sf)))


@query("""select p_partkey src, case p_partkey % 3 when 0 then '~/a' when 1 then '~/lib/b' else './c' end || p_partkey specifier, case p_partkey % 3 when 0 then 'web/a' when 1 then 'shared/b' else './c' end || p_partkey target from part""")
def path_aliases(spark, sf):
    n = F.col("p_partkey")
    used = table(spark, sf, "part").select(n.alias("src"), F.concat(F.when(n % 3 == 0, "~/a").when(n % 3 == 1, "~/lib/b").otherwise("./c"), n.cast("string")).alias("specifier"))
    return imports.with_aliases(used, spark.createDataFrame([("~/*", "web/*"), ("~/lib/*", "shared/*"), ("@", "root")], "prefix string, target string"))


@query("""select p_partkey id, case when p_partkey % 2 = 0 then 'App\\Models\\M' || p_partkey || '::run' else 'App\\Sub\\M' || p_partkey end as full_name, case when p_partkey % 2 = 0 then 'src/models/M' || p_partkey || '.php' else 'src/Sub/M' || p_partkey || '.php' end path from part""")
def php_names(spark, sf):
    spaces = {"App\\": "src/", "App\\Models\\": "src/models/"}
    n = F.col("p_partkey")
    path = F.concat(F.when(n % 2 == 0, "src/models/M").otherwise("src/Sub/M"), n.cast("string"), F.lit(".php"))
    named = table(spark, sf, "part").select(n.alias("id"), imports.php_name(path, F.when(n % 2 == 0, "run"), spaces).alias("full_name"))
    return named.select("id", "full_name", imports.php_file(F.col("full_name"), spaces).alias("path"))


@query("""with recursive b as (select 'C' || n as class, case when n % 4 = 0 then 'Root' else 'C' || n // 4 end base, n from (select p_partkey n from part where p_partkey > 0)), t as (select class, 1 d from b where base = 'Root' union select b.class, d + 1 from b join t on b.base = t.class where d < 20)
select 's' || n id, 'subclass' relationship, 0.85 confidence from b where class in (select class from t) and n % 7 <> 0 union all select 's' || n, 'interface_impl', 0.95 from b where n % 7 = 0
union all select 'd' || n, 'decorator_handler', 0.6 from b where n % 11 = 0 union all select 'm' || n, 'duck_typed', 0.5 from b where n % 13 = 0""")
def implementations(spark, sf):
    n = F.col("p_partkey")
    part = table(spark, sf, "part").where("p_partkey > 0")
    name = lambda k: F.concat(F.lit("C"), k.cast("string"))
    bases = part.select(name(n).alias("class"), F.when(n % 4 == 0, "Root").otherwise(name(F.floor(n / 4).cast("long"))).alias("base"))
    none = F.array().cast("array<string>")
    row = lambda df, mark, kind, called, decorators: df.select(F.concat(F.lit(mark), n.cast("string")).alias("id"), called.alias("name"), F.lit(kind).alias("kind"), decorators.alias("decorators"))
    symbols = (row(part, "s", "class", name(n), none).union(row(part.where("p_partkey % 11 = 0"), "d", "function", F.lit("f"), F.array(F.lit("@Root(1)"))))
               .union(row(part.where("p_partkey % 13 = 0"), "m", "method", F.lit("Root"), none)))
    dispatch = part.where("p_partkey % 7 = 0").select(F.lit("Root").alias("interface"), F.lit("").alias("method"), F.concat(F.lit("s"), n.cast("string")).alias("id"))
    return ranking.implementations(symbols, bases, "Root", dispatch)


_FP = "'pkg' || p_partkey % 7 || '/m' || p_partkey || '.py'"


@query(f"""with p as (select p_partkey + 10 p_partkey, p_size from part), w as (select *, {_FP} f from p where p_partkey % 25 = 0) select f || '::f' || p_partkey || '#function' id, 1 part, 'def f' || p_partkey || '(x, *rest)' what from w
union all select f || '::f' || p_partkey || '#function', 2, s from w, (select unnest(['os', '.m', 'pkg']) k) , lateral (select case k when 'os' then 'os' when '.m' then '.m' || (p_partkey - 7) else case when p_partkey % 10 = 9 then 'sys' else 'pkg' || (p_partkey + 1) % 7 || '.m' || (p_partkey + 1) end end s)
union all select f || '::f' || p_partkey || '#function', 3, f || '::C' || p_partkey || '.run#method' from w
union all select f || '::f' || p_partkey || '#function', 3, 'pkg' || (p_partkey + 7) % 7 || '/m' || (p_partkey + 7) || '.py::C' || (p_partkey + 7) || '.run#method' from w where p_partkey + 7 <= (select max(p_partkey) from p)
union all select f || '::f' || p_partkey || '#function', 3, 'tests/test_m' || p_partkey || '.py::test_f' || p_partkey || '#function' from w where p_partkey % 50 = 0""")
def context_bundles(spark, sf):
    files = generated.modules(spark, sf)
    symbols, used = parsing.parsed(files)
    wanted = table(spark, sf, "part").select((F.col("p_partkey") + 10).alias("p")).where("p % 25 = 0").select(F.concat(F.lit("pkg"), (F.col("p") % 7).cast("string"), F.lit("/m"), F.col("p").cast("string"), F.lit(".py::f"), F.col("p").cast("string"), F.lit("#function")).alias("id"))
    return ranking.context_bundle(symbols, wanted, used, parsing.calls(symbols, parsing.edges(used, files)))


@query("""with f as (select p_partkey id, p_brand as file, p_size cyclomatic from part), c as (select distinct l_partkey callee, o_custkey % 400 caller from lineitem join orders on o_orderkey = l_orderkey)
select f.id, f.cyclomatic, count(distinct g.file) caller_files, f.cyclomatic * count(distinct g.file) score from f join c on callee = f.id join f g on g.id = caller where f.file <> g.file and f.cyclomatic >= 5 group by f.id, f.cyclomatic having count(distinct g.file) >= 2""")
def extraction_candidates(spark, sf):
    symbols = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").alias("cyclomatic"), F.lit("function").alias("kind"))
    calls = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("callee"), (F.col("o_custkey") % 400).alias("caller")).distinct()
    return ranking.extraction_candidates(symbols, calls)


@query("""with l as (select conv_id path, turn line, text from conversations) select path, line, text as before, regexp_replace(text, '\\bthe\\b', 'THE', 'g') as after from l where regexp_matches(text, '\\bthe\\b')""")
def rename_plan(spark, sf):
    return ranking.rename_plan(table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), "text"), "the", "THE")


@query("""select * from (select p_partkey id, 'code' as domain, case when contains(lower(p_name), 'widget') then 1.0 else 0.0 end score from part union all select doc_id, 'docs', case when contains(lower(text), 'widget') then 1.0 else 0.0 end from documents) where score > 0""")
def search_units(spark, sf):
    """Units of code and documents under one query, each with its domain."""
    hit = lambda c: F.when(F.lower(c).contains("widget"), 1.0).otherwise(0.0)
    code = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("code").alias("domain"), hit(F.col("p_name")).alias("score"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("docs").alias("domain"), hit(F.col("text")).alias("score"))
    return code.unionByName(docs).where("score > 0")


@query("""select tables.path, content from (select 'a' || conv_id path, string_agg(text, chr(10) order by turn) t from conversations group by 1) tables, lateral (select array_to_string(string_split(t, chr(10))[2:3], chr(10)) content)""")
def file_slices(spark, sf):
    from sextant.operators import sections

    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    files = table(spark, sf, "conversations").groupBy(F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("path")).agg(F.array_join(lines, "\n").alias("content"))
    return sections.file_slice(files, 2, 3)


@query("select vec_id id, array_to_string(list_transform(embedding[1:3], lambda x: (round(x::double, 3) + 0.0)::varchar), ',') head from embeddings where vec_id % 2 = 0 union all select vec_id, 'new' from embeddings where vec_id % 2 = 1")
def embedding_store(spark, sf):
    from sextant.operators import storage

    e = table(spark, sf, "embeddings")
    head = F.array_join(F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 3).cast("string")), ",")
    return storage.upsert(e.select(F.col("vec_id").alias("id"), head.alias("head")), e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("id"), F.lit("new").alias("head")), ["id"])
