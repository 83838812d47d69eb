"""Queries over symbols (part) and commits (orders): filters, ranking, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text
from sextant.operators import metrics, predicates, search
from sextant.plans.registry import registry
from sextant.sources import tables
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

SYMBOLS = "(select p_partkey id, p_name name, lower(p_type) kind, p_brand file, p_size cyclomatic, concat_ws(' ', p_name, p_type) summary, floor(p_retailprice)::bigint byte_length from part)"
COMMITS = "(select distinct o_orderkey sha, o_orderdate ts, o_custkey author, o_orderpriority subject, l_partkey file from orders join lineitem on l_orderkey = o_orderkey)"


@query(f"""select id, name, kind, file, cyclomatic from {SYMBOLS} where kind in ('economy', 'promo') and cyclomatic >= 10 and file like 'Brand#2%' and lower(summary) like '%e%'
order by cyclomatic desc, id limit 50""")
def winnow(spark, sf):
    criteria = [{"axis": "kind", "op": "in", "value": ["economy", "promo"]}, {"axis": "complexity", "op": ">=", "value": 10}, {"axis": "file", "op": "matches", "value": "Brand#2*"}, {"axis": "summary", "op": "contains", "value": "e"}]
    return predicates.winnow(tables.symbols(spark, sf), criteria, limit=50).select("id", "name", "kind", "file", "cyclomatic")


@query(f"""with t as (select id, name, case when id::varchar = '17' then 1 when name = '17' then 2 when lower(name) = '17' then 3 end tier from {SYMBOLS})
select id, name, tier from t where tier = (select min(tier) from t)""")
def find_symbol(spark, sf):
    return predicates.find_symbol(tables.symbols(spark, sf), "17").select("id", "name", "tier")


@query(f"select kind, count(*) n, round(avg(cyclomatic), 6) avg_cyclomatic, max(byte_length) longest from {SYMBOLS} group by kind")
def symbols_by_kind(spark, sf):
    return tables.symbols(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cyclomatic"), 6).alias("avg_cyclomatic"), F.max("byte_length").alias("longest"))


@query(f"select round(avg(cyclomatic), 2) avg_complexity from {SYMBOLS} where cyclomatic > 0")
def average_complexity(spark, sf):
    return metrics.average_complexity(tables.symbols(spark, sf))


@query(f"""select file, id, name, cyclomatic from (select *, row_number() over (partition by file order by kind, byte_length desc, id) r from {SYMBOLS}) where r <= 5""")
def top_symbols_per_file(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("kind", F.desc("byte_length"), "id")
    return tables.symbols(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 5").select("file", "id", "name", "cyclomatic")


@query(f"""select id, name, case when lower(name) = 'p' then 50.0 when lower(name) like 'p%' then 30.0 when contains(id::varchar, 'p') then 20.0 else 0.0 end score from {SYMBOLS}""")
def identity_scores(spark, sf):
    return tables.symbols(spark, sf).select("id", "name", text.identity(F.col("name"), F.col("id").cast("string"), "p").alias("score"))


@query(f"""select id, name, levenshtein(lower(name), 'green metallic') distance from {SYMBOLS} order by distance, id limit 25""")
def fuzzy_names(spark, sf):
    return tables.symbols(spark, sf).select("id", "name", F.levenshtein(F.lower("name"), F.lit("green metallic")).alias("distance")).orderBy("distance", "id").limit(25)


@query(f"""with g as (select id, list_distinct(list_transform(range(1, greatest(length(name) - 1, 2)), lambda i: substr(lower(name), i::int, 3))) t from {SYMBOLS}),
q as (select list_distinct(list_transform(range(1, length('blue steel') - 1), lambda i: substr('blue steel', i::int, 3))) t)
select g.id, round(len(list_intersect(g.t, q.t)) / len(list_distinct(list_concat(g.t, q.t))), 6) score from g, q order by score desc, g.id limit 25""")
def trigram_similarity(spark, sf):
    score = F.round(predicates.jaccard(predicates.trigrams(F.col("name")), predicates.trigrams(F.lit("blue steel"))), 6)
    return tables.symbols(spark, sf).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(25)


_STEM_SQL = "case when length(w) < 5 then w " + " ".join(
    f"when w like '%{s}' and length(w) - {len(s)} >= {k} then concat(substr(w, 1, length(w) - {len(s)}), '{r}')" for s, r, k in text.STEM_RULES) + " when regexp_matches(w, '[^s]s$') then substr(w, 1, length(w) - 1) else w end"


@query(f"""select w as word, {_STEM_SQL} as stem, count(*) n from (select unnest(list_transform(regexp_extract_all(regexp_replace(summary, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[a-zA-Z0-9]{{2,}}'), lambda x: lower(x))) w from {SYMBOLS}) group by w""")
def code_word_stems(spark, sf):
    words = tables.symbols(spark, sf).select(F.explode(text.code_words(F.col("summary"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", text.stem(F.col("word")).alias("stem"), "n")


@query(f"select file, count(distinct sha) churn from {COMMITS} where ts >= timestamp '2000-01-01' group by file")
def file_churn(spark, sf):
    return metrics.churn(tables.commit_files(spark, sf), "2000-01-01 00:00:00")


@query(f"""with c as (select file, count(distinct sha) commits, count(distinct author) authors, min(ts) first_ts, max(ts) last_ts from {COMMITS} where ts >= timestamp '2001-01-01' group by file)
select *, round(commits / (210 / 7.0), 4) per_week, case when round(commits / (210 / 7.0), 4) <= 1 then 'stable' when round(commits / (210 / 7.0), 4) <= 3 then 'active' else 'volatile' end assessment from c""")
def churn_rate(spark, sf):
    return metrics.churn_rate(tables.commit_files(spark, sf), "2001-01-01 00:00:00", 210)


@query(f"""with c as (select file, count(distinct sha) churn from {COMMITS} where ts >= timestamp '2000-01-01' group by file),
s as (select id, name, cyclomatic, coalesce(churn, 0) churn, round(cyclomatic * ln(1 + coalesce(churn, 0)), 4) score from {SYMBOLS} left join c on c.file = id where cyclomatic >= 2)
select *, case when score > 10 then 'high' when score > 3 then 'medium' else 'low' end assessment from s order by score desc, id limit 50""")
def hotspots(spark, sf):
    return metrics.hotspots(tables.symbols(spark, sf), metrics.churn(tables.commit_files(spark, sf), "2000-01-01 00:00:00"), top=50)


_SUBJECTS = ["Revert the change", "Move files, rename modules", "hotfix of a crash", "make it faster", "Simplify and clean up", "tests of the parser", "README", "bump deps", "implement a reader", "weekly merge"]
_CASES = " ".join(f"when regexp_matches(subject, '(?i){p}') then '{c}'" for c, p in predicates.COMMIT_CATEGORIES)


@query(f"""with s as (select {_SUBJECTS!r}[1 + o_orderkey % 10] || ' ' || o_orderpriority subject from orders) select category, count(*) n, min(subject) sample from (select subject, case {_CASES} else 'evolution' end category from s) group by category""")
def commit_categories(spark, sf):
    subject = F.concat(F.element_at(F.array(*map(F.lit, _SUBJECTS)), (1 + F.col("o_orderkey") % 10).cast("int")), F.lit(" "), "o_orderpriority")
    named = table(spark, sf, "orders").select(subject.alias("subject")).withColumn("category", predicates.classify(F.col("subject")))
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("sample"))


@query(f"""select p_brand as file, p_type as language, count(*) n from part group by rollup(p_brand, p_type)""")
def repo_outline(spark, sf):
    return table(spark, sf, "part").rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("p_brand").alias("file"), F.col("p_type").alias("language"), "n")


@query("select p_brand, p_size, grouping_id(p_brand, p_size)::bigint g, count(*) n from part group by grouping sets ((p_brand), (p_size), (p_brand, p_size), ())")
def grouping_sets(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("__parts")
    return spark.sql("select p_brand, p_size, grouping_id(p_brand, p_size) g, count(*) n from __parts group by grouping sets ((p_brand), (p_size), (p_brand, p_size), ())")


@query(f"""with l as (select id, file, name, 0.5 * cyclomatic / 50 + 0.5 * byte_length / (select max(byte_length) from {SYMBOLS}) s from {SYMBOLS}),
a as (select id, row_number() over (order by cyclomatic desc, id) r from {SYMBOLS}), b as (select id, row_number() over (order by byte_length desc, id) r from {SYMBOLS})
select a.id, round(1.0 / (60 + a.r) + 0.4 / (60 + b.r), 6) score from a join b on a.id = b.id order by score desc, a.id limit 30""")
def rank_fusion(spark, sf):
    s = tables.symbols(spark, sf)
    channels = search.ranked(s.select("id", F.col("cyclomatic").alias("score")), "complexity").unionByName(search.ranked(s.select("id", F.col("byte_length").alias("score")), "size"))
    return search.fuse(channels, {"complexity": 1.0, "size": 0.4}).orderBy(F.desc("score"), "id").limit(30)


@query()
def packed_context(spark, sf):
    s = tables.symbols(spark, sf).select("id", "file", F.col("cyclomatic").cast("double").alias("score"), F.floor(F.col("byte_length") / 4).alias("tokens"))
    return search.pack(s, 4000)


@query(f"""with s as (select name, max(cyclomatic) top1, min(cyclomatic) top2, case min(id) % 3 when 0 then 1.0 when 1 then 0.6 else 0.7 end ident, case when max(id) % 2 = 0 then 0.6 else 1.0 end fresh from {SYMBOLS} group by name),
c as (select *, least(1.0, case when top1 > 0 then (top1 - top2) / top1 else 0 end) gap, 1 - exp(-top1 / 4.0) strength from s)
select name, round(exp(0.35 * ln(greatest(gap, 1e-6)) + 0.35 * ln(greatest(strength, 1e-6)) + 0.15 * ln(ident) + 0.15 * ln(fresh)), 3) confidence from c""")
def result_confidence(spark, sf):
    s = tables.symbols(spark, sf).groupBy("name").agg(F.max("cyclomatic").alias("a"), F.min("cyclomatic").alias("b"), F.min("id").alias("i"), F.max("id").alias("j"))
    known = F.when(F.col("i") % 3 == 0, True).when(F.col("i") % 3 == 1, False)
    return s.select("name", metrics.confidence(F.col("a"), F.col("b"), known, F.col("j") % 2 == 0).alias("confidence"))


@query(f"""select id, case when lower(name) = 'blue' then 30 when lower(name) like 'blue%' then 15 when lower(name) like '%blue%' then 5 else 0 end + case when list_contains(string_split(lower(summary), ' '), 'blue') then 8 when lower(summary) like '%blue%' then 2 else 0 end score
from {SYMBOLS} order by score desc, id limit 20""")
def column_search(spark, sf):
    s = tables.symbols(spark, sf).select("id", search.column_score(F.col("name"), F.col("summary"), "blue").alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(20)


@query(f"select id, greatest(0, floor((byte_length * 10 - byte_length) / 4))::bigint saved from {SYMBOLS}")
def token_savings(spark, sf):
    return tables.symbols(spark, sf).select("id", predicates.token_savings(F.col("byte_length") * 10, F.col("byte_length")).cast("long").alias("saved"))


@query(f"""select count(*) n, round(avg(churn), 6) mean_churn, round(least(1.0, avg(ln(1 + churn) / ln(1 + 1e6))), 6) traffic from (select file, count(distinct sha) churn from {COMMITS} group by file)""")
def traffic(spark, sf):
    c = metrics.churn(tables.commit_files(spark, sf), "1990-01-01 00:00:00")
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("churn"), 6).alias("mean_churn"), F.round(metrics.traffic_score(F.col("churn")), 6).alias("traffic"))


@query("""select o_custkey org, month(o_orderdate) as seat, sum(round(o_totalprice * 100)::bigint)::bigint cents, count(*) calls, max(o_orderdate) updated from orders group by rollup(o_custkey, month(o_orderdate))""")
def org_rollup(spark, sf):
    o = table(spark, sf, "orders").withColumn("m", F.month("o_orderdate"))
    out = o.rollup("o_custkey", "m").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("calls"), F.max("o_orderdate").alias("updated"))
    return out.select(F.col("o_custkey").alias("org"), F.col("m").alias("seat"), "cents", "calls", "updated")
