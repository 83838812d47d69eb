"""Queries over documents, pages, benchmark and conversations: search, similarity, links, content scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.functions import text
from sextant.operators import docs, metrics, predicates, search
from sextant.plans.registry import registry
from sextant.sources import tables
from sextant.sources.tables import table

QUERIES, ORACLE, query = registry()

TERMS = ["anea", "eren", "thly"]
# the words of documentation search, in the subset of regular expressions that both engines share
_WORDS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))"


def _plain_words(column: str):
    return F.filter(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(text.STOP_WORDS))


def _bm25_sql(terms, k1, b, limit):
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""with d as (select doc_id, {_WORDS} w from documents), s as (select doc_id id, len(w)::double dl, list_filter(w, lambda x: x in ({listed})) h from d),
st as (select count(*)::double n, greatest(avg(dl), 1.0) avgdl from s), t as (select id, dl, term, count(*)::double tf from (select id, dl, unnest(h) term from s) group by all),
f as (select term, count(*)::double df from t group by term)
select id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) score from t join f using (term), st group by id order by score desc, id limit {limit}"""


@query(_bm25_sql(TERMS, 1.2, 0.75, 20))
def doc_bm25_search(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _plain_words("text").alias("words"))
    return search.bm25(words, TERMS, k1=1.2).orderBy(F.desc("score"), "id").limit(20)


@query(_bm25_sql(["hethe", "ing"], 1.5, 0.75, 1000000))
def doc_bm25_all(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _plain_words("text").alias("words"))
    return search.bm25(words, ["hethe", "ing"])


@query("select lang as language, count(*) n, sum(length(text))::bigint chars from documents group by lang")
def language_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""select source as doc_path, count(*) sections, sum(length(text))::bigint chars, min(length(text)) shortest, max(length(text)) longest, round(avg(length(text)), 4) mean_chars from documents group by source""")
def doc_stats(spark, sf):
    return docs.describe(tables.sections(spark, sf))


@query("""with l as (select doc_id, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) line from documents), n as (select greatest(3, floor(count(*) * 0.01)) needed from documents)
select line, count(*) n from l where length(line) between 8 and 240 group by line having count(*) >= (select needed from n)""")
def boilerplate_lines(spark, sf):
    return docs.boilerplate_lines(tables.sections(spark, sf), ratio=0.01)


@query("""with l as (select doc_id, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) line from documents), n as (select greatest(3, floor(count(*) * 0.01)) needed from documents),
b as (select list(line) k from (select line from l where length(line) between 8 and 240 group by line having count(*) >= (select needed from n))),
t as (select doc_id id, text was, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not list_contains(k, trim(x))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') c from documents, b)
select id, md5(c) digest, length(was) - length(c) removed from t""")
def boilerplate_stripped(spark, sf):
    s = tables.sections(spark, sf)
    out = docs.strip_boilerplate(s, docs.boilerplate_lines(s, ratio=0.01))
    return out.select("id", F.md5(F.col("content").cast("binary")).alias("digest"), "removed")


_SAT = "(case when {n} > 0 then 1 - exp(-({n}) / {h}) else 0 end)"
_N = "len(regexp_extract_all(text, '{p}'))"


def _n(pattern):
    return _N.format(p=pattern.replace("'", "''"))


@query("select doc_id id, case when length(text) > 0 then round(least(1.0, 0.30 * " + _SAT.format(n=f"({_n(text.DEFINITION)} + {_n(text.BOLD_TERM)})", h="2.0") + " + 0.25 * " + _SAT.format(n=_n(text.IMPERATIVE), h="3.0")
       + f" + 0.20 * (case when {_n(text.FENCE)} // 2 >= 1 then 1 else 0 end) + 0.15 * " + _SAT.format(n=_n(text.NUMBERED), h="3.0") + " + 0.10 * " + _SAT.format(n=_n(text.QUESTION), h="2.0") + ")::decimal(20,12), 4)::double else 0 end score from documents")
def answerability(spark, sf):
    return tables.sections(spark, sf).select("id", text.answerability(F.col("content")).alias("score"))


@query("with c as (select doc_id id, text, len(string_split(text, chr(10))) lines from documents) select id, case when length(text) > 0 then round(least(1.0, 0.35 * round(least(1.0, greatest(0, lines - 5 * (" + _n(text.FENCE) + " // 2)) / greatest(4, lines)), 4) + 0.25 * round("
       + _SAT.format(n=f"({_n(text.DEFINITION)} + {_n(text.BOLD_TERM)})", h="2.0") + ", 4) + 0.30 * round(greatest(0.0, 1 - " + _SAT.format(n=_n(text.SEE_ABOVE), h="1.5") + "), 4) + 0.10 * round(" + _SAT.format(n="lines", h="8.0") + ", 4))::decimal(20,12), 4)::double else 0 end score from c")
def quotability(spark, sf):
    return tables.sections(spark, sf).select("id", text.quotability(F.col("content")).alias("score"))


@query("with r as (select case " + " ".join(f"when regexp_matches(trim(split_part(text, chr(10), 1)), '(?i){p.replace(chr(39), chr(39) * 2)}') then '{r}'" for r, p in text.HEADING_ROLES)
       + f" when {_n(text.QUESTION)} >= 3 and {_n(text.QUESTION)} / len(string_split(text, chr(10))) > 0.05 then 'faq' when {_n(text.NUMBERED)} >= 3 and {_n(text.FENCE)} // 2 >= 2 then 'tutorial'"
       f" when {_n(text.ROLE_IMPERATIVE)} >= 3 and {_n(text.ROLE_IMPERATIVE)} / len(string_split(text, chr(10))) > 0.05 then 'how_to' when {_n(text.FENCE)} // 2 >= 1 and ({_n(text.FENCE)} // 2) / greatest(1.0, len(string_split(text, chr(10))) / 10) >= 1 then 'example' else 'concept' end role, doc_id from documents)"
       " select role, count(*) n, min(doc_id) sample from r group by role")
def section_roles(spark, sf):
    s = tables.sections(spark, sf).withColumn("role", text.role(F.col("title"), F.col("content")))
    return s.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("sample"))


@query()
def redaction_counts(spark, sf):
    """label, docs: in how many documents each kind of secret or trace value was marked."""
    _, fired = text.redact(F.col("text"))
    return table(spark, sf, "documents").select(F.explode(fired).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("docs"))


@query()
def redacted_documents(spark, sf):
    out, fired = text.redact(F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(out.cast("binary")).alias("digest"), F.array_join(fired, ",").alias("labels"))


@query()
def redacted_responses(spark, sf):
    """What a response loses before it is given out: secrets, but no trace values."""
    out, fired = text.redact(F.col("text"), traces=False)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(out.cast("binary")).alias("digest"), F.array_join(fired, ",").alias("labels"))


@query("select page_id src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) target from pages")
def links(spark, sf):
    return tables.links(spark, sf)


@query("with l as (select page_id src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) target from pages) select target, count(distinct src) sources, count(*) links from l group by target")
def backlinks(spark, sf):
    return docs.backlinks(tables.links(spark, sf))


_PATHS = "(select distinct regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') path from pages)"


@query(f"""with l as (select page_id src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) target from pages), i as (select distinct src, regexp_replace(target, '[?#].*$', '') target from l where not regexp_matches(target, '^([A-Za-z][A-Za-z0-9+.-]*:|#|//)'))
select target, src from i where target not in (select path from {_PATHS})""")
def broken_links(spark, sf):
    paths = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "").alias("path"))
    return docs.broken_links(tables.links(spark, sf), paths)


@query(f"""with l as (select page_id src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) target from pages), p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') path from pages)
select page_id doc from p where page_id not in (select p.page_id from l join p on l.target = p.path where l.src <> p.page_id)""")
def orphan_pages(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "").alias("target"))
    edges = tables.links(spark, sf).join(p.withColumnRenamed("doc", "dst"), "target").select("src", "dst")
    return docs.orphans(p.select("doc"), edges)


@query("""select conv_id doc, turn id, lag(turn) over w prev_id, lead(turn) over w next_id from conversations window w as (partition by conv_id order by turn)""")
def section_neighbours(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), F.col("turn").alias("byte_start"))
    return docs.neighbours(c)


@query("""with s as (select conv_id doc, turn id, case role when 'user' then 1 else 2 end lvl from conversations)
select doc, id, (select max(b.id) from s b where b.doc = s.doc and b.id < s.id and b.lvl < s.lvl) parent_id from s""")
def section_hierarchy(spark, sf):
    level = F.when(F.col("role") == "user", 1).otherwise(2)
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), level.alias("level"), F.col("turn").alias("byte_start"))
    return docs.hierarchy(c)


@query("""with t as (select conv_id file, turn line_no, text line, array_to_string(list(text) over (partition by conv_id order by turn rows between 1 preceding and 1 preceding), '') before, array_to_string(list(text) over (partition by conv_id order by turn rows between 1 following and 1 following), '') after from conversations)
select file, line_no, md5(line) line, md5(coalesce(before, '')) before, md5(coalesce(after, '')) after from t where regexp_matches(line, 'the.*ing') order by file, line_no limit 40""")
def text_search_context(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), F.col("text").alias("line"))
    out = search.context_lines(c, "the.*ing", 1, 40)
    md5 = lambda c: F.md5(c.cast("binary"))
    return out.select("file", "line_no", md5(F.col("line")).alias("line"), md5(F.array_join("before", "")).alias("before"), md5(F.array_join("after", "")).alias("after"))


@query("""with s as (select doc_id id, lower(split_part(text, chr(10), 1)) t from documents) select id, case when t = 'the and' then 100 when contains(t, 'the and') then 30 else 0 end + 5 * len(list_intersect(list_distinct(string_split(t, ' ')), ['and', 'the'])) + case when starts_with(t, 'the and') then 10 else 0 end score
from s order by score desc, id limit 30""")
def title_search(spark, sf):
    return tables.sections(spark, sf).select("id", search.title_score(F.col("title"), "the and").alias("score")).orderBy(F.desc("score"), "id").limit(30)


@query("""with w as (select doc_id id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), lambda x: true) w from documents), z as (select id, w, sha256(array_to_string(w, ' ')) k from w where len(w) >= 10), f as (select k, min(id) rep from z group by k),
same as (select rep a, id b, 1.0::double j from z join f using (k) where id <> rep), r as (select z.id, z.w from z join f on z.id = f.rep),
s as (select id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) h from r), n as (select id, count(*) n from s group by id),
p as (select x.id a, y.id b, count(*) c from s x join s y on x.h = y.h and x.id < y.id join n p on p.id = x.id join n q on q.id = y.id where p.n <= 2 * q.n and q.n <= 2 * p.n group by all)
select a, b, j as jaccard from same union all select a, b, round(c / (p.n + q.n - c), 6) from p join n p on p.id = a join n q on q.id = b where c / (p.n + q.n - c) >= 0.85""")
def near_duplicate_sections(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return search.shingle_pairs(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), words.alias("words")))


_COS = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7))"


@query(f"select vec_id id, round({_COS}, 6) score from embeddings where round({_COS}, 6) >= 0.1 order by score desc, id limit 20")
def cosine_top_k(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    wanted = e.where("id = 7").first()
    return search.nearest(e, wanted.vec, 20)


@query(f"""with l as (select vec_id id, label::double score from embeddings where label > 0), s as (select vec_id id, round({_COS}, 6) score from embeddings), x as (select coalesce(l.id, s.id) id, coalesce(l.score / (select max(score) from l), 0) a, coalesce(s.score, 0) b from l full join s on l.id = s.id)
select id, round((0.5 * a + 0.5 * b)::decimal(20,12), 6)::double score from x""")
def hybrid_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 7").first().embedding])
    semantic = e.select(F.col("vec_id").alias("id"), F.round(search.cosine(F.col("embedding"), q), 6).alias("score"))
    return search.hybrid(e.where("label > 0").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("score")), semantic)


@query("""with p as (select a.embedding::double[] x, b.embedding::double[] y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1), d as (select 1 - list_cosine_similarity(x, y) d from p)
select count(*) n, round(avg(d), 6) mean_drift, round(max(d), 6) max_drift, round(max(d), 6) > 0.05 alarm from d""")
def embedding_drift(spark, sf):
    e = table(spark, sf, "embeddings")
    return search.drift(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("vec")))


@query(f"""with r as ({_bm25_sql(TERMS, 1.5, 0.75, 10)}), k as (select id, row_number() over (order by score desc, id) rank from r), g as (select doc_id id from labels where quality = 1),
h as (select rank, (id in (select id from g))::int rel from k)
select 0 query, round(coalesce(sum(rel / log2(rank + 1)), 0) / (select sum(1 / log2(i + 1)) from range(1, 1 + least(10, (select count(*) from g))) t(i)), 6) ndcg, round(coalesce(1.0 / min(rank) filter (rel = 1), 0), 6) mrr, round(coalesce(sum(rel), 0) / (select count(*) from g), 6) recall from h""")
def retrieval_metrics(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _plain_words_all().alias("words"))
    scored = search.bm25(words, TERMS).orderBy(F.desc("score"), "id").limit(10)
    ranked = search.ranked(scored, "q").select(F.lit(0).alias("query"), "id", "rank")
    relevant = table(spark, sf, "labels").where("quality = 1").select(F.lit(0).alias("query"), F.col("doc_id").alias("id"))
    return metrics.retrieval_metrics(ranked, relevant)


def _plain_words_all():
    return _plain_words("text")


@query("""with b as (select item_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')))) h from (select item_id, regexp_extract_all(text, '\\S+') w from benchmark)),
d as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' ')))) h from (select doc_id, regexp_extract_all(text, '\\S+') w from documents)), n as (select item_id, count(*) n from b group by 1)
select item_id, doc_id, count(*) shared, round(count(*) / any_value(n), 6) containment from b join d using (h) join n using (item_id) group by all""")
def benchmark_reuse(spark, sf):
    def shingles(name, key):
        w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
        t = table(spark, sf, name).select(F.col(key), w.alias("w")).where(F.size("w") >= 8)
        return t.select(key, F.explode(text.let(F.col("w"), lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 7, F.lit(1))), lambda i: F.array_join(F.slice(x, i, 8), " "))))).alias("h"))

    b = shingles("benchmark", "item_id")
    n = b.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    out = shingles("documents", "doc_id").join(b, "h").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared")).join(n, "item_id")
    return out.select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


@query("""select p_partkey id, list_contains((select list_distinct(flatten(list(string_split_regex(lower(split_part(text, chr(10), 1)), '[^a-z0-9_]+')))) from documents), lower(p_name)) documented from part""")
def doc_coverage(spark, sf):
    s = tables.symbols(spark, sf).select("id", "name")
    return docs.coverage(s, tables.sections(spark, sf).select("title"))


@query("""select doc_id, regexp_matches(text, '(?i)licen[sc]e') has_license, case when regexp_matches(source, '^src1') then true else false end in_scope from documents""")
def scope_filters(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike("(?i)licen[sc]e").alias("has_license"), predicates.path_matches(F.col("source"), "src1*").alias("in_scope"))


@query("""select source, lang, doc_id from (select *, row_number() over (partition by source, lang order by length(text) desc, doc_id) r from documents) where r <= 3""")
def longest_per_source(spark, sf):
    w = Window.partitionBy("source", "lang").orderBy(F.length("text").desc(), "doc_id")
    return table(spark, sf, "documents").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "lang", "doc_id")
