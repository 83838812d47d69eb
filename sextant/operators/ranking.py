"""Ranked symbol search: weighted token bags, BM25 with identity and centrality, channels, fusion, hybrid scores, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import code_words, identity, let, stem
from sextant.operators.search import first_ranks

# How often a field's words count, BM25's parameters, the weights of channels and what softens ranks.
FIELDS = {"name": 3, "keywords": 2, "signature": 2, "summary": 1, "docstring": 1}
K1, B = 1.5, 0.75
CHANNELS = {"lexical": 1.0, "structural": 0.4, "similarity": 0.8, "identity": 2.0}
SMOOTHING, CENTRALITY, RANK_WEIGHT = 60, 0.3, 100.0

# Short and long forms of words in code.
ABBREVIATIONS = {
    "db": ["database"], "auth": ["authentication", "authorization"], "config": ["configuration"], "ctx": ["context"], "env": ["environment"], "err": ["error"], "exec": ["execute", "execution"], "fn": ["function"], "func": ["function"],
    "impl": ["implementation", "implement"], "init": ["initialize", "initialization"], "iter": ["iterator", "iterate"], "len": ["length"], "lib": ["library"], "max": ["maximum"], "mem": ["memory"], "min": ["minimum"], "msg": ["message"],
    "num": ["number"], "obj": ["object"], "param": ["parameter"], "params": ["parameters"], "pkg": ["package"], "prev": ["previous"], "proc": ["process", "procedure"], "prop": ["property"], "props": ["properties"], "ref": ["reference"],
    "refs": ["references"], "repo": ["repository"], "req": ["request"], "res": ["response", "result"], "ret": ["return"], "src": ["source"], "str": ["string"], "sync": ["synchronize", "synchronous"], "sys": ["system"], "temp": ["temporary"],
    "tmp": ["temporary"], "val": ["value"], "var": ["variable"], "vars": ["variables"], "database": ["db"], "authentication": ["auth"], "authorization": ["auth"], "configuration": ["config"], "context": ["ctx"], "environment": ["env"],
    "error": ["err"], "execute": ["exec"], "function": ["func", "fn"], "initialize": ["init"], "initialization": ["init"], "iterator": ["iter"], "message": ["msg"], "parameter": ["param"], "parameters": ["params"], "repository": ["repo"],
    "request": ["req"], "response": ["res"], "temporary": ["temp", "tmp"], "variable": ["var"], "variables": ["vars"]}


def _expansions(word: Column) -> Column:
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(table, word), F.array().cast("array<string>"))


def search_words(text: Column) -> Column:
    """The words of a text, each followed by its stem and the other forms of both that the list doesn't hold yet."""
    def more(found: Column, word: Column) -> Column:
        with_word = F.concat(found, F.array(word))
        forms = let(stem(word), lambda s: F.concat(F.array(s), _expansions(word), F.when(s != word, _expansions(s)).otherwise(F.array().cast("array<string>"))))
        return let(with_word, lambda w: F.concat(w, F.array_except(forms, w)))

    return F.aggregate(code_words(F.coalesce(text, F.lit(""))), F.array().cast("array<string>"), more)


def token_bag(symbols: DataFrame) -> DataFrame:
    """id, field, term, tf: words of each field of symbols (id, name, keywords, signature, summary, docstring; those there are), as often as the field counts."""
    parts = []
    for field, times in FIELDS.items():
        if field in symbols.columns:
            words = F.transform(field, lambda k: F.lower(k)) if field == "keywords" else search_words(F.col(field))
            parts.append(F.struct(F.lit(field).alias("field"), F.lit(times).alias("times"), words.alias("words")))
    rows = symbols.select("id", F.inline(F.array(*parts))).select("id", "field", "times", F.explode("words").alias("term"))
    return rows.groupBy("id", "field", "term").agg(F.sum("times").alias("tf"))


def corpus(bag: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row (n, avgdl): documents are ids, lengths are numbers of distinct terms."""
    held = bag.select("id", "term").distinct()
    lengths = held.groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf = held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total.select("n")))  # one row
    return idf.select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")), total


def postings(bag: DataFrame, most: int | None = None) -> DataFrame:
    """term, ids: the sorted ids that hold a term. For terms of a bounded document frequency; `most` leaves out others."""
    held = bag.select("id", "term").distinct()
    if most is not None:
        held = held.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most).select("term"), "term")
    return held.groupBy("term").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def breakdown(bag: DataFrame, terms: list[str]) -> DataFrame:
    """id, field, score: what each field adds to BM25 for distinct query terms, unrounded; ids without a hit have no row."""
    idf, total = corpus(bag)
    wanted = bag.where(F.col("term").isin(sorted(set(terms))))
    length = bag.select("id", "term").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
    hit = wanted.join(F.broadcast(idf.where(F.col("term").isin(sorted(set(terms))))), "term").join(length, "id").crossJoin(F.broadcast(total.select("avgdl")))
    k = K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))
    return hit.groupBy("id", "field").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + k)).alias("score"))


def lexical(bag: DataFrame, terms: list[str], bonus: DataFrame | None = None) -> DataFrame:
    """id, score: BM25 over all fields together, with the bonus (id, bonus) of what scores at all."""
    idf, total = corpus(bag)
    named = sorted(set(terms))
    whole = bag.where(F.col("term").isin(named)).groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    length = bag.select("id", "term").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
    hit = whole.join(F.broadcast(idf.where(F.col("term").isin(named))), "term").join(length, "id").crossJoin(F.broadcast(total.select("avgdl")))
    k = K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))
    out = hit.groupBy("id").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + k)).alias("score"))
    if bonus is None:
        return out
    return out.join(bonus, "id", "left").select("id", (F.col("score") + F.when(F.col("score") > 0, F.coalesce("bonus", F.lit(0.0))).otherwise(0.0)).alias("score"))


def centrality(edges: DataFrame) -> DataFrame:
    """file, bonus: 0.3 ln(1 + import statements that name the file), from edges (src, dst) of a row a statement."""
    return edges.groupBy(F.col("dst").alias("file")).agg((F.log1p(F.count(F.lit(1)).cast("double")) * CENTRALITY).alias("bonus"))


def search_symbols(symbols: DataFrame, query: str, terms: list[str], top: int = 20, bonus: DataFrame | None = None) -> DataFrame:
    """id, score of the best symbols: BM25 and identity, with the bonus of what scores; among those that hold a term, if any does."""
    bag = token_bag(symbols)
    found = lexical(bag, terms)
    scored = symbols.select("id", "name").join(found, "id", "left").withColumn("ident", identity_of(F.col("name"), F.col("id"), query, terms))
    hits = scored.agg(F.count("score").alias("hits"))
    kept = scored.crossJoin(F.broadcast(hits)).where("hits = 0 or score is not null")  # one row
    base = F.coalesce("score", F.lit(0.0)) + F.col("ident")
    out = kept.select("id", base.alias("score"))
    if bonus is not None:
        out = out.join(bonus, "id", "left").select("id", (F.col("score") + F.when(F.col("score") > 0, F.coalesce("bonus", F.lit(0.0))).otherwise(0.0)).alias("score"))
    return out.where("score > 0").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def identity_of(name: Column, ident: Column, query: str, terms: list[str]) -> Column:
    """The better of what the query as it stands and its terms joined give."""
    ident = ident.cast("string")
    return F.greatest(identity(name, ident, query), identity(name, ident, " ".join(terms)))


def channel(scored: DataFrame, name: str, least: float = 0.0, depth: int | None = None) -> DataFrame:
    """channel, id, rank of (id, score): the ids over `least`, best first, ties to smaller ids."""
    kept = scored.where(F.col("score") > least)
    return first_ranks(kept, [F.desc("score"), F.col("id")], depth).select(F.lit(name).alias("channel"), "id", "rank")


def fused(channels: list[DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """id, score, channels: weighted reciprocal ranks of (channel, id, rank) tables added up."""
    all_weights = CHANNELS | (weights or {})
    every = reduce(lambda a, b: a.unionByName(b), channels)
    table = F.create_map(*[x for k, v in all_weights.items() for x in (F.lit(k), F.lit(float(v)))])
    part = F.coalesce(F.element_at(table, F.col("channel")), F.lit(1.0)) / (SMOOTHING + F.col("rank"))
    return every.withColumn("part", part).groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))


def similar(vectors: DataFrame, query: list[float], least: float = 0.1) -> DataFrame:
    """id, score: cosine of (id, vec) with a query vector, from `least` on; 0 for null, zero and other-sized vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("vec", q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = norm(F.transform("vec", lambda x: x.cast("double"))) * F.lit(sum(x * x for x in query) ** 0.5)
    score = F.when((F.size("vec") == len(query)) & (size > 0), dot / size).otherwise(0.0)
    return vectors.select("id", score.alias("score")).where(F.col("score") >= least)


def hybrid(words: DataFrame, meaning: DataFrame, weight: float = 0.5) -> DataFrame:
    """id, score: (1 - weight) of the lexical score over the best one, and weight of the cosine."""
    top = words.agg(F.max("score").alias("best"))
    part = words.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.col("best")).alias("w"))  # one row
    both = part.join(meaning.select("id", F.col("score").alias("m")), "id", "full")
    return both.select("id", F.round((1 - weight) * F.coalesce("w", F.lit(0.0)) + weight * F.coalesce("m", F.lit(0.0)), 6).alias("score"))


def combined(words: DataFrame, ranks: DataFrame) -> DataFrame:
    """id, score: half the lexical score over the best one and half the rank (id, rank) over the best one."""
    best = words.agg(F.max("score").alias("ws")).crossJoin(ranks.agg(F.max("rank").alias("rs")))  # one row
    both = words.join(ranks, "id", "left").crossJoin(F.broadcast(best))
    part = lambda x, top: F.when(F.col(top) > 0, F.coalesce(x, F.lit(0.0)) / F.col(top)).otherwise(0.0)
    return both.select("id", F.round(0.5 * part("score", "ws") + 0.5 * part("rank", "rs"), 6).alias("score"))


def implementations(symbols: DataFrame, bases: DataFrame, target: str, dispatch: DataFrame | None = None) -> DataFrame:
    """id, relationship, confidence of what implements a target class or method, each id with its surest relationship.

    symbols: (id, name, kind, parent_name, decorators). bases: (class, base).
    dispatch: (interface, method, id) edges that a language server told.
    Subclasses of the target, at any depth, count; so do their methods of its
    name, methods of its name elsewhere, and what is decorated with it.
    """
    below = descendants(bases, target)
    classes = symbols.where("kind = 'class'").join(below.select(F.col("node").alias("name")), "name", "left_semi").select("id", F.lit("subclass").alias("relationship"), F.lit(0.85).alias("confidence"))
    named = symbols.where((F.col("kind") == "method") & (F.col("name") == target))
    duck = named.select("id", F.lit("duck_typed").alias("relationship"), F.lit(0.5).alias("confidence"))
    handlers = symbols.where(F.exists("decorators", lambda d: F.regexp_extract(d, r"([A-Za-z_]\w*)\s*(?:\(.*)?$", 1) == target)).select("id", F.lit("decorator_handler"), F.lit(0.6))
    found = classes.union(duck).union(handlers)
    if dispatch is not None:
        found = found.union(dispatch.where((F.col("interface") == target) | (F.col("method") == target)).select("id", F.lit("interface_impl"), F.lit(0.95)))
    return found.groupBy("id").agg(F.max(F.struct("confidence", "relationship")).alias("b")).select("id", "b.relationship", "b.confidence")


def descendants(bases: DataFrame, root: str, depth: int = 20) -> DataFrame:
    """node, depth: classes below a class, by (class, base), the root left out."""
    from sextant.operators.graph import bfs

    start = bases.sparkSession.createDataFrame([(root,)], "node string")
    return bfs(bases.select(F.col("base").alias("src"), F.col("class").alias("dst")), start, depth).where("depth > 0")


def context_bundle(symbols: DataFrame, wanted: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """id, part, what: for each wanted id its definition, the imports of its file and its callers, in this order."""
    own = symbols.join(wanted.hint("merge"), "id", "left_semi")
    body = own.select("id", F.lit(1).alias("part"), F.col("signature").alias("what"))
    used = own.select("id", F.col("file").alias("src")).join(imports.hint("merge"), "src").select("id", F.lit(2).alias("part"), F.col("specifier").alias("what")).distinct()
    callers = calls.join(wanted.select(F.col("id").alias("callee")).hint("merge"), "callee", "left_semi").select(F.col("callee").alias("id"), F.lit(3).alias("part"), F.col("caller").alias("what"))
    return body.unionByName(used).unionByName(callers)


def extraction_candidates(symbols: DataFrame, calls: DataFrame, least_complexity: int = 5, least_callers: int = 2) -> DataFrame:
    """id, cyclomatic, caller_files, score: complex functions that several other files call, score their product."""
    files = symbols.select(F.col("id").alias("caller"), F.col("file").alias("from"))
    by = calls.join(files, "caller").join(symbols.select(F.col("id").alias("callee"), F.col("file").alias("home")), "callee").where("`from` <> home")
    counted = by.groupBy(F.col("callee").alias("id")).agg(F.countDistinct("from").alias("caller_files")).where(F.col("caller_files") >= least_callers)
    kept = symbols.where((F.col("kind").isin("function", "method")) & (F.col("cyclomatic") >= least_complexity))
    return kept.join(counted, "id").select("id", "cyclomatic", "caller_files", (F.col("cyclomatic") * F.col("caller_files")).alias("score"))


def rename_plan(lines: DataFrame, old: str, new: str) -> DataFrame:
    """path, line, before, after of lines (path, line, text) that hold a name as a whole word."""
    word = rf"(?<![A-Za-z0-9_$]){old}(?![A-Za-z0-9_$])"
    return lines.where(F.col("text").rlike(word)).select("path", "line", F.col("text").alias("before"), F.regexp_replace("text", word, new).alias("after"))


def semantic_neighbours(vectors: DataFrame, wanted: DataFrame, top: int = 5, least: float = 0.6, block: int = 256) -> DataFrame:
    """id, other, score: of each wanted id (id) the `top` other vectors (id, vec) of cosine `least` or more, ties to smaller ids.

    A stated set of questions against all rows, in blocks: the wanted vectors
    go out in blocks, each of one row, every vector is scored against a block
    in place, and only what reaches the limit becomes a row.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select("id", F.transform("vec", lambda x: x.cast("double")).alias("v")).where("size(v) > 0").select("id", let(norm(F.col("v")), lambda n: F.transform("v", lambda x: x / F.when(n > 0, n))).alias("v"))
    asked = unit.join(wanted.select("id").distinct(), "id", "left_semi")
    blocks = asked.groupBy(F.pmod(F.xxhash64("id"), F.ceil(F.lit(1.0) * wanted.count() / block).cast("int"))).agg(F.collect_list(F.struct(F.col("id").alias("q"), F.col("v").alias("qv"))).alias("block")).select("block")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = F.transform("block", lambda q: F.struct(q["q"].alias("q"), F.when(F.size(q["qv"]) == F.size("v"), F.round(dot(q["qv"], F.col("v")), 6)).alias("score")))
    near = unit.crossJoin(blocks).select(F.col("id").alias("other"), F.inline(F.filter(scored, lambda x: x["score"] >= least))).where("q <> other")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "other"))).where(F.col("r") <= top).select(F.col("q").alias("id"), "other", "score")
