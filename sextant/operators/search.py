"""Ranked search: BM25 over fields, rank fusion, similarity channels, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import let, stable_round
from sextant.operators.graph import cut


def bm25(tokens: DataFrame, terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """id, score of (id, words ARRAY): sum over distinct terms of idf * tf (k1 + 1) / (tf + K), documents with a hit only.

    Lengths and the documents' count come from one pass over the arrays; only
    the terms' postings are exploded, so the shuffle carries query hits, not
    the corpus.
    """
    terms = sorted(set(terms))
    sized = tokens.select("id", F.size("words").cast("double").alias("dl"), F.filter("words", lambda w: w.isin(terms)).alias("hits"))
    stats = sized.agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    tf = sized.where(F.size("hits") > 0).select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # as many rows as terms
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_ranks(df: DataFrame, order: list[Column], depth: int | None = None) -> DataFrame:
    """df with rank, from 1 in the given order, which must tell rows apart: the first `depth` rows, or all.

    With a depth it is a top-k and a window over as many rows. Without, rows
    are sorted by ranges and written down with their place in their range; a
    range's first rank comes from the sizes of those before, a row a range.
    """
    if depth is not None:
        return df.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    placed = cut(df.sort(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return placed.join(F.broadcast(before), "__p").withColumn("rank", (F.col("before") + F.col("__i") + 1).cast("int")).drop("__p", "__i", "before")


def ranked(df: DataFrame, channel: str, score: str = "score") -> DataFrame:
    """channel, id, rank of (id, score), best first, ties by id."""
    return first_ranks(df.select("id", score), [F.desc(score), F.col("id")]).select(F.lit(channel).alias("channel"), "id", "rank")


def fuse(channels: DataFrame, weights: dict[str, float], smoothing: int = 60) -> DataFrame:
    """id, score: sum of weight / (smoothing + rank) over channels (channel, id, rank); unnamed channels weigh 1."""
    w = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.col("channel") == name, F.lit(float(value))).otherwise(w)
    return channels.groupBy("id").agg(F.round(F.sum(w / (F.lit(smoothing) + F.col("rank"))), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, least: float = 0.1) -> DataFrame:
    """The k rows (id, vec) most like a vector, of cosine `least` or more: one scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("id", F.round(cosine(F.col("vec"), q), 6).alias("score")).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def hybrid(lexical: DataFrame, semantic: DataFrame, weight: float = 0.5) -> DataFrame:
    """id, score = (1 - w) lexical / its maximum + w semantic; missing ones count 0."""
    most = lexical.agg(F.max("score").alias("most"))
    lex = lexical.crossJoin(F.broadcast(most)).select("id", (F.col("score") / F.col("most")).alias("lex"))
    both = lex.join(semantic.select("id", F.col("score").alias("sem")), "id", "full").na.fill(0.0, ["lex", "sem"])
    return both.select("id", stable_round((1 - weight) * F.col("lex") + weight * F.col("sem"), 6).alias("score"))


def drift(before: DataFrame, after: DataFrame, threshold: float = 0.05) -> DataFrame:
    """n, mean and largest 1 - cosine of two vector tables (id, vec), and whether the largest is over the threshold."""
    d = 1 - cosine(F.col("vec"), F.col("now"))
    per = before.join(after.select("id", F.col("vec").alias("now")), "id").select(d.alias("d"))
    out = per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean_drift"), F.round(F.max("d"), 6).alias("max_drift"))
    return out.withColumn("alarm", F.col("max_drift") > threshold)


def pack(candidates: DataFrame, budget: int, per_file: int = 3, chunk: int = 1000) -> DataFrame:
    """place, id, file, tokens: greedy packing of (id, file, score, tokens) under a token budget: best first, skipping what costs nothing, does not fit or would be a file's fourth.

    The choice depends on what was taken before, so it is a walk; it takes the
    best `chunk` of what can still fit at a time, of which the first always
    does, until nothing is left that could. What is taken costs a token each,
    so no more than `budget` rows reach the driver.
    """
    spark, rows = candidates.sparkSession, candidates.select("id", "file", "score", F.col("tokens").cast("long").alias("tokens")).where("tokens > 0")
    taken, per, left, last = [], {}, budget, None
    while left > 0:
        open_ = rows.where(F.col("tokens") <= left)
        if last is not None:
            open_ = open_.where((F.col("score") < last.score) | ((F.col("score") == last.score) & (F.col("id") > last.id)))
        if full := [f for f, n in per.items() if n >= per_file]:
            open_ = open_.where(F.col("file").isNull() | ~F.col("file").isin(full))
        best = open_.orderBy(F.desc("score"), "id").limit(chunk).collect()
        for r in best:
            if r.tokens <= left and per.get(r.file, 0) < per_file:
                taken.append((len(taken), r.id, r.file, r.tokens))
                left, per[r.file] = left - r.tokens, per.get(r.file, 0) + 1
        if len(best) < chunk:
            break
        last = best[-1]
    kinds = {k: rows.schema[k].dataType.simpleString() for k in ("id", "file")}
    return spark.createDataFrame(taken, f"place int, id {kinds['id']}, file {kinds['file']}, tokens long")


def context_lines(lines: DataFrame, pattern: str, around: int = 1, limit: int = 20) -> DataFrame:
    """Matching lines of (file, line_no, line) with those before and after, the first `limit` by file and line."""
    w = Window.partitionBy("file").orderBy("line_no")
    framed = lines.withColumn("before", F.collect_list("line").over(w.rowsBetween(-around, -1))).withColumn("after", F.collect_list("line").over(w.rowsBetween(1, around)))
    return framed.where(F.col("line").rlike(pattern)).orderBy("file", "line_no").limit(limit)


def title_score(title: Column, query: str) -> Column:
    """100 for the title itself, 30 for a part of it, 5 a shared word, 10 more if the title begins with the query."""
    low, q = F.lower(title), query.lower()
    words = F.array(*[F.lit(w) for w in sorted(set(q.split()))])
    shared = F.size(F.array_intersect(F.array_distinct(F.split(low, " ")), words))
    return F.when(low == q, 100).when(low.contains(q), 30).otherwise(0) + 5 * shared + F.when(low.startswith(q), 10).otherwise(0)


def column_score(name: Column, description: Column, query: str) -> Column:
    """30 for the name, 15 for its beginning, 5 for a part; 8 for a word of the description, 2 for a part."""
    q, low, desc = query.lower(), F.lower(name), F.lower(description)
    return F.when(low == q, 30).when(low.startswith(q), 15).when(low.contains(q), 5).otherwise(0) + F.when(F.array_contains(F.split(desc, " "), q), 8).when(desc.contains(q), 2).otherwise(0)


def shingle_pairs(tokens: DataFrame, k: int = 5, least: float = 0.85, min_tokens: int = 10) -> DataFrame:
    """a, b, jaccard of (id, words) by distinct k-word shingles, sets at most twice the other's size, at or over `least`.

    Equal word lists are joined by their hash first; of each only the first
    meets other texts, so copies do not multiply pairs. Hashes stand in the
    order of their rarity, so a line that many texts share comes last. Of two
    sets that are alike enough, one shares a hash of its first n - ceil(least *
    n) + 1 with the other's, the smaller even of fewer, and enough can follow
    it; only those are joined, and candidates are confirmed on whole sets.
    """
    sized = tokens.where(F.size("words") >= min_tokens).withColumn("key", F.sha2(F.array_join("words", " "), 256))
    first = sized.groupBy("key").agg(F.min("id").alias("rep"))
    same = sized.join(first, "key").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    reps = sized.join(first.select(F.col("rep").alias("id")), "id", "left_semi")
    shingles = let(F.col("words"), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))))
    sets = cut(reps.select("id", shingles.alias("s")).withColumn("n", F.size("s")))
    each = sets.select("id", "n", F.explode("s").alias("h"))
    held = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = each.join(held, "h").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t")).withColumn("skip", F.col("n") - F.size("t"))
    up = lambda share: F.ceil(F.col("n") * share - 1e-9)
    first_ones = F.slice("t", 1, F.greatest(F.lit(0), F.col("n") - up(least) + 1 - F.col("skip")).cast("int"))
    prefix = cut(listed.select("id", "n", "skip", F.posexplode(first_ones).alias("i", "x")).select("id", "n", (F.col("skip") + F.col("i")).alias("p"), F.col("x.h").alias("h")))
    part = 2 * least / (1 + least)
    low = prefix.where(F.col("p") < F.col("n") - up(part) + 1).select("h", F.col("id").alias("i"), F.col("n").alias("ni"), F.col("p").alias("pi"))
    high = prefix.select("h", F.col("id").alias("j"), F.col("n").alias("nj"), F.col("p").alias("pj"))
    enough = F.least(F.col("ni") - F.col("pi"), F.col("nj") - F.col("pj")) >= (F.col("ni") + F.col("nj")) * (part / 2) - 1e-9
    met = low.join(high, (low.h == high.h) & (F.struct("ni", "i") < F.struct("nj", "j")) & (F.col("ni") >= F.col("nj") * F.lit(least)) & enough)
    pairs = met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    side = lambda key, name: sets.select(F.col("id").alias(key), F.col("s").alias(name))
    both = pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").withColumn("both", F.size(F.array_intersect("p", "q")))
    near = both.withColumn("jaccard", F.col("both") / (F.size("p") + F.size("q") - F.col("both"))).where(F.col("jaccard") >= least)
    return same.unionByName(near.select("a", "b", F.round("jaccard", 6).alias("jaccard")))
