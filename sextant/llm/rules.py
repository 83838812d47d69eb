"""Quality rules: base counts and divergence from language references. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import WORD, lookup, save

#: Words of a language's reference.
COMMON = 24
#: The character of a word that is none of them; the next ones stand for the common words.
_MARK = 65

#: Character classes of the histogram, as Java patterns, the commonest first; what is in none of them is a class of its own.
CHAR_CLASSES = {"lower": r"\p{Ll}", "space": r"[\x20\x09-\x0D]", "upper": r"\p{Lu}", "digit": r"[0-9]", "stop": r"[.,;:]", "mark": r"[!?]", "symbol": r"[#*$%&|<>]"}

SHINGLE = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's argument is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - SHINGLE), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(SHINGLE)]))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs at least twice: sort by hash, keep neighbours that agree, add up the gaps."""

    def count(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(SHINGLE), F.coalesce(F.get(places, i + 1) - p, F.lit(SHINGLE))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def twins(pairs: Column) -> Column:
        same = lambda p, other: F.coalesce(p["h"] == other["h"], F.lit(False))
        kept = F.filter(pairs, lambda p, i: same(p, F.get(pairs, i - 1)) | same(p, F.get(pairs, i + 1)))
        return F.sort_array(F.transform(kept, lambda p: p["i"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, twins), count)


def repeat_words(words: Column) -> Column:
    """Words of an array in 5-word windows found twice or more in it."""

    def per_window(windows: Column) -> Column:
        again = let(F.sort_array(windows), lambda s: F.exists(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
        return F.when(~again, F.lit(0).cast("long")).otherwise(_covered(windows))

    def per_hashes(hashes: Column) -> Column:
        return F.when(F.size(hashes) <= SHINGLE, F.lit(0).cast("long")).otherwise(let(_windows(hashes), per_window))

    return let(F.transform(words, lambda w: F.xxhash64(w)), per_hashes)


def _jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (the root of the divergence in bits) of two count arrays of the same length; 0 where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def divergence(t: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: let(F.struct((a / t["p"]).alias("a"), (b / t["q"]).alias("b")), lambda s: part(s["a"], (s["a"] + s["b"]) / 2) + part(s["b"], (s["a"] + s["b"]) / 2)))
        return F.when((t["p"] > 0) & (t["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))).otherwise(0.0)

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), divergence)


def _class_counts(text: Column) -> Column:
    """An array of the counts of CHAR_CLASSES: runs of a class are cut out, one class after the other, from what is left."""
    def step(rest: Column, patterns: list[str]) -> Column:
        def after(short: Column) -> Column:
            here = F.array((F.length(rest) - F.length(short)).cast("long"))
            return F.concat(here, step(short, patterns[1:])) if patterns[1:] else F.concat(here, F.array(F.length(short).cast("long")))

        return let(F.regexp_replace(rest, F.lit(patterns[0] + "+"), F.lit("")), after)

    return step(text, list(CHAR_CLASSES.values()))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, k, words) as doc_id, k, the base counts, base_failed and the histograms chars and common, one row per document.

    k is the language as a key, words its common words (null: none). A word
    becomes one character that says which of them it is, so that occurrences
    are counted on one short string.
    """
    lines = let(F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    which = lambda ws: F.array_join(F.transform(ws, lambda w: F.char(F.coalesce(F.array_position("words", w), F.lit(0)) + _MARK)), "")
    of = lambda s, i: (F.length(s) - F.length(F.replace(s, F.lit(chr(_MARK + i)), F.lit("")))).cast("long")
    per_word = lambda s: F.array(*[of(s, i) for i in [*range(1, COMMON + 1), 0]])
    rows = docs.select("doc_id", "k", "words", F.coalesce(F.col("text"), F.lit("")).alias("t")).select(
        "doc_id", "k", F.length("t").cast("long").alias("n_chars"), _class_counts(F.col("t")).alias("chars"), lines.alias("n_dup_lines"),
        let(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).alias("n_repeat_words"), let(which(ws), per_word).alias("common"))).alias("w"))
    at = {name: F.get("chars", F.lit(i)) for i, name in enumerate(CHAR_CLASSES)}
    rows = rows.select("doc_id", "k", "w.n_words", (F.col("n_chars") - at["space"]).alias("word_chars"), at["symbol"].alias("n_symbols"), "n_dup_lines", "w.n_repeat_words", "chars", "w.common")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """A saved table (k, words): of each language the words that most documents hold, ties by code point; a row a language.

    All documents count, a word once in each. Counts are combined before they
    move, and of each part of a language's words only its best go on, so no
    task has them all.
    """
    words = docs.select("k", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)))).alias("word"))
    counts = words.groupBy("k", "word").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.col("n").desc(), "word"))).where(F.col("rank") <= most)
    return save(best.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words")))


def quality_rules(docs: DataFrame, min_words: int = 50, min_reference_words: int = 1000, max_char_distance: float = 0.22, max_word_distance: float = 0.30) -> DataFrame:
    """Base rules, then the distance of each document from its language's reference.

    docs: (doc_id, text, lang). The reference of a language is the sum of the
    histograms of all its documents that pass the base rules: of character
    classes, and of the COMMON words that most of its documents hold, with one
    bin for all other words. A document of at least min_words words whose
    language has a reference of at least min_reference_words words is not kept
    if one of the two Jensen-Shannon distances is over its limit; so shorter
    ones, and those of languages too rare for a reference, are kept unless the
    base rules fail them. null is a language like any other.

    Equal windows are told by 64-bit hashes. Null and empty texts have zero
    counts and fail the base rules. Repeated rows are judged alike. An empty
    table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")).alias("k"))
    rows = save(base_counts(lookup(docs, common_words(docs), ["k"], "left")))
    good = rows.where(~F.col("base_failed"))
    sums = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)) for i in range(n)])
    ref = save(good.groupBy("k").agg(F.sum("n_words").alias("ref_words"), sums("chars", len(CHAR_CLASSES) + 1).alias("ref_chars"), sums("common", COMMON + 1).alias("ref_common")))
    out = lookup(rows, ref, ["k"], "left")
    judged = (F.col("n_words") >= min_words) & (F.coalesce("ref_words", F.lit(0)) >= min_reference_words)
    out = out.withColumn("char_distance", F.when(judged, _jensen_shannon(F.col("chars"), F.col("ref_chars")))).withColumn("word_distance", F.when(judged, _jensen_shannon(F.col("common"), F.col("ref_common"))))
    bad = F.coalesce((F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"),
                      F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
