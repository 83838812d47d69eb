"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import WORD, free_name, lookup, save, skew_join, stable

#: Bits of the hash, and bits that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
#: Parts in which rows that repeat each other wholly are numbered.
SALTS = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    Sources in code-point order, null last, weigh weights in turn and share
    share times all sizes; a target stops at cap times its source's size, and
    what is left over is shared again by weight. In closed form: by rising
    cap / weight, a source is capped while its cap is below its share of what
    the capped ones before it leave. The windows have one row a source, of a
    few numbers, whatever the sources' sizes.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = reduce(lambda e, kw: e.when(turn == kw[0], F.lit(float(kw[1]))), enumerate(weights), F.when(F.lit(False), 0.0))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))
    w_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(rising), F.lit(0.0))
    per = per.withColumn("total", total).withColumn("capped", F.col("cap") * w_left <= left * F.col("w"))
    free = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0.0)).over(everything)
    level = (F.col("total") - free("cap")) / (F.sum("w").over(everything) - free("w"))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w"))
    return per.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Mix docs (doc_id, text, source): doc_id, source, size, h, source_size, target, repeats, taken.

    Every document of a source is taken floor(target / source size) times, and
    once more if its hash lies under the source's threshold. The threshold is
    found by histograms of words by source and hash prefix, 12 bits each: only
    the bucket that the remainder of the budget ends in is resolved by the next
    one. The last document that the threshold could take or leave is taken if
    that comes nearer to the target. Nested: a larger budget keeps what a
    smaller took.

    The hash is of doc_id, source and text, and of rows that agree in all three
    each has its number in it, so rows with a null or repeated id are taken or
    left one by one. Null texts and empty texts have size 0. A null source is a
    source, the last. An empty table gives no rows. Other columns are ignored.
    """
    named = docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    rows, _ = _hashed(save(named.select("doc_id", _source_key().alias("k"), "source", _size().alias("size"), _digest().alias("digest"), "row")))
    out = lookup(rows, thresholds(rows, weights, share, cap), ["k"]).withColumn("repeats", _repeats())
    return out.select("doc_id", "source", "size", "h", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed corpus itself: each row of docs, with all its columns, as many times as the mix takes it, by the rules of mix."""
    docs = stable(docs)
    row, k, digest, h, copy = (free_name(docs, x) for x in ("row", "key", "digest", "hash", "copy"))
    docs = docs.withColumns({row: F.monotonically_increasing_id(), k: _source_key()})
    first = save(docs.select(F.col(k).alias("k"), "source", _size().alias("size"), _digest().alias("digest"), F.col(row).alias("row")))
    rows, repeats = _hashed(first)
    state = thresholds(rows, weights, share, cap)
    if repeats:
        docs = docs.join(rows.select(F.col("row").alias(row), F.col("h").alias(h)), row)
    else:
        docs = docs.withColumn(h, _hash(_digest()))
    mark = free_name(docs, "state")
    out = lookup(docs, state.select(F.col("k").alias(k), *[F.col(c).alias(mark + c) for c in state.columns if c != "k"]), [k])
    times = F.array_repeat(F.lit(0), _repeats(mark, h).cast("int"))
    return out.withColumn(copy, F.explode(times)).drop(row, k, h, copy, *[mark + c for c in state.columns])


def _source_key() -> Column:
    """A source as a join key: null is one, too."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _digest() -> Column:
    """A digest of what tells a row from others: doc_id, source and text."""
    part = lambda c: F.coalesce(c, F.lit("-"))
    return F.md5(F.concat_ws(":", part(F.col("doc_id").cast("string")), part(F.col("source")), part(F.md5(F.col("text").cast("binary")))).cast("binary"))


def _hash(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _hashed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows, a saved table (digest, row, ...), with the hash h, and whether digests repeat; the n-th repeat of one gets a hash of digest and n.

    Without repeated digests this is a projection of rows, and nothing is
    shuffled but digests to find that out. Otherwise repeats are numbered in
    SALTS parts, each from where the parts before it end, so that many of one
    digest make no large task.
    """
    again = save(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("digest"))
    if again.isEmpty():
        return rows.withColumn("h", _hash(F.col("digest"))), False
    part = save(skew_join(rows.select("digest", "row"), again, ["digest"]).withColumn("salt", F.pmod(F.xxhash64(F.lit(6), "row"), F.lit(SALTS))))
    ends = part.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("m"))
    before = ends.withColumn("before", F.sum("m").over(Window.partitionBy("digest").orderBy("salt")) - F.col("m")).drop("m")
    nth = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("row")) - 1
    numbered = part.withColumn("i", nth).join(before, ["digest", "salt"]).select("row", (F.col("before") + F.col("i")).alias("n"))
    out = rows.join(numbered, "row", "left")
    repeat = F.md5(F.concat_ws(":", "digest", F.col("n").cast("string")).cast("binary"))
    return save(out.withColumn("h", _hash(F.when(F.coalesce("n", F.lit(0)) > 0, repeat).otherwise(F.col("digest")))).drop("n")), True


def _repeats(mark: str = "", h: str = "h") -> Column:
    c = lambda name: F.col(mark + name)
    return c("whole") + F.when((F.col(h) < c("cut")) & (c("target") > c("whole") * c("source_size")), 1).otherwise(0)


def thresholds(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """A saved table (k, source_size, target, whole, cut) for rows (k, source, size, h): all rows `whole` times, those with h under cut once more."""
    goal = targets(rows.select("source", "size"), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = save(goal.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("k"), "source_size", "target", whole.alias("whole"))
                 .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
                 .withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}))
    for low in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = lookup(rows.select("k", "size", "h"), state.select("k", "prefix"), ["k"])
        inside = inside.where(F.shiftright("h", low + LEVEL_BITS) == F.col("prefix"))
        hist = inside.groupBy("k", F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("k").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(upto))
        hist = lookup(hist, state.drop("prefix", "last"), ["k"])
        # the first bucket whose end passes the budget
        over = hist.where(F.col("below") + F.col("upto") > F.col("budget"))
        first = over.groupBy("k").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        kept = state.drop("prefix", "below", "last").withColumnRenamed("k", "k0")
        below = state.select("k", F.col("below").alias("was"))
        first = first.join(below, "k")
        kept = kept.join(first, kept.k0 == first.k, "left")
        end = F.lit(1 << (HASH_BITS - low)).cast("long")
        state = save(kept.select(
            F.col("k0").alias("k"), "source_size", "target", "whole", "budget", F.coalesce("b.bucket", end).alias("prefix"),
            F.coalesce(F.col("was") + F.col("b.upto") - F.col("b.words"), F.lit(0)).cast("long").alias("below"), F.coalesce("b.words", F.lit(0)).cast("long").alias("last")))
    return save(state.withColumn("cut", F.col("prefix") + F.when((F.col("budget") - F.col("below")) * 2 >= F.col("last"), 1).otherwise(0))
                .select("k", "source_size", "target", "whole", "cut"))
