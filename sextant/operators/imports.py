"""Re-exports: what a file that hands on others' names stands for, path aliases, namespaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.graph import cut


def re_export_maps(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wildcard (barrel, leaf) and named (barrel, exposed, leaf, original) tables of resolved re-exports (src, dst, kind, exposed, original).

    kind is selective or wildcard, null counting as wildcard. Of several leaves
    under one exposed name the smallest stands.
    """
    kept = resolved.where("dst is not null and dst <> src")
    wild = kept.where("coalesce(kind, 'wildcard') <> 'selective'").select(F.col("src").alias("barrel"), F.col("dst").alias("leaf")).distinct()
    named = kept.where("kind = 'selective' and exposed is not null").groupBy(F.col("src").alias("barrel"), "exposed").agg(F.min(F.struct(F.col("dst").alias("leaf"), F.coalesce("original", "exposed").alias("original"))).alias("x"))
    return wild, named.select("barrel", "exposed", "x.leaf", "x.original")


def expand_barrels(uses: DataFrame, wildcard: DataFrame, named: DataFrame) -> DataFrame:
    """src, leaf: every file that an import credits, the direct target and what it hands on, at any depth.

    uses: (src, direct, name), a row an imported name, a null name for a whole
    module: then every leaf counts. A name goes by the named table to its leaf
    under its original name; one that isn't there goes on to all wildcard
    leaves. Each (use, barrel, name) is walked once, so cycles end.
    """
    edges = uses.select("src", F.col("direct").alias("leaf")).distinct()
    seen = frontier = cut(uses.select("src", "direct", F.col("direct").alias("at"), F.coalesce("name", F.lit("")).alias("name")).distinct())
    wild, by_name = cut(wildcard.withColumnRenamed("barrel", "at")), cut(named.withColumnRenamed("barrel", "at"))
    while True:
        routed = frontier.where("name <> ''").join(by_name.withColumnRenamed("exposed", "name"), ["at", "name"]).select("src", "direct", F.col("leaf"), F.col("original").alias("to"))
        lost = frontier.where("name <> ''").join(by_name.select("at", F.col("exposed").alias("name")), ["at", "name"], "left_anti").join(wild, "at").select("src", "direct", "leaf", F.col("name").alias("to"))
        whole = frontier.where("name = ''")
        all_wild = whole.join(wild, "at").select("src", "direct", "leaf", F.lit("").alias("to"))
        all_named = whole.join(by_name, "at").select("src", "direct", "leaf", F.col("original").alias("to"))
        step = routed.union(lost).union(all_wild).union(all_named).select("src", "direct", F.col("leaf").alias("at"), F.col("to").alias("name")).distinct()
        frontier = cut(step.join(seen, ["src", "direct", "at", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
        edges = edges.unionByName(frontier.select("src", F.col("at").alias("leaf")))
    return edges.distinct()


def with_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """src, specifier, target: specifiers under an alias (prefix, target; a star stands for the rest) with the path that it means; the longest prefix wins, others keep theirs."""
    head = aliases.select(F.regexp_replace("prefix", r"\*$", "").alias("head"), F.regexp_replace("target", r"\*$", "").alias("to"), F.col("prefix").endswith("*").alias("open"))
    hit = imports.join(F.broadcast(head), F.when(F.col("open"), F.col("specifier").startswith(F.col("head"))).otherwise(F.col("specifier") == F.col("head")), "left")  # aliases of one project's settings: a few rows
    best = hit.groupBy("src", "specifier").agg(F.max(F.struct(F.length("head").alias("n"), "head", "to")).alias("b"))
    return best.select("src", "specifier", F.when(F.col("b.head").isNotNull(), F.concat("b.to", F.expr("substring(specifier, b.n + 1)"))).otherwise(F.col("specifier")).alias("target"))


def php_name(path: Column, qualified: Column, namespaces: dict[str, str]) -> Column:
    """The full name of a PHP symbol: its file's folder under a namespace's root (namespace, folder), longest folder first; null outside."""
    out = F.lit(None).cast("string")
    for space, folder in sorted(namespaces.items(), key=lambda x: len(x[1])):
        inside = F.regexp_replace(F.substr(path, F.lit(len(folder) + 1)), r"\.php$", "")
        out = F.when(path.startswith(folder), F.concat(F.lit(space), F.replace(inside, F.lit("/"), F.lit("\\")), F.when(F.coalesce(qualified, F.lit("")) != "", F.concat(F.lit("::"), qualified)).otherwise(""))).otherwise(out)
    return out


def php_file(full: Column, namespaces: dict[str, str]) -> Column:
    """The file that a full PHP name stands for, by the longest namespace that it begins with; null for none."""
    out, plain = F.lit(None).cast("string"), F.substring_index(F.ltrim(full, F.lit("\\")), "::", 1)
    for space, folder in sorted(namespaces.items(), key=lambda x: len(x[0])):
        out = F.when(plain.startswith(space), F.concat(F.lit(folder), F.replace(F.substr(plain, F.lit(len(space) + 1)), F.lit("\\"), F.lit("/")), F.lit(".php"))).otherwise(out)
    return out

