"""Answers put together from other operators: risk, safety verdicts, intents, summaries, contents, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import let

# Phrases that tell what a task is about; of equal weights the first intent wins.
INTENTS = {
    "debug": ["debug", "bug", "broken", "fail", "error", "crash", "exception", "traceback", "stack trace", "why isn't", "why doesn't", "regression", "not working", "throws", "incorrect"],
    "refactor": ["refactor", "rename", "move", "extract", "inline", "consolidate", "duplicate", "deduplicate", "clean up", "simplify", "split", "merge function", "decompose"],
    "extend": ["add ", "new feature", "implement", "extend", "support for", "new endpoint", "new handler", "new route", "new method", "another impl", "additional"],
    "audit": ["audit", "risk", "review risk", "review safety", "dead code", "unused", "untested", "coverage gap", "security", "tech debt", "code smell", "find similar"],
    "explore": ["what does", "how does", "explore", "orient", "overview", "show me", "find", "where is", "where are", "tour", "explain", "structure", "architecture", "what is this"]}

# How sure each verdict is; a null depends on the signals.
DELETE_CONFIDENCE = {"safe_to_delete": None, "runtime_observed": 0.05, "cross_repo_blocking": 0.10, "entry_point": 0.20, "external_uses_blocking": 0.25, "internal_uses_blocking": 0.45, "test_coverage_only": 0.65}
EDIT_CONFIDENCE = {"runtime_critical": 0.15, "signature_impact": 0.40, "complexity_risk": 0.45, "untested": 0.55, "safe_to_edit": None}
COMPLEX_FROM = 11
RISK_WEIGHTS = {"blast": 0.30, "complexity": 0.25, "churn": 0.15, "gap": 0.20, "volume": 0.10}
RUNTIME_WEIGHT, RUNTIME_TOP = 0.15, 1_000_000


def intents(tasks: DataFrame) -> DataFrame:
    """id, intent, confidence of (id, task): the intent whose phrases weigh most, 1 + length / 30 each; explore with 0.5 if none is found."""
    low = F.lower("task")
    phrases = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("intent"), F.lit(1 + len(p) / 30).alias("w"), low.contains(p).alias("hit")) for i, (name, listed) in enumerate(INTENTS.items()) for p in listed]
    hits = tasks.select("id", F.explode(F.array(*phrases)).alias("p")).select("id", "p.*").where("hit")
    scored = hits.groupBy("id", "place", "intent").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "place", "intent", "n")).alias("b"))
    conf = F.round(F.least(F.lit(0.95), 0.55 + 0.1 * F.col("b.n")), 2)
    return tasks.select("id").join(best, "id", "left").select("id", F.coalesce("b.intent", F.lit("explore")).alias("intent"), F.coalesce(conf, F.lit(0.5)).alias("confidence"))


def delete_verdict(runtime: Column, entry: Column, cross_repo: Column, external: Column, internal: Column, tests: Column, dead: Column) -> tuple[Column, Column]:
    """The strongest reason against deleting a symbol, and how sure that is; counts in, and the confidence that the code is dead."""
    verdict = (F.when(runtime > 0, "runtime_observed").when(entry, "entry_point").when(cross_repo > 0, "cross_repo_blocking").when(external > 0, "external_uses_blocking")
               .when(internal > 0, "internal_uses_blocking").when(tests > 0, "test_coverage_only").otherwise("safe_to_delete"))
    safe = F.greatest(F.lit(0.5), dead, F.when(dead < 0.9, 0.85).otherwise(0.95))
    return verdict, _sure(verdict, DELETE_CONFIDENCE, safe)


def edit_verdict(runtime: Column, cross_repo: Column, external: Column, internal: Column, cyclomatic: Column, tested: Column) -> tuple[Column, Column]:
    """What an edit of a symbol has to mind most, and how sure that is."""
    verdict = (F.when(runtime > 0, "runtime_critical").when(external + cross_repo > 0, "signature_impact").when(cyclomatic >= COMPLEX_FROM, "complexity_risk")
               .when((internal > 0) & ~tested, "untested").otherwise("safe_to_edit"))
    return verdict, _sure(verdict, EDIT_CONFIDENCE, F.when(tested, 0.95).otherwise(0.90))


def _sure(verdict: Column, known: dict, otherwise: Column) -> Column:
    return F.coalesce(*[F.when(verdict == k, F.lit(v)) for k, v in known.items() if v is not None], otherwise)


def change_risk(changed: DataFrame, files: DataFrame, runtime: bool = False) -> DataFrame:
    """One row about changed symbols (cyclomatic, test, covered, hits) and all files (churn, changed, reached): the parts, their weighted sum and its level.

    reached: the change may break the file. runtime: whether the repository
    has any traces at all; then traffic has a weight of its own and the others
    make room. Hits are null where a symbol has no trace.
    """
    up_to = lambda c, top: F.least(F.lit(1.0), F.log1p(c.cast("double")) / F.log1p(F.lit(float(top))))
    part = lambda c: F.coalesce(c, F.lit(0.0))
    m = changed.agg(
        F.coalesce(F.max("cyclomatic"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("n"), part(F.avg(F.when(~F.col("test"), F.when(F.col("covered"), 0.0).otherwise(1.0)))).alias("gap"),
        part(F.avg(F.log1p(F.col("hits").cast("double")) / F.log1p(F.lit(float(RUNTIME_TOP))))).alias("traffic"))
    m = m.crossJoin(files.agg(part(F.avg(F.when(F.col("changed"), F.col("churn")))).alias("h"), part(F.avg(F.when(F.col("reached"), 1.0).otherwise(0.0))).alias("ratio")))  # one row each
    parts = {"blast": F.least(F.lit(1.0), 1 - F.exp(-5 * F.col("ratio"))), "complexity": up_to(F.col("c"), 30), "churn": up_to(F.col("h"), 25), "gap": F.col("gap"), "volume": up_to(F.col("n"), 60)}
    traffic = F.least(F.lit(1.0), F.col("traffic")) if runtime else F.lit(0.0)
    total = F.lit(1 - RUNTIME_WEIGHT if runtime else 1.0) * sum((F.lit(w) * parts[k] for k, w in RISK_WEIGHTS.items()), F.lit(0.0)) + F.lit(RUNTIME_WEIGHT) * traffic
    risk = F.round(total, 4)
    return m.select(*[F.round(c, 4).alias(k) for k, c in parts.items()], F.round(traffic, 4).alias("runtime"), risk.alias("risk"), F.when(risk <= 0.25, "low").when(risk <= 0.5, "medium").when(risk <= 0.75, "high").otherwise("critical").alias("level"))


def docstring_summary(doc: Column) -> Column:
    """The first line up to its first full stop, at most 120 characters."""
    return F.substring(F.trim(F.regexp_extract(F.trim(doc), r"^[^.\n]*\.?", 0)), 1, 120)


def signature_fallback(kind: Column, name: Column, signature: Column) -> Column:
    text = F.when(kind == "class", F.concat(F.lit("Class "), name)).when(kind == "constant", F.concat(F.lit("Constant "), name)).when(kind == "type", F.concat(F.lit("Type definition "), name)).otherwise(signature)
    return F.substring(text, 1, 120)


def file_summaries(symbols: DataFrame) -> DataFrame:
    """file, summary: how many symbols of each kind, the commonest first."""
    per = symbols.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind", "n")))
    return per.groupBy("file").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["n"].cast("string"), x["kind"])), ", ").alias("summary"))


def utf8_cut(text: Column, most: int) -> Column:
    """The longest beginning of at most so many bytes that splits no character."""
    raw = F.substring(text.cast("binary"), 1, most)
    bad = F.length(F.regexp_extract(F.hex(raw), r"((?:[C-D][0-9A-F])|(?:E[0-9A-F](?:[89AB][0-9A-F]){0,1})|(?:F[0-7](?:[89AB][0-9A-F]){0,2}))$", 1))
    whole = F.length(text.cast("binary")) <= most
    return F.when(whole, text).otherwise(
        F.decode(F.unhex(F.substr(F.hex(raw), F.lit(1), F.length(F.hex(raw)) - bad)), "UTF-8"))


def contents(sections: DataFrame) -> DataFrame:
    """doc, id, depth, path: sections of (doc, id, parent_id) with the ids above them, by a recursive walk bounded in depth."""
    sections.createOrReplaceTempView("__sections")
    return sections.sparkSession.sql("""with recursive t as (select doc, id, 0 as depth, cast(id as string) as path from __sections where parent_id is null
      union all select s.doc, s.id, t.depth + 1, t.path || '/' || cast(s.id as string) from __sections s join t on s.doc = t.doc and s.parent_id = t.id where t.depth < 20) select doc, id, depth, path from t""")


def impact_paths(edges: DataFrame, start, depth: int = 3) -> DataFrame:
    """node, depth, path: every way of at most `depth` edges (src, dst) from a node, none through a node twice."""
    edges.createOrReplaceTempView("__edges")
    return edges.sparkSession.sql(f"""with recursive t as (select dst as node, 1 as depth, concat({start!r}, '>', dst) as path from __edges where src = {start!r} and dst <> {start!r}
      union all select e.dst, t.depth + 1, t.path || '>' || e.dst from __edges e join t on e.src = t.node where t.depth < {depth} and not array_contains(split(t.path, '>'), cast(e.dst as string))) select node, depth, path from t""")


def registry(packages: DataFrame) -> DataFrame:
    """package, repos: who publishes what."""
    return packages.groupBy("package").agg(F.array_join(F.sort_array(F.collect_set(F.col("repo").cast("string"))), ",").alias("repos"))


def history(runs: DataFrame, cap: int) -> DataFrame:
    """The last `cap` runs of each slug, one a sha (its first)."""
    once = runs.withColumn("r", F.row_number().over(Window.partitionBy("slug", "sha").orderBy("ts", "run"))).where("r = 1")
    return once.withColumn("r", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("ts"), F.desc("run")))).where(F.col("r") <= cap).drop("r")


def journal(events: DataFrame, kinds: Sequence[str], most: int = 20) -> DataFrame:
    """Per kind the `most` things last touched: kind, thing, n, last."""
    per = events.where(F.col("kind").isin(list(kinds))).groupBy("kind", "thing").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return per.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("last"), "thing"))).where(F.col("r") <= most).drop("r")


def ledger(events: DataFrame, since: str, tool: str | None = None, limit: int = 1000) -> DataFrame:
    """Events from a time on, of a tool, the newest first."""
    kept = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return (kept.where(F.col("tool") == tool) if tool else kept).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def shared_names(names: DataFrame, most: int = 30) -> DataFrame:
    """a, b, shared: files that import the same names, names with more than `most` files left out."""
    n = names.select("file", "name").distinct()
    few = n.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most).select("name")
    kept = n.join(few, "name")
    pairs = kept.alias("x").join(kept.alias("y"), (F.col("x.name") == F.col("y.name")) & (F.col("x.file") < F.col("y.file")))
    return pairs.groupBy(F.col("x.file").alias("a"), F.col("y.file").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def related(symbols: DataFrame, target: int, top: int = 20, importers: DataFrame | None = None) -> DataFrame:
    """id, score: 3 for the target's file, else 1.5 for a file that shares an importer with it, 0.5 for each word of the name it shares, best first.

    importers: (file, importer); without it the second signal is left out.
    """
    t = symbols.where(F.col("id") == target).select(F.col("file").alias("tf"), F.split(F.lower("name"), " ").alias("tw"))
    others = symbols.where(F.col("id") != target)
    near = F.lit(None)
    if importers is not None:
        of_target = importers.join(F.broadcast(t.select(F.col("tf").alias("file"))), "file", "left_semi").select("importer").distinct()
        files = importers.join(of_target, "importer", "left_semi").select("file").distinct()
        others = others.join(files.withColumn("near", F.lit(1)), "file", "left")
        near = F.col("near")
    shared = F.size(F.array_intersect(F.array_distinct(F.split(F.lower("name"), " ")), F.col("tw")))
    score = F.round(F.when(F.col("file") == F.col("tf"), 3.0).when(near.isNotNull(), 1.5).otherwise(0.0) + 0.5 * shared, 2)
    out = others.crossJoin(F.broadcast(t)).select("id", score.alias("score"))
    return out.where("score > 0").orderBy(F.desc("score"), "id").limit(top)


def verify(sections: DataFrame) -> DataFrame:
    """id, ok of (id, content, content_hash): whether the content still has its hash."""
    return sections.select("id", (F.sha2(F.col("content"), 256) == F.col("content_hash")).alias("ok"))


def hashed_embedding(words: Column, dims: int = 64) -> Column:
    """A deterministic embedding of a word array: signed counts by hash, scaled to length one; all in the JVM."""
    signed = lambda cells, d: (F.size(F.filter(cells, lambda c: c == 2 * d)) - F.size(F.filter(cells, lambda c: c == 2 * d + 1))).cast("double")
    raw = let(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dims))), lambda cells: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: signed(cells, d)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(raw, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def legend(values: DataFrame, column: str, least_uses: int = 2, least_saved: int = 4) -> DataFrame:
    """Directory prefixes used often enough to pay for a code: prefix, uses, saved characters."""
    prefix = F.regexp_extract(column, r"^(.*[/#])[^/#]*$", 1)
    per = values.select(prefix.alias("prefix")).where("prefix <> ''").groupBy("prefix").agg(F.count(F.lit(1)).alias("uses"))
    saved = (F.length("prefix") - 2) * (F.col("uses") - 1)
    return per.withColumn("saved", saved).where((F.col("uses") >= least_uses) & (F.col("saved") >= least_saved))

