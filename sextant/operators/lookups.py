"""Smaller questions over code tables: trees, compact rows, name indexes, text callers, dispatch, flows, chains, pages, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.graph import bfs, cut
from sextant.operators.predicates import path_matches
from sextant.operators.graph import cut
from sextant.operators.runtime import innermost

# What a decorator looks like that makes a symbol an entry point, by kind, the first that matches; files whose functions are.
GATEWAYS = [
    ("http", r"(?i)@(?:app|router|blueprint|api|bp|flask_app)\.(?:route|get|post|put|delete|patch|head|options|websocket)|@(?:Get|Post|Put|Delete|Patch|Request)Mapping\b|@(?:Get|Post|Put|Patch|Delete|Head|Options|All)\s*\("),
    ("cli", r"(?i)@(?:cli|app)\.command|@click\.(?:command|group)|typer\..*command"), ("event", r"(?i)@on_event\b|@event_handler\b|@(?:app|router)\.websocket\b|@receiver\b|@signal\b"),
    ("task", r"(?i)@(?:celery|huey|dramatiq|rq)\.|@task\b|@shared_task\b|@periodic_task\b")]
MAIN_FILES = ["__main__.py", "manage.py", "wsgi.py", "asgi.py", "app.py", "main.py", "run.py", "cli.py"]
KINDS = {"http": 0, "cli": 1, "task": 2, "event": 3, "main": 4, "test": 5}


def file_tree(files: DataFrame) -> DataFrame:
    """folder, depth, files, bytes of files (path, bytes): every folder with all that is below it; the top is empty."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("folder"), n.alias("depth")))
    rows = files.select("path", "bytes", F.inline(above))
    return rows.groupBy("folder", "depth").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def compact(symbols: DataFrame, most: int = 160) -> DataFrame:
    """id, name, kind, file, summary: rows that stay cheap; the summary, or the signature without one, cut at so many characters with a mark."""
    text = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("signature"), F.lit(""))
    return symbols.select("id", "name", "kind", "file", F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text).alias("summary"))


def complexity_of(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, cyclomatic, max_nesting, param_count, level of the wanted ids: low to 5, medium to 10, else high."""
    c = F.col("cyclomatic")
    return symbols.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "cyclomatic", "max_nesting", "param_count", F.when(c <= 5, "low").when(c <= 10, "medium").otherwise("high").alias("level"))


def gateway(decorators: Column, name: Column, kind: Column, file: Column, tests: bool = False) -> Column:
    """The kind of entry point that a symbol is, or null."""
    text, base = F.array_join(decorators, " "), F.substring_index(F.regexp_replace(file, r"\\", "/"), "/", -1)
    out = None
    for k, pattern in GATEWAYS:
        out = F.when(text.rlike(pattern), k) if out is None else out.when(text.rlike(pattern), k)
    out = out.when(base.isin(MAIN_FILES) & kind.isin("function", "class"), "main")
    return out.when(name.startswith("test_"), "test") if tests else out


def name_index(imports: DataFrame, most: int | None = None) -> DataFrame:
    """name, files: who imports a name (src, names), in lower case; with `most` only names of at most so many files are listed."""
    rows = imports.select("src", F.explode("names").alias("n")).select(F.lower("n").alias("name"), "src").distinct()
    if most is not None:
        rows = rows.join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most).select("name"), "name")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("src")), ",").alias("files"))


def quick_check(names: DataFrame, imports: DataFrame, lines: DataFrame) -> DataFrame:
    """name, imported, mentioned, referenced: files that import each name and files (path, text) that hold it as a word."""
    used = imports.select("src", F.explode("names").alias("name")).groupBy("name").agg(F.countDistinct("src").alias("imported"))
    words = lines.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    said = words.join(names.select("name").distinct(), "name").groupBy("name").agg(F.countDistinct("path").alias("mentioned"))
    out = names.join(used, "name", "left").join(said, "name", "left").na.fill(0, ["imported", "mentioned"])
    return out.select("name", "imported", "mentioned", ((F.col("imported") > 0) | (F.col("mentioned") > 0)).alias("referenced"))


def text_callers(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """caller, callee: symbols whose lines (path, line, text) call a name, where no call references are known.

    A call is the name before a bracket, in a symbol's lines, not where a
    definition has it; the caller is the innermost symbol around the line. Both
    tables grow with the files, so neither is broadcast, and the calls that
    name a symbol are written down, as they are read twice.
    """
    found = lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!\bdef )(?<!\bclass )(?<!\bfunc )(?<!\bfunction )\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("name"), "text")
    named = found.join(symbols.select(F.col("id").alias("callee"), "name", F.col("file").alias("home"), F.col("line").alias("at")).hint("merge"), "name").where("not (path = home and line = at)")
    named = cut(named.select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("point_id"), F.col("path").alias("file"), "line", "callee"))
    points = named.select("point_id", "file", "line").distinct()
    spans = symbols.select(F.col("id").alias("symbol_id"), "file", F.col("line").alias("start"), F.col("end_line").alias("end"))
    within = innermost(points, spans)
    out = named.join(within.hint("merge"), "point_id")
    return out.select(F.col("symbol_id").alias("caller"), "callee").where("caller <> callee").distinct()


def dispatched(calls: DataFrame, dispatch: DataFrame) -> DataFrame:
    """caller, callee, resolution: calls of a method (caller, callee) and of all that implement it (method, implementation)."""
    direct = calls.select("caller", "callee", F.lit("direct").alias("resolution"))
    more = calls.join(dispatch, calls.callee == dispatch.method).select("caller", F.col("implementation").alias("callee"), F.lit("dispatched").alias("resolution"))
    return direct.unionByName(more).distinct()


def with_runtime(symbols: DataFrame, traces: DataFrame) -> DataFrame:
    """Symbols that have any trace (symbol_id)."""
    return symbols.join(traces.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi")


def flow_edges(routes: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """src_file, label, dst, confidence: route declarations (path, verb, route, handler) and the symbols they name.

    A handler is looked for in its own file (0.9), then in a file that this
    one imports (0.8), then anywhere if only one has the name (0.6); null if
    none does.
    """
    decl = routes.where("handler <> ''").select(F.col("path").alias("src_file"), F.trim(F.concat_ws(" ", "verb", "route")).alias("label"), F.regexp_extract("handler", r"([A-Za-z_]\w*)(?:\.as_view\(\))?\W*$", 1).alias("name"))
    named = symbols.where("kind in ('function', 'method', 'class')").select(F.col("id").alias("dst"), F.col("file").alias("dst_file"), "name")
    both = decl.join(named, "name")
    once = named.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("name")
    near = both.where("src_file = dst_file").withColumn("confidence", F.lit(0.9))
    linked = both.join(edges.select(F.col("src").alias("src_file"), F.col("dst").alias("dst_file")), ["src_file", "dst_file"], "left_semi").withColumn("confidence", F.lit(0.8))
    far = both.join(once, "name", "left_semi").withColumn("confidence", F.lit(0.6))
    best = near.unionByName(linked, allowMissingColumns=True).unionByName(far, allowMissingColumns=True).groupBy("src_file", "label", "name").agg(F.max(F.struct("confidence", "dst")).alias("b"))
    return decl.join(best, ["src_file", "label", "name"], "left").select("src_file", "label", F.col("b.dst").alias("dst"), F.col("b.confidence").alias("confidence"))


def signal_chains(gateways: DataFrame, calls: DataFrame, symbols: DataFrame, max_depth: int = 5) -> DataFrame:
    """gateway, kind, depth, reach, files: how far each entry point (id, kind) leads through calls (caller, callee).

    All entry points walk at once; a row is an entry point and a symbol, each
    once, so a round joins the last round's rows with the calls.
    """
    links = cut(calls.select(F.col("caller").alias("at"), F.col("callee").alias("next")).distinct())
    seen = frontier = cut(gateways.select(F.col("id").alias("gateway"), F.col("id").alias("at"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, "at").select("gateway", F.col("next").alias("at")).distinct()
        frontier = cut(step.join(seen, ["gateway", "at"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    placed = seen.join(symbols.select(F.col("id").alias("at"), "file"), "at", "left")
    per = placed.groupBy("gateway").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("reach"), F.countDistinct("file").alias("files"))
    return per.join(gateways.select(F.col("id").alias("gateway"), "kind"), "gateway").select("gateway", "kind", "depth", "reach", "files")


def call_hierarchy(calls: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """node, depth, direction: who calls a symbol and what it calls, directly or through others."""
    begin = calls.sparkSession.createDataFrame([(start,)], f"node {dict(calls.dtypes)['caller']}")
    down = bfs(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), begin, depth).where("depth > 0")
    up = bfs(calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst")), begin, depth).where("depth > 0")
    return down.withColumn("direction", F.lit("callee")).unionByName(up.withColumn("direction", F.lit("caller")))


def barrel_exports(re_exports: DataFrame, defined: DataFrame) -> DataFrame:
    """file, name: names that a file hands on from others, through any number of files.

    re_exports: (src, dst, name), a null name for all of dst's; defined:
    (file, name) of what a file itself has.
    """
    links = cut(re_exports.select("src", "dst", "name").distinct())
    have = cut(defined.select("file", "name").distinct())
    handed = have.limit(0)
    frontier = have
    while True:
        step = frontier.withColumnRenamed("name", "has").join(links, F.col("file") == F.col("dst")).where("name is null or name = has").select(F.col("src").alias("file"), F.col("has").alias("name")).distinct()
        frontier = cut(step.join(handed, ["file", "name"], "left_anti"))
        if frontier.isEmpty():
            return handed
        handed = cut(handed.unionByName(frontier))


def mtime_changes(before: DataFrame, after: DataFrame, slack: float = 1.0) -> DataFrame:
    """path, state: new, deleted, or changed where the time (path, mtime in seconds) moved on by more than the slack."""
    both = before.select("path", F.col("mtime").alias("was")).join(after.select("path", F.col("mtime").alias("now")), "path", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("was") + slack, "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def two_stage_top(rows: DataFrame, by: list[Column], k: int, shards: int = 64) -> DataFrame:
    """The first k rows in an order: first the k of each of so many shards by a hash of id, then of those."""
    w = Window.partitionBy("__shard").orderBy(*by)
    return rows.withColumn("__shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__shard", "__r").orderBy(*by).limit(k)


def page(rows: DataFrame, by: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in an order that tells rows apart."""
    return rows.orderBy(*by).offset(offset).limit(limit)


def enriched(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Findings (path, preset, line) with the innermost symbol around them, null outside any."""
    points = findings.select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("point_id"), F.col("path").alias("file"), "line").distinct()
    spans = symbols.select(F.col("id").alias("symbol_id"), "file", F.col("line").alias("start"), F.col("end_line").alias("end"))
    within = innermost(points, spans)
    return findings.withColumn("point_id", F.concat_ws(":", "path", F.col("line").cast("string"))).join(within, "point_id", "left").drop("point_id")


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """what, n: rows of each of an index's tables."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def catalogue_search(tools: DataFrame, terms: list[str], top: int = 10) -> DataFrame:
    """name, score of tools (name, words): inverse frequencies of the terms they hold, added up, best first."""
    wanted = sorted(set(terms))
    n = tools.agg(F.count(F.lit(1)).alias("n"))
    held = tools.select("name", F.explode(F.array_distinct("words")).alias("term")).where(F.col("term").isin(wanted))
    idf = held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # one row
    return held.join(F.broadcast(idf), "term").groupBy("name").agg(F.round(F.sum("idf"), 6).alias("score")).orderBy(F.desc("score"), "name").limit(top)


def resolve_repo(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """path, repo: the repository (repo, root) whose root is the longest that a path lies under, null for none."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = paths.select("path", F.explode(above).alias("root")).join(repos, "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "repo")).alias("b"))
    return paths.select("path").distinct().join(hits, "path", "left").select("path", F.col("b.repo").alias("repo"))


def in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """group, and the rows of the group's repositories (group, repo)."""
    return groups.join(rows, "repo")


def legacy_score(query: str, name: Column, signature: Column, summary: Column, keywords: Column, docstring: Column) -> Column:
    """Points of the first scorer: 20 the name, 10 in it, 5 a word in it; 8 and 2 in the signature, 5 and 1 in the summary, 3 a key word, 1 a word in the docstring."""
    q, words = query.lower(), sorted(set(query.lower().split()))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    n, s, m, d = low(name), low(signature), low(summary), low(docstring)
    points = F.when(n == q, 20).when(n.contains(q), 10).otherwise(0) + F.when(s.contains(q), 8).otherwise(0) + F.when(m.contains(q), 5).otherwise(0)
    for w in words:
        for text, value in ((n, 5), (s, 2), (m, 1), (d, 1)):
            points = points + F.when(text.contains(w), value).otherwise(0)
    return points + 3 * F.size(F.array_intersect(keywords, F.array(*map(F.lit, words))))


def replay(log: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """query, kept: how many of a logged query's first k ids (query, ids) are still among the first k (query, id, rank)."""
    was = log.select("query", F.explode(F.slice("ids", 1, k)).alias("id"))
    now = results.where(F.col("rank") <= k).select("query", "id").withColumn("here", F.lit(1))
    return was.join(now, ["query", "id"], "left").groupBy("query").agg(F.count("here").alias("kept"))


def scoped(rows: DataFrame, path: str = "path", glob: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows under a path prefix and a glob."""
    out = rows if glob is None else rows.where(path_matches(F.col(path), glob))
    return out if prefix is None else out.where(F.col(path).startswith(prefix))
