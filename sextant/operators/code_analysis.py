"""Questions about parsed code: references, dead and untested symbols, similar symbols, provenance, routes, manifests."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.graph import bfs, cut
from sextant.operators.parsing import _each
from sextant.operators.predicates import classify, is_test_path, jaccard


def references(imports: DataFrame, names: DataFrame) -> DataFrame:
    """name, src: files that import a name, in any case. names: (name)."""
    listed = imports.select("src", F.explode("names").alias("n")).select("src", F.lower("n").alias("key"))
    return listed.join(names.select("name", F.lower("name").alias("key")), "key").select("name", "src").distinct()


def importers(edges: DataFrame, path: str, depth: int = 1) -> DataFrame:
    """node, depth: files that import a path, directly or through others."""
    start = edges.sparkSession.createDataFrame([(path,)], "node string")
    return bfs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth).where("depth > 0")


def cross_repo_importers(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """repo, importer: repositories whose imports (repo, root) name a package that another one (repo, package) publishes."""
    owned = packages.select(F.col("repo").alias("owner"), F.col("package").alias("root"))
    return imports.join(owned, "root").where("repo <> owner").select(F.col("owner").alias("repo"), F.col("repo").alias("importer"), "root").distinct()


def never_called(symbols: DataFrame) -> DataFrame:
    """Functions and methods outside tests whose name no symbol calls."""
    called = symbols.select(F.explode("call_references").alias("name")).distinct()
    return symbols.where("kind in ('function', 'method')").where(~is_test_path(F.col("file"))).join(called.hint("merge"), "name", "left_anti").select("id", "name", "file")


def dead_code(symbols: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """id, confidence: the share of three signs against a symbol: its file is unreachable from entries, its name is never called, its file is never imported."""
    edges = cut(edges.select("src", "dst"))
    reached = bfs(edges, entries).select(F.col("node").alias("file"), F.lit(0).alias("s1"))
    called = symbols.select(F.explode("call_references").alias("name")).distinct().withColumn("s2", F.lit(0))
    imported = edges.select(F.col("dst").alias("file")).distinct().withColumn("s3", F.lit(0))
    out = symbols.where("kind in ('function', 'method', 'class')").join(reached.hint("merge"), "file", "left").join(imported.hint("merge"), "file", "left").join(called.hint("merge"), "name", "left").na.fill(1, ["s1", "s2", "s3"])
    return out.select("id", F.round((F.col("s1") + F.col("s2") + F.col("s3")) / 3, 6).alias("confidence"))


def untested(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, confidence of symbols that no test calls: 0.7 if a test imports their file, else 1."""
    tests = symbols.where(is_test_path(F.col("file")))
    called = tests.select(F.explode("call_references").alias("name")).distinct()
    touched = edges.where(is_test_path(F.col("src"))).select(F.col("dst").alias("file")).distinct().withColumn("seen", F.lit(True))
    rest = symbols.where("kind in ('function', 'method')").where(~is_test_path(F.col("file"))).join(called.hint("merge"), "name", "left_anti")
    return rest.join(touched.hint("merge"), "file", "left").select("id", F.when(F.col("seen"), 0.7).otherwise(1.0).alias("confidence"))


def similar(symbols: DataFrame, least: float = 0.8, most_shared: int = 200) -> DataFrame:
    """a, b, score of (id, words, size): 0.6 shared words + 0.4 size ratio, for pairs that share a word of at most so many symbols."""
    words = symbols.select("id", F.explode(F.array_distinct("words")).alias("w"))
    rare = words.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(2, most_shared)).select("w")
    kept = words.join(rare, "w")
    pairs = kept.alias("x").join(kept.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    one = symbols.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("size").alias("sa"))
    two = symbols.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("size").alias("sb"))
    score = 0.6 * jaccard(F.col("wa"), F.col("wb")) + 0.4 * F.when(F.greatest("sa", "sb") > 0, F.least("sa", "sb") / F.greatest("sa", "sb")).otherwise(0.0)
    return pairs.join(one, "a").join(two, "b").select("a", "b", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def provenance(commits: DataFrame) -> DataFrame:
    """Per file: commits, authors, first and last, the commonest category of (file, sha, ts, author, subject)."""
    named = commits.withColumn("category", classify(F.col("subject")))
    per = named.groupBy("file", "category").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("file").agg(F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("t"))
    base = named.groupBy("file").agg(F.countDistinct("sha").alias("commits"), F.countDistinct("author").alias("authors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return base.join(top, "file").select("file", "commits", "authors", "first_ts", "last_ts", F.col("t.category").alias("category"))


def decisions(commits: DataFrame, pattern: str, per_file: int = 20) -> DataFrame:
    """The newest commits of each file whose subject says that something was decided."""
    kept = commits.where(F.col("subject").rlike(pattern)).withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("ts"), "sha")))
    return kept.where(F.col("r") <= per_file).drop("r")


def tutorial(steps: DataFrame, start: str, most: int = 50) -> DataFrame:
    """place, id: the way from a section along its next links (id, next), each section once."""
    return bfs(steps.select(F.col("id").alias("src"), F.col("next").alias("dst")), steps.sparkSession.createDataFrame([(start,)], "node string"), most).select(F.col("depth").alias("place"), F.col("node").alias("id"))


def schema_graph(api: DataFrame, start: str, depth: int = 5) -> DataFrame:
    """node, depth: schemas that one names, directly or through others."""
    edges = api.where("kind = 'schema'").select(F.col("name").alias("src"), F.explode("refs").alias("dst"))
    return bfs(edges, api.sparkSession.createDataFrame([(start,)], "node string"), depth)


def operations_using(api: DataFrame, schema: str) -> DataFrame:
    return api.where("kind = 'operation'").where(F.array_contains("refs", schema)).select("path", "name")


def unified_diff(before: Column, after: Column) -> Column:
    """The unified diff of two texts, empty where they agree."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), lineterm="")) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "string")(before, after)


def wordpiece(vocabulary: list[str], unknown: str = "[UNK]"):
    """A pandas UDF: pieces of lower-cased words and marks by greedy longest match; a word with none is unknown."""
    known = frozenset(vocabulary)

    def pieces(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in known), None)
            if end is None:
                return [unknown]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p for w in re.findall(r"\w+|[^\w\s]", (t or "").lower()) for p in pieces(w)])

    return F.pandas_udf(run, "array<string>")


ROUTES = [
    ("decorator", r"""@\w+\.(?P<verb>get|post|put|delete|patch|route)\(\s*['"](?P<path>[^'"]+)['"][^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(?P<handler>\w+)"""),
    ("call", r"""\b(?:app|router|api|fastify|server)\.(?P<verb>get|post|put|delete|patch|all)\(\s*['"`](?P<path>[^'"`]+)['"`]\s*,\s*(?:[\w.]+\s*,\s*)*(?P<handler>[\w.]+)?"""),
    ("go", r"""\b\w+\.(?P<verb>GET|POST|PUT|DELETE|PATCH|HandleFunc)\(\s*"(?P<path>[^"]+)"\s*,\s*(?P<handler>[\w.]+)"""),
    ("urls", r"""\b(?P<verb>path|re_path|url)\(\s*r?['"](?P<path>[^'"]*)['"]\s*,\s*(?P<handler>[\w.]+)"""),
    ("facade", r"""Route::(?P<verb>get|post|put|delete|patch|any)\(\s*['"](?P<path>[^'"]+)['"]\s*,\s*\[?\s*(?P<handler>[\w\\:@']+)"""),
    ("rails", r"""(?m)^\s*(?P<verb>get|post|put|patch|delete)\s+['"](?P<path>[^'"]+)['"]\s*(?:,\s*to:\s*|=>\s*)['"](?P<handler>[\w#/]+)['"]"""),
    ("spring", r"""@(?P<verb>Get|Post|Put|Delete|Patch)(?:Mapping)?\(\s*(?:value\s*=\s*)?['"](?P<path>[^'"]*)['"]\s*\)[^{;]*?\b(?P<handler>\w+)\s*\(""")]


def _routes(path: str, content: str) -> list[dict]:
    out = []
    for style, pattern in ROUTES:
        for m in re.finditer(pattern, content):
            out.append({"path": path, "style": style, "verb": m["verb"].upper().removesuffix("MAPPING"), "route": m["path"], "handler": m["handler"] or ""})
    page = re.search(r"(?:^|/)(?:app|pages)/(.*?)/?(?:page|route|index)?\.(?:tsx|jsx|vue|ts|js)$", path)
    if page and not out and re.search(r"(page|route|index)\.\w+$|/pages/", path):
        out.append({"path": path, "style": "file", "verb": "PAGE", "route": "/" + re.sub(r"\[(?:\.\.\.)?(\w+)\]", r":\1", re.sub(r"\((\w+)\)/?", "", page[1])), "handler": ""})
    return out


def routes(files: DataFrame) -> DataFrame:
    """path, style, verb, route, handler of web frameworks' route declarations and page conventions."""
    return _each(files, _routes, "path string, style string, verb string, route string, handler string")


def _manifest(path: str, content: str) -> list[dict]:
    name = path.rpartition("/")[2]
    row = lambda category, key, value: {"path": path, "category": category, "key": key, "value": value}
    if name.startswith("Dockerfile"):
        return [row("docker", k.upper(), v.strip()) for k, v in re.findall(r"(?im)^(FROM|EXPOSE|ENTRYPOINT|CMD|ENV)\s+(.+)$", content)]
    if re.fullmatch(r"\.?env[._](example|template|sample)|env\.(example|template)", name):
        return [row("env", k, v) for k, v in re.findall(r"(?m)^([A-Z][A-Z0-9_]*)=(.*)$", content)]
    if name == "Makefile":
        return [row("make", k, (v or "").strip()) for k, v in re.findall(r"(?m)^([A-Za-z][\w-]*):(?!=)(.*)$", content)]
    if name == "package.json":
        try:
            data = json.loads(content)
        except ValueError:
            return []
        found = [row("script", k, v) for k, v in (data.get("scripts") or {}).items()] + [row("package", "name", data["name"])] * ("name" in data)
        spaces = data.get("workspaces") or []
        return found + [row("workspace", w, "npm") for w in (spaces.get("packages", []) if isinstance(spaces, dict) else spaces)]
    if name == "pyproject.toml":
        return [row("package", "name", v) for v in re.findall(r"""(?m)^name\s*=\s*["']([^"']+)["']""", content)[:1]] + [row("script", k, v) for k, v in re.findall(r"""(?m)^([\w-]+)\s*=\s*["']([\w.]+:[\w.]+)["']""", content)]
    if name == "pnpm-workspace.yaml":
        return [row("workspace", w, "pnpm") for w in re.findall(r"""(?m)^\s*-\s*["']?([^"'\n]+?)["']?\s*$""", content)]
    if name == "Cargo.toml":
        members = re.search(r"(?s)members\s*=\s*\[(.*?)\]", content)
        return [row("workspace", w, "cargo") for w in re.findall(r'"([^"]+)"', members[1] if members else "")]
    if name == "go.work":
        return [row("workspace", w, "go") for w in re.findall(r"(?m)^\s*(?:use\s+)?(\./\S+)", content)]
    if re.search(r"(^|/)\.github/workflows/[^/]+\.ya?ml$", path) or name == ".gitlab-ci.yml":
        return [row("ci", "job", j) for j in re.findall(r"(?m)^ {0,2}([a-z][\w-]*):\s*$", content) if j not in ("on", "jobs", "env", "steps", "permissions")]
    if re.fullmatch(r"(docker-)?compose\.ya?ml", name):
        services = re.search(r"(?ms)^services:\n(.*?)(?=^\S|\Z)", content)
        return [row("service", s, "") for s in re.findall(r"(?m)^ {2}([\w-]+):\s*$", services[1] if services else "")]
    kind = re.search(r"(?m)^kind:\s*(\w+)", content) if name.endswith((".yaml", ".yml")) else None
    return [row("k8s", kind[1], (re.search(r"(?m)^  name:\s*(\S+)", content) or [0, ""])[1])] if kind else []


def manifests(files: DataFrame) -> DataFrame:
    """path, category, key, value of build, container, CI, environment and workspace files."""
    return _each(files, _manifest, "path string, category string, key string, value string")


def freshness_of(stored: Column, current: Column, file_same: Column) -> Column:
    """A section is stale if its own hash differs, edited if only its file's does."""
    return F.when(~stored.eqNullSafe(current), "stale").when(~file_same, "edited").otherwise("fresh")

