"""Table-generating operators: files to symbols, imports, sections; edges from specifiers to files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import code, markup
from sextant.operators.graph import cut
from sextant.operators.predicates import is_binary, is_secret_path

SYMBOLS = ("id string, file string, language string, name string, qualified_name string, kind string, signature string, docstring string, line int, end_line int, parent string, decorators array<string>, "
           "call_references array<string>, cyclomatic int, max_nesting int, param_count int")
IMPORTS = "src string, specifier string, names array<string>, is_re_export boolean, re_export_kind string"
SECTIONS = "id string, doc_path string, title string, level int, parent_id string, content string, byte_start long, byte_end long, content_hash string, code_blocks array<string>, tags array<string>"


def scan(spark: SparkSession, root: str, max_bytes: int = 500_000, pattern: str = "*") -> DataFrame:
    """path, content, skip_reason of all files under a folder; null reason: to be parsed. Names that begin with a dot or underscore are not listed."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").rpartition("/")[2] + "/", "")
    reason = F.when(is_secret_path(path), "secret").when(F.col("length") > max_bytes, "too_large").when(is_binary(F.col("content")), "binary").when(path.rlike(r"(^|/)(node_modules|\.git|dist|build|vendor|__pycache__)/"), "ignored")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length"), reason.alias("skip_reason"))


def _names(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(", ")]


def _each(files: DataFrame, parse: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    names = _names(schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 1000):  # what is found in a file can be much more than the file
                some = part.iloc[i : i + 1000]
                rows = [r for p, c in zip(some["path"], some["content"], strict=True) for r in parse(p, c or "")]
                yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _each(files, code.symbols, SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    return _each(files, lambda p, c: [x | {"src": p} for x in code.imports(p, c)], IMPORTS)


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols and imports of files, each file parsed once: written down, for operators that read them several times."""

    def both(path: str, content: str) -> list[dict]:
        return [*code.symbols(path, content), *(x | {"src": path} for x in code.imports(path, content))]

    found = cut(_each(files, both, f"{SYMBOLS}, {IMPORTS}"))
    pick = lambda test, schema: found.where(test).select(*_names(schema))
    return pick("id is not null", SYMBOLS), pick("src is not null", IMPORTS)


def sections(files: DataFrame) -> DataFrame:
    return _each(files, markup.sections, SECTIONS)


def findings(files: DataFrame, wanted: tuple[str, ...] = code.PRESETS) -> DataFrame:
    """path, preset, line, text of suspicious Python."""
    return _each(files, lambda p, c: [{"path": p, "preset": a, "line": b, "text": t} for a, b, t in code.suspicious(c, wanted)] if p.endswith(".py") else [], "path string, preset string, line int, text string")


def custom(files: DataFrame, spec: str) -> DataFrame:
    code.pattern(spec)
    return _each(files, lambda p, c: [{"path": p, "preset": a, "line": b, "text": t} for a, b, t in code.custom(c, spec)] if p.endswith(".py") else [], "path string, preset string, line int, text string")


def api(files: DataFrame) -> DataFrame:
    return _each(files, lambda p, c: [x | {"path": p} for x in markup.openapi(c)], "path string, kind string, name string, summary string, refs array<string>")


def directives(files: DataFrame) -> DataFrame:
    """path, kind, name of templated SQL models' references."""
    return _each(files, lambda p, c: [{"path": p, "kind": k, "name": n} for k, n in code.dbt_directives(c)] if p.endswith(".sql") else [], "path string, kind string, name string")


def model_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: models that refer to others, by the stem of the file's name; none to itself."""
    stem = F.regexp_extract("path", r"([^/]+)\.sql$", 1)
    models = files.where("path like '%.sql'").select(F.col("path").alias("dst"), stem.alias("name"))
    return found.where("kind = 'ref'").select(F.col("path").alias("src"), "name").join(models, "name").where("src <> dst").select("src", "dst").distinct()


def plain_sql(files: DataFrame) -> DataFrame:
    """path, sql: models with their templates made identifiers."""
    return _each(files, lambda p, c: [{"path": p, "sql": code.strip_jinja(c)}] if p.endswith(".sql") else [], "path string, sql string")


def edges(found: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """src, dst: each import resolved to the file that its best candidate path names; none of a file to itself.

    Candidates follow from the importer's folder and from whether it is
    Python, so what many files of a folder import is tried once.
    """
    key = ["folder", "python", "specifier"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*k, i, c) for *k, s in part[[*key, "src"]].itertuples(index=False) for i, c in enumerate(dict.fromkeys(code.candidates(k[2], s, aliases)))]
            yield pd.DataFrame(rows, columns=[*key, "priority", "dst"])

    asked = found.select("src", F.regexp_extract("src", "(?s)^(.*/)", 1).alias("folder"), F.col("src").endswith(".py").alias("python"), "specifier").distinct()
    tried = asked.groupBy(*key).agg(F.min("src").alias("src")).mapInPandas(run, "folder string, python boolean, specifier string, priority int, dst string")
    hits = tried.join(files.select(F.col("path").alias("dst")).hint("merge"), "dst").groupBy(*key).agg(F.min(F.struct("priority", "dst")).alias("b"))
    return asked.join(hits.hint("merge"), key).select("src", F.col("b.dst").alias("dst")).where("src <> dst").distinct()


def calls(found: DataFrame, linked: DataFrame) -> DataFrame:
    """caller, callee, resolution: names called, in the same file (ast_resolved) or in one that it imports (ast_inferred).

    A name is looked up with the file it must be in, so that one which many files have meets only those.
    """
    named = found.select(F.col("id").alias("caller"), F.col("file").alias("src"), F.explode("call_references").alias("name"))
    targets = found.where("kind in ('function', 'method', 'class')").select(F.col("id").alias("callee"), F.col("file").alias("dst"), "name").hint("merge")
    same = named.withColumn("dst", F.col("src")).join(targets, ["dst", "name"]).select("caller", "callee", F.lit("ast_resolved").alias("resolution"))
    other = named.join(linked.where("src <> dst").hint("merge"), "src").join(targets, ["dst", "name"]).select("caller", "callee", F.lit("ast_inferred").alias("resolution"))
    return same.unionByName(other).where("caller <> callee").distinct()


def class_hierarchy(found: DataFrame) -> DataFrame:
    """class, base of the class symbols' signatures."""
    bases = F.split(F.coalesce(F.nullif(F.regexp_extract("signature", r"\(([^)]*)\)", 1), F.lit("")), F.regexp_replace(F.regexp_extract("signature", r"\b(?:extends|implements)\s+([^{]*)", 1), r"\b(?:extends|implements)\b", ",")), ",")
    return found.where("kind = 'class'").select(F.col("name").alias("class"), F.explode(bases).alias("b")).select("class", F.trim(F.regexp_replace("b", r"[<\[].*$", "")).alias("base")).where("base <> '' and base not like '%=%'")


def outline(found: DataFrame) -> DataFrame:
    """Symbols by file and line with their depth in the nesting."""
    depth = F.size(F.split("qualified_name", r"\.")) - 1
    return found.select("file", "line", "id", "name", "kind", depth.alias("depth"), F.row_number().over(Window.partitionBy("file").orderBy("line", "id")).alias("place"))


def api_symbols(files: DataFrame) -> DataFrame:
    """Operations and schemas of API documents as symbols: id, file, name, kind, signature."""
    kind = F.when(F.col("kind") == "operation", "function").otherwise("class")
    return api(files).select(F.concat("path", F.lit("::"), "name", F.lit("#"), kind).alias("id"), F.col("path").alias("file"), "name", kind.alias("kind"), F.col("summary").alias("signature"))


def template_parts(files: DataFrame) -> DataFrame:
    """path, kind, name, line of templates."""
    return _each(files, lambda p, c: [{"path": p, "kind": k, "name": n, "line": i} for k, n, i in code.template_symbols(c)], "path string, kind string, name string, line int")


def model_columns(files: DataFrame) -> DataFrame:
    """model, column, description of dbt schema files."""
    return _each(files, lambda p, c: [{"model": m, "column": k, "description": d} for m, k, d in code.dbt_columns(c)] if p.endswith((".yml", ".yaml")) else [], "model string, column string, description string")


def cached(files: DataFrame, cache: DataFrame, parse: Callable[[DataFrame], DataFrame] = symbols) -> tuple[DataFrame, DataFrame]:
    """Symbols of files by content: those that the cache (content_hash, file, ...) has, and what parsing the others gave, with their hashes.

    Only files whose content the cache lacks are parsed, one of each content.
    """
    hashed = files.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    known = cache.join(hashed.select("content_hash").distinct(), "content_hash", "left_semi")
    fresh = hashed.join(cache.select("content_hash").distinct(), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    found = parse(fresh.select("path", "content")).join(fresh.select(F.col("path").alias("file"), "content_hash"), "file")
    return known, found


def blame(commit_files: DataFrame) -> DataFrame:
    """file, author, ts: who changed a file last, of (file, sha, author, ts); ties to the larger sha."""
    last = commit_files.groupBy("file").agg(F.max(F.struct("ts", "sha", "author")).alias("b"))
    return last.select("file", "b.author", "b.ts")
