"""Indexing jobs: which files count, code and documents from a folder to saved tables, single files, both at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.code import EXTENSIONS
from sextant.operators import parsing, storage
from sextant.operators.predicates import glob_regex, is_binary, is_secret_path

# Folders and names that are never indexed, ends of documents, and how large a file may be.
SKIPPED_FOLDERS = ["node_modules", "vendor", "venv", ".venv", "__pycache__", "dist", "build", ".git", ".tox", ".mypy_cache", "target", ".gradle", ".next", "coverage"]
SKIPPED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock"]
DOC_ENDS = ["md", "markdown", "mdx", "rst", "adoc", "asciidoc", "txt", "ipynb", "html", "htm", "json", "jsonc", "xml", "svg"]
CODE_ENDS = [x for x in EXTENSIONS if x not in DOC_ENDS[:6]]
CODE_BYTES, DOC_BYTES = 500 * 1024, 10 * 1024 * 1024


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression, ignored) of a .gitignore, in order; the last rule that matches a path decides."""
    rules = []
    for raw in text.split("\n"):
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        ignored = not line.startswith("!")
        line = line.lstrip("!")
        folder, rooted, body = line.endswith("/"), "/" in line.rstrip("/"), line.strip("/")
        inner = "".join("(?:.*/)?" if p == "**/" else ".*" if p == "**" else glob_regex(p)[5:-1].replace(".*", "[^/]*").replace(".", "[^/]") if p == "?" else glob_regex(p)[5:-1].replace(".*", "[^/]*") for p in _pieces(body))
        rules.append((("^" if rooted else "^(?:.*/)?") + inner + ("/.*$" if folder else "(?:/.*)?$"), ignored))
    return rules


def _pieces(pattern: str) -> list[str]:
    """A pattern cut at double stars."""
    out, rest = [], pattern
    while "**" in rest:
        before, _, rest = rest.partition("**")
        out += [before] if before else []
        if rest.startswith("/"):
            out, rest = [*out, "**/"], rest[1:]
        else:
            out.append("**")
    return [*out, rest] if rest else out


def ignored(path: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches says so."""
    out = F.lit(False)
    for pattern, yes in rules:
        out = F.when(path.rlike(pattern), F.lit(yes)).otherwise(out)
    return out


def skip_reason(path: Column, length: Column, content: Column, most: int = CODE_BYTES, rules: Sequence[tuple[str, bool]] = (), ends: Sequence[str] | None = None) -> Column:
    """Why a file isn't indexed, or null: ignored, a skipped folder or name, a secret, another kind of file, too large, empty, binary."""
    name = F.substring_index(path, "/", -1)
    folders = F.split(path, "/")
    end = F.lower(F.substring_index(name, ".", -1))
    return (F.when(ignored(path, rules), "ignored").when(F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_FOLDERS))), "skipped_folder")
            .when(name.isin(SKIPPED_NAMES), "skipped_name").when(is_secret_path(path), "secret").when(~(name.contains(".") & end.isin(list(ends or CODE_ENDS))), "unsupported").when(length > most, "too_large").when(length == 0, "empty").when(is_binary(content), "binary"))


def folder(spark: SparkSession, root: str, most: int = CODE_BYTES, ignore: str = "", ends: Sequence[str] | None = None) -> DataFrame:
    """path, content, length, skip_reason of a folder's files. Names that begin with a dot or underscore are not listed."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").rpartition("/")[2] + "/", "")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), "length", skip_reason(path, F.col("length"), F.col("content"), most, ignore_rules(ignore), ends).alias("skip_reason"))


def explicit(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """path, content, length, skip_reason of given paths under a folder; paths that leave it, or aren't there, give none."""
    inside = [p for p in paths if not p.startswith("/") and ".." not in p.split("/")]
    wanted = spark.createDataFrame([(p,) for p in inside], "path string")
    return folder(spark, root).join(F.broadcast(wanted.distinct()), "path", "left_semi")  # as many rows as were given


def index_code(files: DataFrame, root: str, repo: str) -> dict[str, DataFrame]:
    """Parse code (path, content) and save its symbols, imports and edges as a repository's tables; what was saved."""
    tables = {"files": files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash")), "symbols": parsing.symbols(files), "imports": parsing.imports(files)}
    tables["edges"] = parsing.edges(tables["imports"], files)
    storage.save_index(tables, root, repo)
    return {name: storage.load_index(files.sparkSession, root, name, repo) for name in tables}


def index_docs(files: DataFrame, root: str, repo: str) -> DataFrame:
    """Parse documents (path, content) and save their sections; what was saved."""
    storage.save_index({"sections": parsing.sections(files)}, root, repo)
    return storage.load_index(files.sparkSession, root, "sections", repo)


def index_file(file: DataFrame, root: str, repo: str) -> None:
    """Put one file's symbols (path, content) in the place of those that its repository's table has for it."""
    spark = file.sparkSession
    old = storage.load_index(spark, root, "symbols", repo).drop("repo")
    fresh = parsing.symbols(file)
    kept = old.join(F.broadcast(file.select(F.col("path").alias("file"))), "file", "left_anti")  # one row
    from sextant.operators.graph import cut

    storage.save_index({"symbols": cut(kept.select(*fresh.columns).unionByName(fresh))}, root, repo)


def index_content(spark: SparkSession, source: str, root: str, repo: str, domain: str = "both") -> dict[str, DataFrame]:
    """Index a folder's code, its documents, or both."""
    if domain not in ("code", "docs", "both"):
        raise ValueError(f"no such domain: {domain!r}")
    out = {}
    if domain != "docs":
        out |= index_code(folder(spark, source).where("skip_reason is null"), root, repo)
    if domain != "code":
        out["sections"] = index_docs(folder(spark, source, DOC_BYTES, ends=DOC_ENDS).where("skip_reason is null"), root, repo)
    return out
