"""Filters: criteria compiled to Column expressions, globs, path and content predicates, ordered classifiers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = {"kind", "language", "name", "file", "complexity", "decorator", "calls", "summary", "churn"}
NUMERIC = {"complexity": "cyclomatic", "churn": "churn"}
LISTS = {"decorator": "decorators", "calls": "call_references"}
OPS = {"eq", "==", "in", "matches", "contains", ">", "<", ">=", "<="}


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell glob: *, ?, [set]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def path_matches(path: Column, pattern: str) -> Column:
    """The glob holds for the path or, as */glob, for its end."""
    return path.rlike(glob_regex(pattern)) | path.rlike(glob_regex("*/" + pattern))


def check_criteria(criteria: Sequence[dict]) -> None:
    """Raise ValueError for an unknown axis or operator or a bad pattern, before any plan is made."""
    for c in criteria:
        if c.get("axis") not in AXES:
            raise ValueError(f"unknown axis {c.get('axis')!r}")
        if c.get("op") not in OPS:
            raise ValueError(f"unknown operator {c.get('op')!r}")
        if c["op"] == "matches" and c["axis"] != "file":
            re.compile(str(c["value"]))


def numeric(value: Column, op: str, threshold) -> Column:
    """value op threshold; a null value counts as 0, a threshold that is no number makes it false."""
    try:
        t = F.lit(float(threshold))
    except (TypeError, ValueError):
        return F.lit(False)
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return {"eq": v == t, "==": v == t, ">": v > t, "<": v < t, ">=": v >= t, "<=": v <= t}[op]


def criterion(c: dict) -> Column:
    axis, op, value = c["axis"], c["op"], c["value"]
    if axis in NUMERIC:
        return numeric(F.col(NUMERIC[axis]), op, value)
    if axis in LISTS:
        needle = F.lit(str(value).lower())
        return F.exists(LISTS[axis], lambda x: F.lower(x).contains(needle) if op == "contains" else F.lower(x) == needle)
    column = F.coalesce(F.col(axis), F.lit(""))
    if op == "in":
        return column.isin(list(value))
    if op == "contains":
        return F.lower(column).contains(str(value).lower())
    if op == "matches":
        return path_matches(column, value) if axis == "file" else column.rlike(str(value))
    return column == F.lit(value)


def winnow(symbols: DataFrame, criteria: Sequence[dict], rank_by: str = "cyclomatic", descending: bool = True, limit: int = 20) -> DataFrame:
    """Symbols that meet every criterion, the first `limit` by rank_by, then id."""
    check_criteria(criteria)
    kept = symbols.where(reduce(lambda a, b: a & b, map(criterion, criteria), F.lit(True)))
    order = F.col(rank_by).desc_nulls_last() if descending else F.col(rank_by).asc_nulls_last()
    return kept.orderBy(order, "id").limit(limit)


def find_symbol(symbols: DataFrame, wanted: str) -> DataFrame:
    """Symbols by exact id, else exact name, else name in any case: only the best tier that has any."""
    tier = F.when(F.col("id").cast("string") == wanted, 1).when(F.col("name") == wanted, 2).when(F.lower("name") == wanted.lower(), 3)
    found = symbols.withColumn("tier", tier).where("tier is not null")
    best = found.agg(F.min("tier").alias("best"))
    return found.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


# Commit categories, the first that matches wins.
COMMIT_CATEGORIES = [
    ("revert", r"^revert"), ("rename", r"\brename[ds]?\b|\bmove[ds]?\b"), ("bugfix", r"\bfix(?:e[ds])?\b|\bbug\b|\bpatch\b|\bhotfix\b|\bcorrect\b|\bresolve[ds]?\b"),
    ("perf", r"\bperf(?:ormance)?\b|\boptimiz[e]?\b|\bspeed\b|\bfaster\b|\bcache\b"), ("refactor", r"\brefactor\b|\bclean\s*up\b|\brestructur\b|\bsimplif\b|\bextract\b|\bdecompos\b"),
    ("test", r"\btest[s]?\b|\bspec[s]?\b|\bcoverage\b"), ("docs", r"\bdoc[s]?\b|\breadme\b|\bchangelog\b|\bcomment\b"),
    ("config", r"\bconfig\b|\bci\b|\bdocker\b|\byaml\b|\benv\b|\bdeps?\b|\bbump\b|\bupgrade\b"), ("feature", r"\badd[s]?\b|\bfeat(?:ure)?\b|\bimplement\b|\bintroduc\b|\bnew\b|\bsupport\b|\benable\b")]


def classify(text: Column, rules: Sequence[tuple[str, str]] = COMMIT_CATEGORIES, default: str = "evolution") -> Column:
    """The name of the first rule whose pattern is found, in any case."""
    return reduce(lambda e, rule: e.when(text.rlike("(?i)" + rule[1]), rule[0]), rules[1:], F.when(text.rlike("(?i)" + rules[0][1]), rules[0][0])).otherwise(default)


def is_test_path(path: Column) -> Column:
    """A test by directory or file name, as the health and dead-code operators have it."""
    name = F.substring_index(path, "/", -1)
    return path.contains("/tests/") | path.contains("/test/") | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")


def is_test_path_of_change(path: Column) -> Column:
    """A test as the change-risk operator has it: wider, in any case, also by the path's beginning."""
    low = F.lower(F.regexp_replace(path, r"\\\\", "/"))
    inside = [low.contains(x) for x in ("/test", "/__tests__/", "_test.", ".test.", ".spec.", "_spec.")]
    return reduce(lambda a, b: a | b, inside, low.startswith("test") | F.substring_index(low, "/", -1).contains("test_"))


def is_production_path(path: Column) -> Column:
    return ~path.rlike(r"(^|/)(tests?|benchmarks?|scripts?|examples?)/")


def is_secret_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(\.env(\..*)?|id_(rsa|dsa|ecdsa|ed25519)|[^/]*\.(pem|key|p12|pfx|jks|keystore)|credentials(\.json)?|\.npmrc|\.netrc|\.pypirc)$")


def is_binary(content: Column, head: int = 8192) -> Column:
    """A zero byte among the first bytes."""
    return F.regexp_count(F.hex(F.substring(content, 1, head)), F.lit("^(..)*?00")) > 0


def row_summary(signature: Column, summary: Column) -> Column:
    """Blank where the summary only repeats the signature or its first 120 characters."""
    return F.when((summary == signature) | (summary == F.substring(signature, 1, 120)), "").otherwise(summary)


def tags_match(tags: Column, all_of: Sequence[str] = (), none_of: Sequence[str] = ()) -> Column:
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return (F.size(F.array_except(lit(all_of), tags)) == 0) & ~F.arrays_overlap(tags, lit(none_of))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def trigrams(text: Column) -> Column:
    """Distinct lower-case runs of three characters; a shorter text is its only one."""
    low = F.lower(text)
    return F.when(F.length(low) < 3, F.array(low)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: low.substr(i, F.lit(3)))))


def token_savings(raw: Column, response: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((raw - response) / 4))


def byte_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared bytes over the shorter range's; 0 for an empty range."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    short = F.least(a_end - a_start, b_end - b_start)
    return F.when(short > 0, shared / short).otherwise(0.0)
