"""Runtime traces: parsing spans, SQL and stack logs; resolving them to symbols; aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.operators.graph import cut
from sextant.operators.metrics import nearest_rank

OTEL = "resourceSpans array<struct<scopeSpans: array<struct<spans: array<struct<name: string, startTimeUnixNano: string, endTimeUnixNano: string, attributes: array<struct<key: string, value: struct<stringValue: string, intValue: string>>>>>>>>>"


def otel_spans(text: DataFrame) -> DataFrame:
    """file, line, function, duration_ms of OTLP JSON documents, one in `value` a row; rows that are no JSON give none."""
    doc = F.from_json("value", f"struct<{OTEL}>")
    spans = text.select(F.explode(doc["resourceSpans"]).alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("span"))
    attr = lambda key: F.get(F.filter("span.attributes", lambda a: a["key"] == key), F.lit(0))["value"]
    value = lambda key: F.coalesce(attr(key)["stringValue"], attr(key)["intValue"])
    ms = (F.col("span.endTimeUnixNano").cast("decimal(38,0)") - F.col("span.startTimeUnixNano").cast("decimal(38,0)")).cast("double") / 1e6
    return spans.select(value("code.filepath").alias("file"), value("code.lineno").cast("int").alias("line"), value("code.function").alias("function"), ms.alias("duration_ms"))


# What a table's name follows in SQL.
TABLE_AFTER = r"(?i)\b(?:from|join|into|update|delete\s+from|merge\s+into)\s+([A-Za-z_\"`\[][\w\"`\].\[]*)"


def sql_tables(sql: Column) -> Column:
    """Distinct trailing identifiers of the tables that a statement names."""
    names = F.regexp_extract_all(sql, F.lit(TABLE_AFTER), F.lit(1))
    return F.array_distinct(F.transform(names, lambda n: F.lower(F.regexp_replace(F.element_at(F.split(n, r"\."), -1), r"[\"`\[\]]", ""))))


# What a column looks like in SQL, where columns stand, and which words are none.
SQL_NAME = r'(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_]*)'
SQL_QUALIFIED = rf"({SQL_NAME})\.({SQL_NAME})"
SQL_BARE = rf'(?<![A-Za-z_."]){SQL_NAME}(?!\s*\()'
SQL_SELECT_LIST = r"(?is)\bSELECT\b\s+(?:DISTINCT\s+)?(.+?)\s+\bFROM\b"
SQL_PREDICATE = r"(?is)\b(?:WHERE|ON|HAVING|GROUP\s+BY|ORDER\s+BY)\b(.+?)(?=(?:\b(?:WHERE|ON|HAVING|GROUP\s+BY|ORDER\s+BY|UNION|INTERSECT|EXCEPT|LIMIT|OFFSET|RETURNING)\b|;|$))"
SQL_KEYWORDS = (
    "select from where and or not null true false as on in is by group order having limit offset union intersect except with case when then else end between like ilike exists any all some join left right inner outer full cross lateral "
    "using natural distinct asc desc nulls first last into values insert update delete set returning create drop alter table view index primary key foreign references constraint default unique check cast extract interval current_date "
    "current_time current_timestamp current_user session_user user now unknown merge matched").split()


def sql_columns(sql: Column) -> Column:
    """Distinct (table, column) pairs that a statement names: qualified ones with what stands before the dot, bare ones with an empty table.

    Bare names count in the first select list and in predicates, there from two
    letters on; functions and key words are none.
    """
    word = lambda x: F.trim(x, F.lit('"'))
    column = lambda x: ~F.lower(x).isin(SQL_KEYWORDS)
    pair = lambda t, c: F.struct(t.alias("table"), c.alias("column"))
    qualified = F.zip_with(F.regexp_extract_all(sql, F.lit(SQL_QUALIFIED), F.lit(1)), F.regexp_extract_all(sql, F.lit(SQL_QUALIFIED), F.lit(2)), lambda t, c: pair(word(t), word(c)))
    bare = lambda part: F.filter(F.transform(F.regexp_extract_all(F.regexp_replace(part, SQL_QUALIFIED, " "), F.lit(SQL_BARE), F.lit(0)), word), column)
    listed = bare(F.regexp_extract(sql, SQL_SELECT_LIST, 1))
    tested = F.flatten(F.transform(F.regexp_extract_all(sql, F.lit(SQL_PREDICATE), F.lit(1)), lambda body: F.filter(bare(body), lambda x: F.length(x) > 1)))
    return F.array_distinct(F.concat(F.filter(qualified, lambda q: column(q["column"])), F.transform(F.concat(listed, tested), lambda x: pair(F.lit(""), x))))


def column_models(columns: DataFrame, models: DataFrame) -> DataFrame:
    """model, column, uses: columns (tables array, table, column) of statements joined with models' columns (model, column).

    A qualified name means its table, a bare one any table of the statement.
    """
    meant = F.when(F.col("table") != "", F.array("table")).otherwise(F.col("tables"))
    named = columns.select(F.explode(meant).alias("model"), "column")
    return named.join(models, ["model", "column"]).groupBy("model", "column").agg(F.count(F.lit(1)).alias("uses"))


def table_symbols(statements: DataFrame, symbols: DataFrame) -> DataFrame:
    """table, symbol_id, calls: tables that statements (tables array, calls) read, joined by name with symbols (symbol_id, name); tables without one are left out."""
    used = statements.select(F.explode("tables").alias("table"), "calls").groupBy("table").agg(F.sum("calls").alias("calls"))
    return used.join(symbols.select("symbol_id", F.lower("name").alias("table")), "table").select("table", "symbol_id", "calls")


def sql_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """query, calls, mean_ms of a statement export; column names in any case and of any version."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    low = raw.toDF(*[c.lower() for c in raw.columns])
    pick = lambda *names: next((F.col(n) for n in names if n in low.columns), F.lit(None))
    return low.select(F.col("query"), F.coalesce(pick("calls").cast("long"), F.lit(1)).alias("calls"), pick("mean_exec_time", "mean_time").cast("double").alias("mean_ms"))


def sql_log_json(lines: DataFrame) -> DataFrame:
    """query, calls, mean_ms of JSON lines in `value`; blank lines and comments are skipped."""
    j = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    kept = lines.where(~F.trim("value").rlike(r"^($|#|//)"))
    return kept.select(j("sql", "query", "statement").alias("query"), F.coalesce(j("calls", "count").cast("long"), F.lit(1)).alias("calls"), j("duration_ms", "mean_ms", "elapsed_ms").cast("double").alias("mean_ms")).where("query is not null")


FRAMES = [
    ("python", re.compile(r'^\s*File "([^"]+)", line (\d+), in (\S+)')), ("jvm", re.compile(r"^\s*at ([\w.$]+)\.([\w$<>]+)\(([^:()]+):(\d+)\)")),
    ("node", re.compile(r"^\s*at (?:(\S+) \()?([^():\s]+):(\d+):\d+\)?"))]


def parse_frames(text: str) -> Iterator[tuple[int, str, str, int, str]]:
    """(trace, language, file, line, function) of each frame; a line that is none ends a trace of JVM or Node frames."""
    trace, inside = 0, False
    for line in text.split("\n"):
        if line.startswith("Traceback ("):
            trace, inside = trace + 1, True
            continue
        for language, pattern in FRAMES:
            if m := pattern.match(line):
                if not inside:
                    trace, inside = trace + 1, True
                if language == "python":
                    yield trace, language, m[1], int(m[2]), m[3]
                elif language == "jvm":
                    yield trace, language, m[3], int(m[4]), m[2]
                else:
                    yield trace, language, m[2], int(m[3]), m[1] or ""
                break
        else:
            if line.strip() and not line.startswith(" "):
                inside = False


def stack_frames(logs: DataFrame) -> DataFrame:
    """id, trace, language, file, line, function of (id, text) logs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *f) for i, t in zip(part["id"], part["text"], strict=True) for f in parse_frames(t or "")]
            yield pd.DataFrame(rows, columns=["id", "trace", "language", "file", "line", "function"])

    return logs.select("id", "text").mapInPandas(run, "id long, trace long, language string, file string, line long, function string")


# Words for a severity, and those that tell it in a log.
SEVERITIES = {"error": ["error", "fatal", "critical", "severe"], "warn": ["warn", "warning"]}
LEVEL_WORD = r"(?i)\b(FATAL|CRITICAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE)\b"


def severity(word: Column) -> Column:
    low = F.lower(F.trim(word))
    return F.when(low.isin(SEVERITIES["error"]), "error").when(low.isin(SEVERITIES["warn"]), "warn").otherwise("info")


def stack_json(lines: DataFrame) -> DataFrame:
    """id, severity, ts, message, text of JSON lines (id, value) that hold a stack under any of its names; blank lines, comments and lines without one are skipped."""
    j = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{n}"), F.lit("")) for n in names])
    kept = lines.where(~F.trim("value").rlike("^($|#)"))
    told = severity(F.regexp_extract(j("stack_trace", "stack", "exception").substr(1, 256), LEVEL_WORD, 1))
    level = j("severity", "level", "loglevel")
    return kept.select("id", F.when(level.isNotNull(), severity(level)).otherwise(told).alias("severity"), j("ts", "timestamp", "time").alias("ts"), j("message").alias("message"), j("stack_trace", "stack", "exception").alias("text")).where("trim(text) <> ''")


def innermost(points: DataFrame, spans: DataFrame, by: str = "file", few: int = 0) -> DataFrame:
    """Each point (point_id, by, line) with the narrowest span (symbol_id, by, start, end) around it, ties to the smaller symbol.

    A closed span is dealt to the few cells that make it up, of 1, 2, 4, ...
    lines, each at a multiple of its size. A cell keeps only its narrowest
    span, and a line asks the one cell of each size that it is in, so no line
    meets all spans around it. A null end is open: such a span is wider than
    any closed one, and of open ones the last that starts at or before the
    point is the narrowest, found by a running maximum over lines and spans of
    the same `by` in one sort. Points count by their lines until the end; each
    line with what closed spans give it, or null, is written down, as it is
    read twice (an anti-join would be pushed below the distinct lines, to all
    points). If at most `few` lines have an answer, counted, these are
    broadcast, and points are dealt out once, by their ids, instead of by their
    lines too.
    """
    k, start, end = F.col("size"), F.col("start").cast("long"), F.col("end").cast("long")
    bits = F.length(F.bin(end - start + 1))
    closed = spans.where((end >= start) & F.col(by).isNotNull())
    narrowest = closed.groupBy(by, start.alias("start"), end.alias("end")).agg(F.min("symbol_id").alias("symbol_id"))
    ends = narrowest.withColumn("size", F.explode(F.sequence(F.lit(0), bits - 1))).withColumns({"first": -_cell(-F.col("start"), k), "past": _cell(F.col("end") + 1, k)}).where("first < past")
    odd = lambda c: F.when(F.pmod(F.col(c), F.lit(2)) == 1, F.col(c) - F.lit(int(c == "past")))
    pieces = ends.select(by, "size", F.lit(0).cast("long").alias("rank"), (F.col("end") - F.col("start")).alias("width"), "symbol_id", F.explode(F.array_compact(F.array(odd("first"), odd("past")))).alias("cell"))
    cells = pieces.groupBy(by, "size", "cell").agg(F.min(F.struct("rank", "width", "symbol_id")).alias("b"))
    lines = points.where(F.col(by).isNotNull()).select(by, F.col("line").cast("long").alias("at")).where("at is not null").distinct()
    sizes = closed.agg(F.coalesce(F.max(bits), F.lit(1)).alias("sizes"))
    asked = lines.crossJoin(F.broadcast(sizes)).select(by, "at", F.explode(F.sequence(F.lit(0), F.col("sizes") - 1)).alias("size")).withColumn("cell", _cell(F.col("at"), k))
    best = cut(asked.join(cells.hint("merge"), [by, "size", "cell"], "left").groupBy(by, "at").agg(F.min("b").alias("b")))

    last = F.struct(F.lit(1).cast("long").alias("rank"), (-start).alias("width"), F.col("symbol_id"))
    marks = spans.where(F.col("end").isNull() & F.col(by).isNotNull()).groupBy(by, start.alias("at")).agg(F.min(last).alias("b")).select(by, "at", F.lit(0).alias("later"), "b")
    left = best.where("b is null").select(by, "at", F.lit(1).alias("later"), "b")
    before = Window.partitionBy(by).orderBy("at", "later").rowsBetween(Window.unboundedPreceding, 0)
    open_ = marks.unionByName(left).withColumn("b", F.last("b", ignorenulls=True).over(before)).where("later = 1 and b is not null").select(by, "at", "b")
    answers = best.where("b is not null").unionByName(open_)
    answers = cut(answers) if few else answers
    answers = F.broadcast(answers) if few and answers.limit(few + 1).count() <= few else answers.hint("merge")
    found = points.select("point_id", by, F.col("line").cast("long").alias("at")).join(answers, [by, "at"])
    return found.groupBy("point_id").agg(F.min("b").alias("b")).select("point_id", F.col("b.symbol_id").alias("symbol_id"))


def _cell(line: Column, size: Column) -> Column:
    """The cell of 2 ** size lines that a line is in."""
    return F.call_function("shiftright", line, size)


def by_suffix(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frame, file: the file whose path ends like a frame's, by the longest common suffix of whole segments, if there is just one."""
    suffixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(F.split(c, "/"), -n, n), "/").alias("suffix")))
    a = frames.select("frame", F.inline(suffixes(F.col("frame"))))
    b = files.select("file", F.inline(suffixes(F.col("file"))))
    hits = a.join(b, ["n", "suffix"]).groupBy("frame", "n").agg(F.count(F.lit(1)).alias("k"), F.min("file").alias("file"))
    best = hits.groupBy("frame").agg(F.max(F.struct("n", "k", "file")).alias("b"))
    return best.where("b.k = 1").select("frame", "b.file")


def batch_aggregate(events: DataFrame) -> DataFrame:
    """Per symbol and source: count, nearest-rank percentiles, first and last seen."""
    keys = ["symbol_id", "source"]
    seen = events.groupBy(*keys).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return nearest_rank(events, keys, "duration_ms").join(seen, keys).select(*keys, F.col("n").alias("count"), F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms"), "first_seen", "last_seen")


def hot_paths(calls: DataFrame, top: int = 20) -> DataFrame:
    """symbol_id, hits, worst p95, last seen, sources of runtime state, the most hit first."""
    out = calls.groupBy("symbol_id").agg(F.sum("count").alias("hits"), F.max("p95_ms").alias("p95_ms"), F.max("last_seen").alias("last_seen"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return out.orderBy(F.desc("hits"), "symbol_id").limit(top)


def stack_frequency(events: DataFrame, since: str) -> DataFrame:
    """Per symbol: counts by severity from a time on, first and last seen."""
    recent = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}")
    return recent.groupBy("symbol_id").agg(n("error"), n("warn"), n("info"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def turns(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, turn_start, turn_end, n, total: sessions that end after a gap; the sum of values of each."""
    w = F.session_window("ts", gap)
    out = events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("user_id", F.col("w.start").alias("turn_start"), F.col("w.end").alias("turn_end"), "n", "total")


def gaps(events: DataFrame) -> DataFrame:
    """Seconds since the same user's event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", (F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")).alias("gap_s"))
