"""Files, documents and logs written from rows of the tables, so that what a parser must find in them can be told from the rows by SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.tables import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with its numbers from ten on, so that seven less is a number too."""
    return table(spark, sf_dir, "part").withColumn("p_partkey", F.col("p_partkey") + 10)


def _text(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


PYTHON = '''import os
from .m{back} import f{back}, Base
{link}
LIMIT_{p} = {s}

class C{p}(K, Mixin):
    """Doc of {p}."""
    def run(self, a, b=1):
        if a > {s} and b:
            return f{back}(a)
        return f{p}(os.path.join(str(b)))

@cache
def f{p}(x, *rest):
    for i in range(x):
        print(i)  # TODO later
    return x
'''
TEST = """from pkg{m}.m{p} import f{p}

def test_f{p}():
    assert f{p}(3) == 3
"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a Python module a part in one of seven packages, and a test of every fiftieth.

    Parts are dealt out first: a few MB of rows are many files, and a task that parses them is long for its input.
    """
    p, s = F.col("p_partkey"), F.col("p_size")
    link = F.when(p % 10 == 9, "import sys").otherwise(_text("from pkg{m}.m{n} import C{n} as K", m=(p + 1) % 7, n=p + 1))
    part = _parts(spark, sf_dir).select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    code = part.select(_text("pkg{m}/m{p}.py", m=p % 7, p=p).alias("path"), _text(PYTHON, p=p, s=s, back=p - 7, link=link).alias("content"))
    tests = part.where("p_partkey % 50 = 0").select(_text("tests/test_m{p}.py", p=p).alias("path"), _text(TEST, m=p % 7, p=p).alias("content"))
    return code.unionByName(tests)


SMELLS = [
    "def g(n):\n    n = n + 1\n    return n\n", "try:\n    go()\nexcept:\n    pass\n", "token = 'abcdefgh{p}'\n", "eval('{p}')\n", "for a in b:\n    for c in d:\n        for e in f:\n            go(e)\n",
    "if a:\n    if b:\n        if c:\n            if d:\n                if e:\n                    go()\n", "if a == {p}: go()\n"]


def smelly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a Python file a part, with one of seven faults by the part's number."""
    p = F.col("p_partkey")
    picked = F.element_at(F.array(*[_text(t, p=p) for t in SMELLS]), (1 + p % 7).cast("int"))
    return _parts(spark, sf_dir).select(_text("s{p}.py", p=p).alias("path"), picked.alias("content"))


DOCS = [
    ("md", "# {t}\nIntro #tag{k} `fn{p}()` text.\n## Usage\nSee [next](d{n}.md) and https://ex.org/{p}.\n```py\nx = {p}\n```\n## Notes\nEnd.\n"), ("rst", "{t}\n==========================\nIntro #tag{k}\n\nUsage\n-----\ntext\n\nNotes\n-----\nEnd.\n"),
    ("adoc", "= {t}\nIntro #tag{k}\n== Usage\ntext\n== Notes\nEnd.\n")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a document a part, in turn Markdown, reStructuredText and AsciiDoc, of a title and two sections."""
    p = F.col("p_partkey")
    v = {"t": F.col("p_name"), "k": p % 3, "p": p, "n": p + 1}
    pick = lambda xs: F.element_at(F.array(*xs), (1 + p % 3).cast("int"))
    return _parts(spark, sf_dir).select(F.concat(_text("docs/d{p}.", p=p), pick([F.lit(e) for e, _ in DOCS])).alias("path"), pick([_text(t, **v) for _, t in DOCS]).alias("content"))


def span_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: an OTLP document an event, and every hundredth event one that is no JSON."""
    e = F.col("event_id")
    value = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(
        F.lit("s").alias("name"), (e * 1000).cast("string").alias("startTimeUnixNano"), (e * 1000 + F.floor(F.col("value") * 1000).cast("long") * 1000).cast("string").alias("endTimeUnixNano"),
        F.array(_attribute("code.filepath", "stringValue", _text("src/f{u}.py", u=F.col("user_id"))), _attribute("code.lineno", "intValue", (e % 100).cast("string")), _attribute("code.function", "stringValue", F.lit("fn"))).alias("attributes"))).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return table(spark, sf_dir, "events").select(F.when(e % 100 == 0, "no {json").otherwise(value).alias("value"))


def _attribute(key: str, kind: str, value: Column) -> Column:
    none = F.lit(None).cast("string")
    pick = lambda k: (value if k == kind else none).alias(k)
    return F.struct(F.lit(key).alias("key"), F.struct(pick("stringValue"), pick("intValue")).alias("value"))


STATEMENT = "select distinct a.x, y, count(z) from app.t{u} a join t2 b on a.id = b.id where kind = {e} and b.size > 3 group by y order by y"


def statement_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: a JSON line of a SQL log an event; every tenth is a comment."""
    e = F.col("event_id")
    line = F.to_json(F.struct(_text(STATEMENT, u=F.col("user_id") % 20, e=e).alias("sql"), (e % 5).alias("calls"), F.col("value").alias("duration_ms")))
    return table(spark, sf_dir, "events").select(F.when(e % 10 == 0, "# a comment").otherwise(line).alias("value"))


TRACES = [
    'INFO start\nTraceback (most recent call last):\n  File "src/f{u}.py", line {l}, in load\n    x()\n  File "src/g.py", line 7, in save\n    y()\nValueError: bad\n',
    "ERROR java.lang.IllegalStateException: no\n    at com.acme.F{u}.load(F{u}.java:{l})\n    at com.acme.G.save(G.java:7)\n", "TypeError: x\n    at load (/srv/f{u}.js:{l}:3)\n    at save (/srv/g.js:7:1)\n"]


def stack_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: a log with a stack of two frames an event, in turn of Python, Java and Node."""
    e = F.col("event_id")
    picked = F.element_at(F.array(*[_text(t, u=F.col("user_id"), l=1 + e % 90) for t in TRACES]), (1 + e % 3).cast("int"))
    return table(spark, sf_dir, "events").select(e.alias("id"), picked.alias("text"))


ROUTES = [
    ("py", "@app.get('/r{p}')\ndef h{p}(): pass\n"), ("js", "app.post('/r{p}', h{p})\n"), ("go", 'r.GET("/r{p}", h{p})\n'), ("php", "Route::put('/r{p}', [h{p}])\n"), ("rb", "delete '/r{p}', to: 'h{p}#go'\n"), ("java", '@GetMapping("/r{p}")\npublic String h{p}();\n')]


def routers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a file with one route a part, in turn of six frameworks."""
    p = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*xs), (1 + p % 6).cast("int"))
    return _parts(spark, sf_dir).select(F.concat(_text("r{p}.", p=p), pick([F.lit(e) for e, _ in ROUTES])).alias("path"), pick([_text(t, p=p) for _, t in ROUTES]).alias("content"))


MANIFESTS = [
    ("Dockerfile", "FROM base:{s}\nEXPOSE {p}\n"), ("package.json", ""), ("Makefile", "all: x{s}\nclean:\n"), ("Cargo.toml", '[workspace]\nmembers = ["c{s}", "d"]\n'),
    (".env.example", "KEY_{p}={s}\n"), ("compose.yml", "services:\n  web{p}:\n    image: x\n")]


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a build, container or workspace file a part."""
    p = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*xs), (1 + p % 6).cast("int"))
    json_text = F.concat(F.lit('{"name": "n'), p.cast("string"), F.lit('", "scripts": {"build": "b '), F.col("p_size").cast("string"), F.lit('"}, "workspaces": ["w/'), F.col("p_size").cast("string"), F.lit('"]}'))
    texts = [json_text if n == "package.json" else _text(t, p=p, s=F.col("p_size")) for n, t in MANIFESTS]
    return _parts(spark, sf_dir).select(F.concat(_text("d{p}/", p=p), pick([F.lit(n) for n, _ in MANIFESTS])).alias("path"), pick(texts).alias("content"))


def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: an OpenAPI document a part, of one operation and two schemas."""
    p = F.col("p_partkey").cast("string")
    body = ['{"paths": {"/p', p, '": {"get": {"summary": "s', p, '", "responses": {"200": {"$ref": "#/components/schemas/A', p, '"}}}}}, "components": {"schemas": {"A', p, '": {"description": "d", "x": {"$ref": "#/components/schemas/B"}}, "B": {}}}}']
    return _parts(spark, sf_dir).select(F.concat(F.lit("api"), p, F.lit(".json")).alias("path"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in body]).alias("content"))


MODEL = "{# c #}select {{ x }} from {{ ref('m$P') }} join {{ source('raw', 'r$K') }}{% if a %} where 1{% endif %}"


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a templated SQL model a part."""
    p = F.col("p_partkey")
    return _parts(spark, sf_dir).select(F.concat(F.lit("models/m"), p.cast("string"), F.lit(".sql")).alias("path"), F.replace(F.replace(F.lit(MODEL), F.lit("$P"), (p + 1).cast("string")), F.lit("$K"), (p % 4).cast("string")).alias("content"))
