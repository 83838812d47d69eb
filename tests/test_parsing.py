import json

import pytest
from pyspark.sql import functions as F

from sextant.functions import code, markup
from sextant.operators import docs, parsing, predicates, runtime

PY = '''import os
from .models import Base, helper
LIMIT = 10

class Animal(Base):
    """An animal."""
    def speak(self, loud, times=1):
        if loud and times > 3:
            return helper(times)
        return os.path.join("a")

class Dog(Animal):
    @staticmethod
    def speak(loud): return Animal.speak(loud)

def speak(): pass
def speak(): pass
'''


def test_python_symbols():
    found = {s["id"]: s for s in code.symbols("pkg/zoo.py", PY)}
    assert list(found) == ["pkg/zoo.py::LIMIT#constant", "pkg/zoo.py::Animal#class", "pkg/zoo.py::Animal.speak#method", "pkg/zoo.py::Dog#class", "pkg/zoo.py::Dog.speak#method", "pkg/zoo.py::speak#function", "pkg/zoo.py::speak#function~1"]
    s = found["pkg/zoo.py::Animal.speak#method"]
    assert (s["line"], s["end_line"], s["param_count"], s["cyclomatic"], s["call_references"], s["parent"]) == (7, 10, 2, 3, ["helper", "join"], "pkg/zoo.py::Animal#class")
    assert code.symbols("bad.py", "def (") == [] and code.symbols("x.unknown", "def f") == []


@pytest.mark.parametrize(("path", "text", "names"), [
    ("a.ts", "export class A {}\nexport const f = (x) => x\ninterface B {}", ["A", "f", "B"]), ("a.go", "type T struct{}\nfunc (t T) M() {}\nfunc F() {}", ["T", "M", "F"]), ("a.rs", "pub struct S;\npub fn go() {}", ["S", "go"]),
    ("q.sql", "CREATE TABLE IF NOT EXISTS a.b (x int);\ncreate view v as select 1", ["a.b", "v"]), ("s.css", ":root { }\n--gap: 1px;\n.box { }", ["--gap", ".box"]), ("c.json", '{"k": 1, "m": []}', ["k", "m"]), ("y.yaml", "name: x\n  inner: 1\nother: 2", ["name", "other"])])
def test_other_languages(path, text, names):
    assert [s["name"] for s in code.symbols(path, text)] == names


def test_imports_and_resolution(spark):
    files = {"pkg/zoo.py": PY, "pkg/models.py": "class Base: pass\ndef helper(n): return n", "pkg/__init__.py": "from .zoo import Dog\nfrom .models import *", "web/app.ts": "import {a as b} from './lib'\nexport * from '@x/y'\nimport x from '~/lib/index'", "web/lib/index.ts": "export const a = 1"}
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    found = {(r.src, r.specifier): r for r in parsing.imports(df).collect()}
    assert found["pkg/zoo.py", ".models"].names == ["Base", "helper"] and found["pkg/__init__.py", ".models"].re_export_kind == "wildcard"
    assert found["web/app.ts", "./lib"].names == ["a"] and found["web/app.ts", "@x/y"].is_re_export
    edges = parsing.edges(parsing.imports(df), df, {"~/*": "web/*"})
    assert {(r.src, r.dst) for r in edges.collect()} == {("pkg/zoo.py", "pkg/models.py"), ("pkg/__init__.py", "pkg/zoo.py"), ("pkg/__init__.py", "pkg/models.py"), ("web/app.ts", "web/lib/index.ts")}
    symbols = parsing.symbols(df)
    calls = {(r.caller, r.callee, r.resolution) for r in parsing.calls(symbols, edges).collect()}
    assert ("pkg/zoo.py::Animal.speak#method", "pkg/models.py::helper#function", "ast_inferred") in calls
    assert {(r["class"], r.base) for r in parsing.class_hierarchy(symbols).collect()} == {("Animal", "Base"), ("Dog", "Animal")}
    assert [r.depth for r in parsing.outline(symbols).where("file = 'pkg/zoo.py'").orderBy("place").collect()][:3] == [0, 0, 1]
    assert code.root_package("@x/y/z", "typescript") == "@x/y" and code.root_package("github.com/a/b/c", "go") == "github.com/a/b"


def test_findings(spark):
    text = "password = 'hunter22222'\ntry:\n    eval('1')\nexcept:\n    pass\n# TODO later\nfor a in b:\n  for c in d:\n    for e in f:\n      if e > 41: x = 1\ndef g(n):\n    n = 2\n"
    assert {p for p, _, _ in code.suspicious(text)} == {"hardcoded_secret", "eval_exec", "bare_except", "empty_catch", "todo_fixme", "nested_loops", "magic_number", "reassigned_param"}
    df = spark.createDataFrame([("a.py", text), ("b.txt", text)], "path string, content string")
    assert {r.path for r in parsing.findings(df).collect()} == {"a.py"}
    assert [r.line for r in parsing.custom(df, "call:ev*").collect()] == [3]
    with pytest.raises(ValueError):
        code.pattern("nothing:x")


def test_sections(spark):
    md = "intro\n# One\ntext #tag `f()`\n## Two\n```py\n# not a heading\nx = 1\n```\n# One\nmore\nSetext\n------\nend"
    df = spark.createDataFrame([("d/a.md", md), ("b.rst", "Top\n===\nx\n\nSub\n---\ny"), ("c.adoc", "= T\n== U\nz"), ("p.txt", "one\n\ntwo")], "path string, content string")
    got = {r.id: r for r in parsing.sections(df).collect()}
    assert [k for k in got if k.startswith("d/")] == ["d/a.md::amd#0", "d/a.md::one#1", "d/a.md::one/two#2", "d/a.md::one-2#1", "d/a.md::one/setext#2"]
    assert got["d/a.md::one/two#2"].parent_id == "d/a.md::one#1" and got["d/a.md::one/two#2"].code_blocks == ["# not a heading\nx = 1\n"] and got["d/a.md::one#1"].tags == ["tag"]
    assert "b.rst::top/sub#2" in got and "c.adoc::t/u#2" in got and sum(k.startswith("p.txt") for k in got) == 2
    raw = md.encode()
    assert raw[got["d/a.md::one/two#2"].byte_start : got["d/a.md::one/two#2"].byte_end].startswith(b"## Two")


def test_conversions():
    assert markup.html("<h1>A&amp;B</h1><p>x  y<script>no</script></p><ul><li>i</li></ul>") == "# A&B\n\nx y\n\n- i"
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "x"}]})
    assert markup.notebook(nb) == "# T\n\n```python\nx\n```" and markup.notebook("no") == ""
    assert markup.json_text('{"a": 1, // c\n "b": {"c": [1, "x"]}}') == "# a\n\n1\n\n# b\n\n## c\n\n- 1\n- x"
    assert markup.xml_text("<a id='1'><b>t</b></a>") == "# a 1\n\n## b\n\nt"
    spec = json.dumps({"paths": {"/p": {"get": {"summary": "s", "responses": {"200": {"$ref": "#/components/schemas/P"}}}}}, "components": {"schemas": {"P": {"description": "d"}}}})
    assert [(x["kind"], x["name"], x["refs"]) for x in markup.openapi(spec)] == [("operation", "GET /p", ["P"]), ("schema", "P", [])]
    assert markup.compress_code("a\n```py\n# c\n\nx\n```\n") == "a\n```py\nx\n```\n"
    assert code.strip_jinja("select {{ x }} from {{ ref('m') }} {# c #}{% if a %}") == "select __jinja__ from m "
    assert markup.strip_mdx("import A from 'a'\n<A x='1'/>hi\n```\nimport b from c\n```") == "hi\n```\nimport b from c\n```"


def test_references(spark):
    text = "[a](x.md \"t\") ![i](img.png) <https://q.r> http://bare.io/x. `[no](code)`\n[ref]: <dir/file.md> 'T'\n<!-- [c](hidden) -->\n```\n[f](fence)\n```"
    row = spark.createDataFrame([(text,)], "c string").select(docs.references(F.col("c")).alias("r"), docs.inline_code(F.lit("`foo()` `a b` `foo()` `x.y`")).alias("i"))
    assert row.first().r == ["<dir/file.md>", "x.md", "https://q.r", "http://bare.io/x"] and row.first().i == ["foo", "x.y"]


def test_glossary(spark):
    s = spark.createDataFrame([(1, "**Term** - a definition\ntext"), (2, "**term** — another one")], "id long, content string")
    assert [tuple(r) for r in docs.glossary(s).collect()] == [("Term", "a definition", 1)]


def test_traces(spark, tmp_path):
    span = {"name": "n", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3500000", "attributes": [{"key": "code.filepath", "value": {"stringValue": "a.py"}}, {"key": "code.lineno", "value": {"intValue": "7"}}, {"key": "other", "value": {"stringValue": "x"}}]}
    df = spark.createDataFrame([(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}),), ("junk",)], "value string")
    assert [tuple(r) for r in runtime.otel_spans(df).collect()] == [("a.py", 7, None, 2.5)]
    sql = spark.createDataFrame([('select * from a.Orders o join "b"."Items" on 1=1 where x in (select 1 from orders)',)], "q string")
    assert sql.select(runtime.sql_tables(F.col("q"))).first()[0] == ["orders", "items"]
    (tmp_path / "log.csv").write_text('Query,Calls,mean_time\n"select 1,\n2",3,1.5\n')
    assert [tuple(r) for r in runtime.sql_log_csv(spark, str(tmp_path / "log.csv")).collect()] == [("select 1,\n2", 3, 1.5)]
    lines = spark.createDataFrame([('{"sql": "s", "count": 2, "mean_ms": 4}',), ("# c",), ("",)], "value string")
    assert [tuple(r) for r in runtime.sql_log_json(lines).collect()] == [("s", 2, 4.0)]
    text = 'x\nTraceback (most recent call last):\n  File "a.py", line 3, in f\nValueError\n  at com.x.Y.run(Y.java:12)\n    at go (app.js:5:1)'
    got = runtime.stack_frames(spark.createDataFrame([(1, text)], "id long, text string")).collect()
    assert [(r.trace, r.language, r.file, r.line, r.function) for r in got] == [(1, "python", "a.py", 3, "f"), (2, "jvm", "Y.java", 12, "run"), (2, "node", "app.js", 5, "go")]
    files = spark.createDataFrame([("src/a/b.py",), ("lib/b.py",), ("x/c.py",), ("y/c.py",)], "file string")
    frames = spark.createDataFrame([("/srv/src/a/b.py",), ("/z/c.py",)], "frame string")
    assert [tuple(r) for r in runtime.by_suffix(frames, files).collect()] == [("/srv/src/a/b.py", "src/a/b.py")]


def test_scan(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("x = 1")
    (root / "id_rsa").write_text("k=v")
    (root / "b.bin").write_bytes(b"a\0b")
    (root / "node_modules" / "m.js").write_text("1")
    assert {r.path: r.skip_reason for r in parsing.scan(spark, str(root)).collect()} == {"a.py": None, "id_rsa": "secret", "b.bin": "binary", "node_modules/m.js": "ignored"}


def test_predicates(spark):
    paths = ["src/a_test.py", "tests/x.py", "src/a.py", "web/a.spec.ts", "examples/x.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(predicates.is_test_path(F.col("p"))).collect()] == [True, False, False, False, False]  # no folder before tests/
    got = df.select("p", predicates.is_test_path_of_change(F.col("p")), predicates.is_production_path(F.col("p")), predicates.path_matches(F.col("p"), "*.py")).collect()
    assert [tuple(r)[1:] for r in got] == [(True, True, True), (True, False, True), (False, True, True), (True, True, False), (False, False, True)]
    with pytest.raises(ValueError):
        predicates.check_criteria([{"axis": "nope", "op": "eq", "value": 1}])
    with pytest.raises(ValueError):
        predicates.check_criteria([{"axis": "name", "op": "~", "value": 1}])
    row = df.limit(1).select(predicates.byte_overlap(F.lit(0), F.lit(10), F.lit(5), F.lit(25)), predicates.tags_match(F.array(F.lit("a"), F.lit("b")), ["a"], ["c"]), predicates.row_summary(F.lit("sig"), F.lit("sig"))).first()
    assert tuple(row) == (0.5, True, "")


def test_other_parsers():
    xml = code.symbols("a.xml", '<root a="1">\n<bean id="x"/>\n<script src="m.js"></script>\n</root>')
    assert [(s["name"], s["line"]) for s in xml] == [("root", 1), ("bean.x", 2), ("m.js", 3)]
    yaml = code.symbols("a.yaml", "top:\n  inner: 1\n  deep:\n    x: 2\nflat: 3\n")
    assert [(s["name"], s["kind"]) for s in yaml] == [("top", "type"), ("top.inner", "constant"), ("top.deep", "type"), ("flat", "constant")]
    vue = code.symbols("A.vue", '<template>\n<Card/><slot name="foot"/>\n</template>\n<script setup lang="ts">\nconst n = ref(1)\nfunction go() {}\n</script>')
    assert {(s["name"], s["line"]) for s in vue} == {("n", 5), ("go", 6), ("Card", 2), ("slot:foot", 2)}
    masked = code.mask_template("a {{ b }}\n{% if c %}d{# e #}")
    assert masked == "a " + " " * 7 + "\n" + " " * 10 + "d" + " " * 7 and code.mask_template("x<% y %>z", "erb") == "x       z"
    assert code.template_symbols("{% extends 'b.html' %}\n{% block main %}{% endblock %}\n{% macro m(x) %}") == [("extends", "b.html", 1), ("block", "main", 2), ("macro", "m", 3)]
    assert code.split_front_matter("---\na = 1\n---\n<p/>") == ("a = 1", "<p/>") and code.split_front_matter("<p/>") == ("", "<p/>")
    assert code.path_aliases('{// c\n"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./app/*"],}}}') == {"@/*": "src/app/*"} and code.path_aliases("no") == {}
    assert code.namespaces('{"autoload": {"psr-4": {"App\\\\": "src"}}}') == {"App\\": "src/"}
    schema = "models:\n  - name: orders\n    columns:\n      - name: id\n        description: 'the key'\n      - name: n\n"
    assert code.dbt_columns(schema) == [("orders", "id", "the key"), ("orders", "n", "")]


def test_index_of_a_folder(spark, tmp_path):
    from sextant.operators import indexing, storage

    root = tmp_path / "proj"
    for name, text in {"pkg/a.py": "from .b import g\ndef f(): return g()\n", "pkg/b.py": "def g(): return 1\n", "README.md": "# T\ntext\n", "tmp/x.py": "def x(): pass\n", "node_modules/m.js": "function m() {}\n", "yarn.lock": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    found = {r.path: r.skip_reason for r in indexing.folder(spark, str(root), ignore="tmp/\n").collect()}
    assert found["pkg/a.py"] is None and found["tmp/x.py"] == "ignored" and found["node_modules/m.js"] == "skipped_folder" and found["README.md"] == "unsupported"
    assert [r.path for r in indexing.explicit(spark, str(root), ["pkg/b.py", "../etc/x", "/etc/y", "none.py"]).collect()] == ["pkg/b.py"]
    out = indexing.index_content(spark, str(root), str(tmp_path / "index"), "r1")
    assert {(r.src, r.dst) for r in out["edges"].collect()} == {("pkg/a.py", "pkg/b.py")}
    assert {r.title for r in out["sections"].collect()} == {"T"}
    indexing.index_content(spark, str(root), str(tmp_path / "index"), "r2", "code")
    new = spark.createDataFrame([("pkg/b.py", "def g(): return 2\ndef h(): pass\n")], "path string, content string")
    indexing.index_file(new, str(tmp_path / "index"), "r1")
    names = lambda repo: {r.name for r in storage.load_index(spark, str(tmp_path / "index"), "symbols", repo).collect()}
    assert names("r1") == {"f", "g", "h", "x"} and names("r2") == {"f", "g", "x"}
    known, fresh = parsing.cached(new, storage.load_index(spark, str(tmp_path / "index"), "symbols", "r1").withColumn("content_hash", F.lit("other")))
    assert known.count() == 0 and {r.name for r in fresh.collect()} == {"g", "h"}
    storage.delete_index(spark, str(tmp_path / "index"), "r2", ["symbols"])
    assert names("r2") == set()
    storage.save_branch_delta(storage.branch_delta(spark.createDataFrame([("a", "1")], "file string, hash string"), spark.createDataFrame([("b", "2")], "file string, hash string")), str(tmp_path / "index"), "r1", "dev")
    assert {(r.file, r.action) for r in storage.load_index(spark, str(tmp_path / "index"), "deltas").where("branch = 'dev'").collect()} == {("a", "delete"), ("b", "add")}
    line = storage.encode_response({"n": 3, "ok": True, "s": "x", "f": 1.5, "none": None}, ["n", "ok", "s", "f", "none"])
    assert storage.decode_response(line) == {"n": 3, "ok": True, "s": "x", "f": 1.5, "none": None}
