"""Operators on small tables with literal expectations, and registered queries against DuckDB."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import learning as L
from lodestone.functions import text as T
from lodestone.operators import code, evals, extract, graph, joins, learner, search, tables, usage
from lodestone.plans import registry
from lodestone.sources import logs, repository
from lodestone.streaming import journal as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return v.isoformat()[:26] if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "want"),
    [("/a/{id}/", "/a/{*}"), ("a//b?x=1", "/a/b"), ("/u/:name/p", "/u/{*}/p"), ("/v/<int:k>#t", "/v/{*}"), ("/", "/"), ("/x/${y}", "/x/{*}")],
)
def test_routes(spark, path, want):
    assert one(spark, T.normalize_route(F.lit(path))) == want


def test_text_functions(spark):
    assert one(spark, T.words_of(F.lit("parseHTTPRequest2Go_now"))) == ["parse", "httprequest2", "go", "now"]
    assert one(spark, T.segment_for_lookup(F.lit("查询函数 abc"))) == "查询 询函 函数 abc"
    assert one(spark, T.theme_tokens(F.lit("User/Order x"))) == ["user/order x", "user", "order"]
    assert one(spark, T.token_hits(F.lit("ord"), F.lit("placeOrder"))) is True
    assert one(spark, T.token_hits(F.lit("rde"), F.lit("placeOrder"))) is False
    assert one(spark, T.package_identity(F.lit("java"), F.lit("org.spring.web.bind.X"))) == "org.spring.web.bind"
    assert one(spark, T.package_identity(F.lit("go"), F.lit("github.com/a/b/c"))) == "github.com/a/b"
    assert one(spark, T.package_identity(F.lit("typescript"), F.lit("@scope/pkg/x"))) == "@scope/pkg"
    assert one(spark, T.is_test_path(F.lit("src/tests/a.py"))) and not one(spark, T.is_test_path(F.lit("src/attest.py")))


def journal(spark):
    at = datetime(2026, 11, 3)
    rows = [
        ("1", "token_usage", at, {"scene": "teach", "input_tokens": "900", "output_tokens": "100", "cache_hit_tokens": "400"}),
        ("2", "token_usage", at, {"scene": "map_chat", "input_tokens": "200", "output_tokens": "50", "cache_hit_tokens": "0"}),
        ("3", "token_usage", at, {"scene": "teach", "input_tokens": "0", "output_tokens": "0", "mode": "degraded"}),
        ("4", "token_usage", at - timedelta(days=30), {"scene": "teach", "input_tokens": "7"}),
    ]
    return spark.createDataFrame([(i, t, a, "r", None, None, p) for i, t, a, p in rows], "id string, type string, at timestamp, repository_id string, session_id string, trace_id string, payload map<string,string>")


def test_cost_golden(spark):
    used = usage.token_usage(journal(spark))
    now = F.lit(datetime(2026, 11, 20))
    assert usage.monthly_cost(used, now).first().asDict() == {"turns": 3, "input_tokens": 1100, "cache_hit_tokens": 400, "billed_tokens": 700, "output_tokens": 150, "degraded": 1}
    by = {r.scene: (r.turns, r.input_tokens, r.output_tokens) for r in usage.monthly_cost(used, now, ["scene"]).collect()}
    assert by == {"teach": (2, 900, 100), "map_chat": (1, 200, 50)}
    assert one(spark, usage.price(F.lit(400_000), F.lit(600_000), F.lit(100_000), 0.3, 0.03, 0.6)) == pytest.approx(0.198)


def results(spark, rows):
    at = datetime(2026, 1, 1)
    data = [(k, at + timedelta(hours=k), e, "u", kind, mode[0] if mode else None, mode[1] if mode[1:] else None, ok, 1.0) for k, (e, kind, ok, *mode) in enumerate(rows)]
    return learner.with_attempt_kind(
        spark.createDataFrame(data, "ord int, at timestamp, exercise string, unit string, kind string, grading_mode string, attempt_kind string, passed boolean, score double")
    )


@pytest.mark.parametrize(
    ("kind", "mode", "want"),
    [("trace", "execution", 1.0), ("trace", "set_match", 0.8), ("trace", "rubric", 0.5), ("llm_rubric", None, 0.5), ("patch_edit", None, 1.0), ("author_function", "?", 1.0), ("trace", None, 0.8), (None, None, 0.8)],
)
def test_mastery_golden(spark, kind, mode, want):
    assert learner.mastery(results(spark, [("e", kind, True, mode)])).first().score == pytest.approx(want)
    assert learner.mastery(results(spark, [("e", kind, False, mode)])).first().score == 0.0


def test_mastery_sequence(spark):
    steps = [(True, None), (False, None), (True, None), (True, "review"), (False, "review"), (False, "review"), (True, None)]
    rows = [("e", "patch_edit", ok, None, attempt) for ok, attempt in steps]
    got = learner.mastery(results(spark, rows)).first()
    # 1, 0.4, 1.4, 1.9, 0.9, 0 (held), 1
    assert (got.score, got.level, got.attempts, got.successes, got.confidence) == (pytest.approx(1.0), 1, 7, 4, 1.0)


def test_mastery_of_a_long_history(spark):
    """One unit's answers over many ranges, folded apart and composed."""
    import random

    r = random.Random(1)
    rows = [(f"e{k % 7}", r.choice(["patch_edit", "trace", "llm_rubric"]), r.random() < 0.6, None, r.choice([None, "review"])) for k in range(3000)]
    weight, score = {"patch_edit": 1.0, "trace": 0.8, "llm_rubric": 0.5}, 0.0
    for _, kind, ok, _, attempt in rows:
        step = (0.5 if ok else -1.0) if attempt else (1.0 if ok else -0.6)
        score = min(5.0, max(0.0, score + weight[kind] * step))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert learner.mastery(results(spark, rows)).first().score == pytest.approx(score)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("score", "quality"), [(0.0, 0), (0.01, 1), (0.4, 2), (0.6, 3), (0.8, 4), (0.95, 5)])
def test_quality_golden(spark, score, quality):
    assert one(spark, L.quality_for_score(F.lit(score))) == quality


@pytest.mark.parametrize(
    ("path", "want"),
    [("a/testing/x.py", True), ("fixtures/x.json", True), ("src/conftest.py", True), ("src/test_a.py", True), ("a_test.go", True), ("x.spec.mts", True), ("FooTest.java", False), ("tests.py", False), ("src/contest.py", False)],
)
def test_test_paths(spark, path, want):
    from lodestone.functions import text as T

    assert one(spark, T.is_test_path(F.lit(path))) is want


def test_sm2_golden(spark):
    q = lambda *qs: one(spark, L.sm2_fold(F.array(*[F.lit(float(x)) for x in qs])))
    assert (q(5).repetitions, q(5).interval, round(q(5).easiness, 6)) == (1, 1, 2.6)
    assert (q(5, 5).repetitions, q(5, 5).interval) == (2, 6)
    assert (q(5, 5, 1).repetitions, q(5, 5, 1).interval) == (0, 1)


def test_faded_golden(spark):
    passed = learner.faded_support(results(spark, [("e", "execution", True)] * 2), "unit").first()
    assert (passed.sample, passed.hint) == (0, 3)
    failed = learner.faded_support(results(spark, [("e", "execution", True)] * 2 + [("e", "execution", False)]), "unit").first()
    assert (failed.sample, failed.hint) == (1, 3)


def test_graph(spark):
    imports = spark.createDataFrame([("src/main.js", "src/config.js"), ("src/main.js", "src/presenter.js")], "src string, dst string")
    calls = spark.createDataFrame([], "src string, dst string")
    nodes, edges = graph.impact_radius(imports, calls, spark.createDataFrame([("src/config.js",)], "node string"))
    assert {r.node for r in nodes.collect()} == {"src/config.js", "src/main.js"}
    assert [(r.dst, r.src, r.kind) for r in edges.collect()] == [("src/main.js", "src/config.js", "import")]
    chain = spark.createDataFrame([(k, k + 1 if k < 20 else None) for k in range(21)] + [(30, 31), (31, 30)], "id long, next long")
    ends = {r.id: r.target for r in graph.resolve_chain(chain).collect()}
    assert all(ends[k] == 20 for k in range(21)) and ends[30] == ends[31] == 30


def test_joins(spark):
    left = spark.createDataFrame([("org.spring.web.X",), ("java.util.List",), ("none",), ("org.spring",)], "name string")
    right = spark.createDataFrame([("org.spring", "framework"), ("org.spring.web", "web"), ("java", "std")], "prefix string, category string")
    got = {r.name: r.category for r in joins.longest_prefix_join(left, "name", right, "prefix").collect()}
    assert got == {"org.spring.web.X": "web", "java.util.List": "std", "none": None, "org.spring": "framework"}
    spans = spark.createDataFrame([("f", 1, 500, "outer"), ("f", 100, 120, "inner"), ("g", 1, 5, "g")], "path string, start int, end int, symbol string")
    points = spark.createDataFrame([("f", 110), ("f", 200), ("g", 9), ("f", 500)], "path string, line int")
    got = [(r.path, r.line, r.symbol) for r in joins.containing_interval(points, spans, ["path"], "line", "start", "end").collect()]
    assert sorted(got, key=str) == sorted([("f", 110, "inner"), ("f", 200, "outer"), ("g", 9, None), ("f", 500, "outer")], key=str)
    paths = spark.createDataFrame([("a/b/c.h",), ("x/c.h",)], "path string")
    specs = spark.createDataFrame([("c.h",), ("b/c.h",), ("/c.h",)], "spec string")
    assert {(r.spec, r.path) for r in joins.suffix_join(paths, "path", specs, "spec").collect()} == {("c.h", "a/b/c.h"), ("c.h", "x/c.h"), ("b/c.h", "a/b/c.h")}


def test_tables(spark):
    old = spark.createDataFrame([("a", 1, "x", None), ("b", 1, "y", 5)], "id string, ord int, s string, n int")
    new = spark.createDataFrame([("a", 2, 7)], "id string, ord int, n int")
    assert {r.id: (r.s, r.n) for r in tables.upsert(old, new, ["id"], "ord").collect()} == {"a": ("x", 7), "b": ("y", 5)}
    gone = spark.createDataFrame([("a",), (None,)], "id string")
    assert [r.id for r in tables.without(old, gone, ["id"]).collect()] == ["b"]
    assert tables.schema_gaps(old, new) == [("s", "string")]


def test_bm25_and_evals(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, [])], "d long, t array<string>")
    asked = spark.createDataFrame([(9, ["a", "c", "c"])], "q long, t array<string>")
    got = {r.d: r.score for r in search.bm25(docs, "d", F.col("t"), asked, "q", F.col("t")).collect()}
    idf = lambda df: math.log(1 + (2 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2.5))
    assert got == {1: pytest.approx(idf(2) * part(1, 2)), 2: pytest.approx(idf(2) * part(2, 3) + idf(1) * part(1, 3))}
    cases = spark.createDataFrame([("p", ["x", "y"]), ("q", ["z"]), ("n", [])], "id string, gold array<string>")
    hits = spark.createDataFrame([("p", 1, "x"), ("p", 9, "y"), ("n", 1, "x")], "id string, rank int, path string")
    assert evals.retrieval_score(cases, hits, 5).first().asDict() == {"positives": 2, "hit": 1, "recall": 0.25, "negatives": 1, "negatives_hit": 1}


def test_extraction(spark):
    py = "import os\nfrom a.b import c\n\nclass K:\n    def run(self):\n        return go(1)\n"
    assert one(spark, extract.imports_of(F.lit(py), "python")) == ["os", "a.b"]
    assert one(spark, extract.imports_of(F.lit("import x from './a'; const y = require(\"b\")"), "typescript")) == ["./a", "b"]
    lines = extract.lines(spark.createDataFrame([("f.py", py)], "path string, text string"), "path", "text")
    assert [(r.line, r.kind, r.name) for r in code.symbols(lines).orderBy("line").collect()] == [(4, "class", "K"), (5, "function", "run")]
    assert [(r.line, r.name) for r in code.call_sites(lines).collect()] == [(6, "go")]


def test_symbol_ends(spark):
    files = {
        "a.py": "def f(a):\n    x = 1\n\n    return x\nclass C:\n    def g(self):\n        pass\n\n\ny = 2\n",
        "b.ts": "export class A {\n  run() {\n  }\n}\nexport async function f(x) {\n  if (x) {\n  }\n}\nconst g = async (y) => y\nfunction h()\n{\n}\n",
    }
    lines = extract.lines(spark.createDataFrame(list(files.items()), "path string, text string"), "path", "text")
    got = [(r.path, r.name, r.line, r.end) for r in code.symbols(lines).orderBy("path", "line").collect()]
    assert got == [("a.py", "f", 1, 4), ("a.py", "C", 5, 9), ("a.py", "g", 6, 9), ("b.ts", "A", 1, 4), ("b.ts", "f", 5, 8), ("b.ts", "g", 9, 9), ("b.ts", "h", 10, 10)]


def test_call_edges(spark):
    lines = extract.lines(
        spark.createDataFrame([("a.py", "from b import f\ndef g():\n    f(1)\n    g()\n    obj.k(2) if h(3) else 0\n"), ("b.py", "def f():\n    pass\ndef k():\n    pass\n"), ("c.py", "def h():\n    pass\n")], "path string, text string"),
        "path", "text",
    )
    imports = code.resolve_first(code.python_imports(lines), code.module_candidates(F.col("specifier")), lines).where("target IS NOT NULL")
    edges = code.call_edges(code.call_sites(lines), code.symbols(lines), imports.select(F.col("path").alias("src"), F.col("target").alias("dst")))
    assert sorted((r.line, r.name, r.caller, r.callee_path, r.callee_line) for r in edges.collect()) == [(3, "f", "g", "b.py", 1), (4, "g", "g", "a.py", 2), (5, "k", "g", "b.py", 3)]


def test_script_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/lib/index.ts", "src/b.tsx", "src/c.js", "x.ts")], "path string")
    specs = [("src/a.ts", "./b.jsx", "src/b.tsx"), ("src/a.ts", "./lib", "src/lib/index.ts"), ("src/a.ts", "./c", "src/c.js"), ("src/lib/index.ts", "../a.js", "src/a.ts"), ("x.ts", "./src/none", None), ("src/a.ts", "../x", "x.ts")]
    asked = spark.createDataFrame([s[:2] for s in specs], "path string, specifier string")
    got = code.resolve_first(asked, code.script_candidates(F.col("path"), F.col("specifier")), files)
    assert {(r.path, r.specifier): r.target for r in got.collect()} == {s[:2]: s[2] for s in specs}


def test_java_and_csharp(spark):
    java = 'package org.acme;\nimport static a.B.c;\nimport x.y.*;\n/* f(\n g( */ int k; // h(\nString s = "// no";\n'
    assert [tuple(x) for x in one(spark, extract.java_imports(F.lit(java)))] == [("a.B.c", False), ("x.y", True)]
    assert one(spark, extract.java_type(F.lit("src/T.java"), F.lit(java))) == "org.acme.T"
    clean = one(spark, extract.without_comments(F.lit(java)))
    assert len(clean) == len(java) and clean.count("\n") == java.count("\n") and "f(" not in clean and "h(" not in clean and '"// no"' in clean and "int k;" in clean
    assert one(spark, extract.csharp_namespaces(F.lit("using A;\nnamespace X.Y\n{\n}\nnamespace Z;\n"))) == ["X.Y", "Z"]
    assert one(spark, extract.imports_of(F.lit("import a, b.c as d\nfrom . import x\n"), "python")) == ["a", "b.c", "."]


def test_route_declarations(spark):
    files = {
        "api.py": 'bp = Blueprint("x", url_prefix="/v1")\n@bp.route("/users/<int:id>")\ndef u(): pass\n@router.get("items")\n',
        "C.java": '@RestController\n@RequestMapping("/shop")\npublic class C {\n  @GetMapping(value = "/{id}")\n  @PostMapping({"/a", "/b/"})\n  @GetMapping("/{x}")\n}\n',
        "w.ts": 'fetch("/v1/users/1?x=2"); axios.get(`/shop/${id}`); fetch("/one"); url: "//cdn/x/y"\n',
    }
    lines = extract.lines(spark.createDataFrame(list(files.items()), "path string, text string"), "path", "text")
    of = lambda p: lines.where(F.col("path") == p)
    assert sorted((r.line, r.route, r.framework) for r in extract.python_routes(of("api.py")).collect()) == [(2, "/v1/users/{*}", "flask"), (4, "/v1/items", "fastapi")]
    assert sorted((r.line, r.route) for r in extract.spring_routes(of("C.java")).collect()) == [(4, "/shop/{*}"), (5, "/shop/a"), (5, "/shop/b")]
    assert sorted((r.route, r.raw) for r in extract.route_requests(of("w.ts")).collect()) == [("/shop/{*}", "/shop/${id}"), ("/v1/users/1", "/v1/users/1?x=2")]


def test_journal_to_cost(spark, tmp_path):
    """From the lines of a file to the month's cost, with a broken line and an unfinished one."""
    rows = ['{"id": "1", "type": "token_usage", "at": "2026-11-03T10:00:00Z", "repositoryId": "r", "sessionId": "s", "payload": {"scene": "teach", "input_tokens": "100", "output_tokens": "7", "cache_hit_tokens": "30"}}', "{broken", '{"id": "2", "type": "token_us']
    (tmp_path / "journal.jsonl").write_text("\n".join(rows))
    journal = logs.read_journal(spark, str(tmp_path / "journal.jsonl"))
    got = usage.monthly_cost(usage.token_usage(journal), F.lit(datetime(2026, 11, 20)), ["scene", "session_id"]).collect()
    assert [(r.scene, r.session_id, r.turns, r.input_tokens, r.cache_hit_tokens, r.billed_tokens, r.output_tokens) for r in got] == [("teach", "s", 1, 100, 30, 70, 7)]
    logs.append_events(journal, str(tmp_path / "out"), ["token_usage"])
    assert [(r.id, r.session_id) for r in logs.read_journal(spark, str(tmp_path / "out")).collect()] == [("1", "s")]


def test_containing_interval_of_long_spans(spark):
    import random

    r = random.Random(2)
    spans = [(k % 3, s, s + r.choice([0, 3, 70, 5000, 90_000])) for k in range(200) for s in [r.randrange(0, 100_000)]]
    points = [(r.randrange(3), r.randrange(0, 120_000)) for _ in range(300)]
    got = joins.containing_interval(spark.createDataFrame(points, "f int, at long"), spark.createDataFrame(spans, "f int, start long, end long"), ["f"], "at", "start", "end")
    want = []
    for f, at in points:
        held = sorted((e - s, -s) for g, s, e in spans if g == f and s <= at <= e)
        want.append((f, at, -held[0][1] if held else None))
    assert sorted(((r.f, r.at, r.start) for r in got.collect()), key=str) == sorted(want, key=str)


def test_sources(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("x = 1\n")
    (root / "server.pem").write_text("k")
    (tmp_path / "env.txt").write_text("# c\nexport KEY='v'\nKEY=w\n")
    files = repository.scan(spark, str(root))
    rows = {r.path: r for r in files.withColumn("ok", repository.ingested(F.col("path"))).collect()}
    assert rows["src/a.py"].ok and rows["src/a.py"].lines == 2 and not rows["server.pem"].ok
    assert one(spark, repository.denied(F.lit("k/server.pem"))) == "key" and one(spark, repository.denied(F.lit(".env.example"))) is None
    rules = ["build/", "*.log", "!keep.log", "# note"]
    for path, want in {"build/x.js": True, "a/build/y/z.py": True, "a.log": True, "d/keep.log": False, "builder.py": False}.items():
        assert one(spark, repository.ignored(F.lit(path), rules)) is want
    assert [(r.key, r.value) for r in logs.read_env(spark, str(tmp_path / "env.txt")).collect()] == [("KEY", "w")]
    doc = tmp_path / "t.md"
    doc.write_text("# One\n| a | b |\n|---|---|\n| 1 | 2 |\n# Two\n| z |\n")
    assert [r.cells for r in logs.markdown_table(spark, str(doc), "One").orderBy("pos").collect()] == [["a", "b"], ["1", "2"]]
    log = tmp_path / "j.jsonl"
    log.write_text('{"id":"1","type":"x","at":"2026-01-01T00:00:00Z","payload":{"a":"1"}}\nbad\n{"id":"2","ty')
    assert [r.id for r in logs.read_journal(spark, str(log)).collect()] == ["1"]


def test_streaming_contributions(spark, tmp_path):
    folder, event = tmp_path / "journal", '{"id":"%s","type":"exercise_result","at":"2026-01-0%sT00:00:00Z","repositoryId":"r","payload":{"exercise_id":"e","score":"%s","passed":"true"}}\n'
    folder.mkdir()
    (folder / "1.json").write_text(event % ("a", 1, "1.0") + event % ("a", 1, "1.0") + "bad line\n" + event % ("b", 2, "1.0"))
    stream = streams.review_state(streams.contributions(streams.read_stream(spark, str(folder))))
    run = stream.writeStream.format("memory").queryName("reviews").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = spark.sql("SELECT * FROM reviews").collect()
    assert [(r.exercise_id, r.repetitions, r.interval) for r in rows] == [("e", 2, 6)]


def test_containing_interval_asks_each_place_once(spark):
    """Uses of one place share an answer, found without ordering all pairs; nulls are met by nothing."""
    spans = [(f, s, s + n) for f in (1, 2) for s in range(0, 90, 7) for n in (3, 40, 200)] + [(None, 0, 99)]
    points = [(k, f, at) for k, (f, at) in enumerate([(1, 50), (1, 50), (2, 89), (2, 300), (3, 5), (None, 5), (1, None)] * 5)]
    got = joins.containing_interval(spark.createDataFrame(points, "k int, f int, at long"), spark.createDataFrame(spans, "f int, start long, end long"), ["f"], "at", "start", "end")
    assert got.columns == ["k", "f", "at", "start", "end"]

    def best(f, at):
        held = [(e - s, -s, s, e) for g, s, e in spans if None not in (f, at) and g == f and s <= at <= e]
        return min(held)[2:] if held else (None, None)

    assert {r.k: (r.start, r.end) for r in got.collect()} == {k: best(f, at) for k, f, at in points}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lines_come_with_their_symbols(spark):
    """Each line's caller is the same from one reading as from two: rows that come twice, blank lines, bodies without an end or longer than allowed."""
    python = ["def a():", "", "    x = 1", "    def b():", "        return 1", "x = 2", "", "class C:", "    pass", ""]
    script = ["function f() {", "  g(1);", "}", "const h = (x) =>", "  x + 1", "function far() {", *["  y();"] * 6, "}", "function open() {", "  z();"]
    rows = [(p, k, t) for p, text in (("m.py", python), ("s.ts", script), ("none.py", [""])) for k, t in enumerate(text, 1)]
    rows += [("m.py", 5, "        return 1"), ("m.py", 4, "    def b():"), ("s.ts", 2, "  g(1);")]
    lines = spark.createDataFrame(rows, "path string, line int, content string").repartition(3)
    once = code.enclosing(None, code.symbols(lines, most=5, with_lines=True))
    twice = code.enclosing(lines.select("path", "line"), code.symbols(lines, most=5))
    assert once.dtypes == twice.dtypes
    got = sorted(map(tuple, once.collect()), key=str)
    assert got == sorted(map(tuple, twice.collect()), key=str) and len(got) == len(rows)
    assert {x for x in got if x[0] == "m.py"} == {("m.py", k, c) for k, c in enumerate(["a", "a", "a", "b", "b", None, None, "C", "C", "C"], 1)}


def test_lines_are_read_once_for_their_symbols(spark):
    """One scan, and each line dealt once for the symbols and once, with their spans, for the callers."""
    plan = registry.QUERIES["j09_enclosing_symbols"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(path") == 2


REACH = [("a", "b"), ("a", "b"), ("a", None), ("b", None), ("b", "c"), (None, "a"), ("c", "c"), ("c", "b"), ("d", "e")]


@pytest.mark.parametrize("seeds", ["abcde", "a", "ad", "x", "", ["a", "a", None], ["e", None]])
def test_reachable_of_odd_edges(spark, seeds):
    """Loops, cycles, repeated edges and seeds. A null is reached, once each time it is met anew, and leads nowhere."""
    edges = spark.createDataFrame(REACH, "src string, dst string")
    out = {}
    for s, d in dict.fromkeys(REACH):
        out.setdefault(s, []).append(d)
    want = []
    for seed in dict.fromkeys(seeds):
        seen, frontier = [seed], [seed]
        while frontier:
            step = dict.fromkeys(d for n in frontier if n is not None for d in out.get(n, ()))
            frontier = [d for d in step if d is None or d not in seen]
            seen += frontier
        want += [(seed, n) for n in seen]
    got = graph.reachable(edges, spark.createDataFrame([(s,) for s in seeds], "node string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_first_hops_are_the_edges(spark, monkeypatch):
    """With every source a seed no pair is joined where nothing leads on; with few seeds one join finds their edges."""
    plans = []
    monkeypatch.setattr(graph, "settle", lambda df, f=graph.settle: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    edges = spark.createDataFrame([(f"s{k % 5}", f"p{k % 7}") for k in range(40)], "src string, dst string")
    assert graph.reachable(edges, edges.selectExpr("explode(array(src, dst)) AS node")).count() == 12 + 35
    assert not any("Join" in p for p in plans)
    plans.clear()
    assert graph.reachable(edges, spark.createDataFrame([("s1",)], "node string")).count() == 8
    assert sum(p.count("Join") for p in plans) == 1
