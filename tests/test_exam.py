"""Landings, theme judgement, block ranks, notes and the bank: goldens."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import code, exam

TEXTS = {
    "src/Order.java": ["class OrderService {", "  void place(int n) {", "    if (n > 0) retry(load(n));", "  }", "}", "// Retry here"],
    "src/b.py": ["def load(n):", "    lock(n)", "x = 1"],
    "src/c.py": ["unlock [("],
}
SYMBOLS = [("src/Order.java", "OrderService", 1), ("src/Order.java", "place", 2), ("src/b.py", "load", 1), ("src/b.py", "Load", 5)]


def tables(spark):
    lines = spark.createDataFrame([(p, k, x) for p, t in TEXTS.items() for k, x in enumerate(t, 1)], "path string, line int, content string")
    return spark.createDataFrame(SYMBOLS, "path string, name string, line int"), lines


def land(spark, probes):
    s, lines = tables(spark)
    points = spark.createDataFrame(list(probes.items()), "point string, probes string")
    return {(r.point, r.path, r.line, r.symbol, r.signal) for r in exam.landings(points, s, lines, code.signal(lines)).collect()}


def test_landings(spark):
    got = land(spark, {"a": "sym:orderservice", "b": "sym:Nothing:place & text:retry", "c": "text:RETRY\\(; text:retry", "d": "call:x; op:y", "e": "text:unlock [(", "f": "sym:load & call:any", "g": "text:load & sym:place; sym:load & text:nowhere"})
    order, b = "src/Order.java", "src/b.py"
    assert got == {
        ("a", order, 1, "OrderService", 0), ("b", order, 2, "place", 0), ("c", order, 3, None, 5), ("e", "src/c.py", 1, None, 0), ("f", b, 1, "load", 0), ("g", order, 3, "place", 5),
    }
    assert land(spark, {}) == set()


def test_judge(spark):
    s, lines = tables(spark)
    points = spark.createDataFrame([("p1", "locks", "sym:mutex"), ("p2", "retries", "text:retry"), ("p3", "orders", "sym:OrderService"), ("p4", "grey", "text:x")], "point string, concept string, probes string")
    tiers = spark.createDataFrame([("p1", "enabled"), ("p2", "enabled"), ("p4", "grey")], "point string, tier string")
    concepts = {"locks": ["lock", "mutex"], "retries": ["retry"], "orders": ["order"], "grey": []}
    level, found = exam.judge("Retry", concepts, points, tiers, s, lines, code.signal(lines))
    assert level == 1 and [(r.point, r.path, r.line) for r in found.collect()] == [("p2", "src/Order.java", 3)]
    level, found = exam.judge("LOCK", concepts, points, tiers, s, lines, code.signal(lines))
    assert level == 2 and {(r.point, r.path, r.line) for r in found.collect()} == {("kw:lock", "src/b.py", 2), ("kw:lock", "src/c.py", 1)}
    level, found = exam.judge("weather", concepts, points, tiers, s, lines)
    assert level == 0 and [r.concept for r in found.collect()] == ["locks", "retries"]


def test_block_ranks(spark):
    blocks = spark.createDataFrame([("a", 1, 2, "alpha beta"), ("b", 1, 9, "ALPHA"), ("c", 1, 1, "alpha"), ("d", 4, 3, "none")], "path string, start int, declared int, body string")
    clues = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "clue string")
    got = {r.path: (r.matched, round(r.score, 6)) for r in exam.block_ranks(blocks, clues).collect()}
    assert got == {"a": (2, 1.52), "b": (1, 0.53)}


def test_block_ranks_read_a_body_once(spark):
    read = spark.sparkContext.accumulator(0)

    def body(k):
        read.add(1)
        return None if k == 3 else f"Straße {k} of ΣΊΣΥΦΟΣ" if k % 2 else f"x{k} OF 𝒜{k}"

    blocks = spark.range(8).select(F.col("id").cast("string").alias("path"), F.lit(1).alias("start"), F.lit(2).alias("declared"), F.udf(body)("id").alias("body"))
    clues = spark.createDataFrame([("straße",), ("of",), ("𝒜6",), (None,), ("of",), ("x2 of",), ("nowhere at all in any of these",)], "clue string")
    got = {r.path: (r.matched, round(r.score, 6)) for r in exam.block_ranks(blocks, clues).collect()}
    assert got == {k: (n, round(s + 1 / 7 + 0.02, 6)) for k, n, s in [("0", 1, 0), ("1", 2, 1 / 3), ("2", 2, 1), ("4", 1, 0), ("5", 2, 1 / 3), ("6", 2, 1), ("7", 2, 1 / 3)]}
    assert read.value == 8
    assert exam.block_ranks(blocks, clues.limit(0)).count() == 0


def test_notes_and_bank(spark):
    kind = "file string, hash string, ord long, point string, line int, level int"
    old = spark.createDataFrame([("f", "h1", 1, "p", 1, 0), ("f", "h1", 2, "q", 1, 2), ("g", "h0", 1, "p", 1, 1), ("z", "h", 1, "p", 1, 1)], kind)
    new = spark.createDataFrame([("f", "h1", 1, "p", 1, 2), ("f", "h1", 2, "q", 1, 1), ("f", "h1", 3, "q", 2, 0), ("g", "h9", 1, "r", 5, 1), ("g", "h9", 2, "r", 5, 0)], kind)
    got = {(r.file, r.hash, r.point, r.line, r.level) for r in exam.merge_notes(old, new).collect()}
    assert got == {("f", "h1", "p", 1, 2), ("f", "h1", "q", 1, 1), ("f", "h1", "q", 2, 0), ("g", "h9", "r", 5, 1)}
    many = spark.createDataFrame([("f", "h", k, f"p{k % 15}", k, 1) for k in range(40)], kind)
    kept = {(r.point, r.line) for r in exam.merge_notes(old.limit(0), many).collect()}
    assert kept == {(f"p{k}", 30 + k if k < 10 else 15 + k) for k in range(3, 15)}
    stored = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("b", 9, 1), ("c", 3, 1), ("d", 4, 1)], "exercise string, created int, at int")
    due = spark.createDataFrame([("c", "2026-02"), ("d", "2026-01"), ("x", "2026-01")], "exercise string, due string")
    assert [(r.exercise, r.created) for r in exam.bank(stored, due).orderBy("place").collect()] == [("d", 4), ("c", 3), ("b", 9), ("a", 5)]
