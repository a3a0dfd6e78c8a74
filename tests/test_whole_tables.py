"""Registered queries whose SQL twin holds a cut: whole small tables, by brute force."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.sources import repository

LINES = [(s, (s * 7 + k * 13) % 40 + 1, order, k) for order in range(1, 61) for k, s in enumerate((order % 9 + 1, order % 4 + 1))]
LINES += [(2, 5, 61, 0), (7, 5, 61, 1), (2, 5, 62, 0), (4, 3, 62, 1), (11, 9, 62, 3)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Orders 1 to 62: none of them is a multiple of 400. Suppliers 1 to 12, parts 1 to 45; some are never ordered."""
    root = tmp_path_factory.mktemp("small")
    spark.createDataFrame(LINES, "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int").write.parquet(f"{root}/lineitem.parquet")
    spark.range(1, 13).withColumnRenamed("id", "s_suppkey").write.parquet(f"{root}/supplier.parquet")
    spark.range(1, 46).withColumnRenamed("id", "p_partkey").write.parquet(f"{root}/part.parquet")
    return str(root)


def test_graph_queries_read_every_order_line(spark, small):
    run = lambda name: registry.QUERIES[name](spark, small).collect()
    edges = {(f"supplier:{s}", f"part:{p}") for s, p, _, _ in LINES}
    nodes = {f"supplier:{k}" for k in range(1, 13)} | {f"part:{k}" for k in range(1, 46)}
    to_5 = {(s, p) for s, p in edges if p == "part:5"}
    assert to_5
    assert sorted(r.node for r in run("g02_impact_radius")) == sorted({"part:5"} | {s for s, _ in to_5})
    assert sorted((r.dst, r.src, r.kind) for r in run("g02_impact_edges")) == sorted((s, p, "import") for s, p in to_5)
    degree = {n: len({e for e in edges if n in e}) for n in nodes}
    assert {r.a: r.degree for r in run("g04_adjacency")} == {n: d for n, d in degree.items() if d}
    want = {(p, "out", 1) for s, p in edges if s == "supplier:3"} | {(s, "in", 1) for s, p in edges if p == "part:3"}
    got = [(r.node, r.direction, r.hops) for r in run("g05_neighbourhood")]
    assert sorted(got) == sorted(want - {("part:3", "out", 1), ("supplier:3", "in", 1)})
    alone = {n for n, d in degree.items() if not d}
    assert alone and sorted(r.node for r in run("g06_isolated")) == sorted(alone)
    reach = {n: 1 + len([e for e in edges if e[0] == n]) for n in nodes}
    assert {r.seed: (r.reached, r.difficulty) for r in run("l09_reach_sizes")} == {n: (k, min(5, k)) for n, k in reach.items()}


def test_usage_sum_reads_every_order(spark, small):
    want = {s: None for s, _, _, _ in LINES}
    for s, p, _, k in LINES:
        if k % 2 == 0:
            want[s] = (want[s] or 0) + p
    assert None in want.values()
    assert {r.l_suppkey: r.used for r in registry.QUERIES["a45_usage_sum"](spark, small).collect()} == want


WORDS = "tax law court fish river boat stone wall north wind".split()
TEXTS = {d: " ".join(WORDS[(d * k + k) % (3 + d % 8)] for k in range(d % 7 + 1)) for d in range(20)} | {20: "", 21: "rare Rare-unicorn"}
ASKED = {k: f"{WORDS[k % 10]} {WORDS[k * 3 % 10]}, {WORDS[k % 10]}" for k in range(12)} | {12: "unicorn", 13: "nowhere"}


def test_bm25_asks_every_item(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(ASKED.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {d: t.lower().replace("-", " ").split() for d, t in TEXTS.items()}
    words = {d: w for d, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    want = set()
    for item, text in ASKED.items():
        scores = {}
        for term in set(text.replace(",", " ").split()):
            df = sum(term in w for w in words.values())
            for d, w in words.items():
                if tf := w.count(term):
                    part = math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                    scores[d] = scores.get(d, 0) + part
        best = sorted((-round(x, 6), d) for d, x in scores.items())[:3]
        want |= {(item, d, rank, round(-x, 5)) for rank, (x, d) in enumerate(best, 1) if -x >= 1.2}
    got = {(r.item_id, r.doc_id, r.rank, round(r.score, 5)) for r in registry.QUERIES["t06_bm25_recall"](spark, str(tmp_path)).collect()}
    assert got == want and (12, 21) in {x[:2] for x in got} and len({x[0] for x in got}) > 5


def test_every_source_is_stamped(spark, tmp_path):
    docs = [(k, None if k % 11 == 0 else f"text {k % 5}", ("src1", "src3", None, "hot", "hot")[k % 5]) for k in range(200)] + [(900, None, "bare")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    stamp = lambda entries: f"content:{sha(';'.join(entries))[:24]}"
    want = {s: stamp(f"{d}:{sha(t)[:16]}" for d, t in sorted((str(d), t) for d, t, x in docs if x == s and t)) for s in ("src1", "src3", None, "hot")}
    assert {r.source: r.stamp for r in registry.QUERIES["a42_version_stamp"](spark, str(tmp_path)).collect()} == want | {"bare": None}
    files = spark.createDataFrame([("b", "2"), ("a", "1"), ("a!", "3")], "path string, content_hash string")
    assert [r.stamp for r in repository.fingerprint(files).collect()] == [stamp(["a!:3", "a:1", "b:2"])]
    assert [r.stamp for r in repository.fingerprint(files.limit(0)).collect()] == [stamp([])]


def test_bm25_of_repeated_keys(spark, tmp_path):
    """Rows of one doc_id: alike they are one document with doubled counts, of other lengths documents of their own, summed."""
    rows = [(1, "tax law tax"), (1, "tax law tax"), (2, "tax"), (2, "law court tax"), (3, "boat"), (4, None), (None, "river")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "tax, law"), (8, "river boat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = {(*x[:2], round(x[2], 5), x[3]) for x in db.sql(registry.ORACLES["t06_bm25_recall"]).fetchall()}
    got = {(r.item_id, r.doc_id, round(r.score, 5), r.rank) for r in registry.QUERIES["t06_bm25_recall"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 2
