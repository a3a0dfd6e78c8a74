"""The search door: scores, overlaps, the second asking and the budget."""

from __future__ import annotations

from lodestone.operators import door

SYMBOLS = [("src/seckill/VoucherListener.java", "onMessage", 9), ("src/seckill/VoucherListener.java", "handleVoucher", 12), ("src/seckill/VoucherListener.java", "onMessage", 20), ("src/test/SeckillTest.java", "testVoucher", 3), ("src/order.py", "load", 1)]
SUMMARIES = [("src/seckill/VoucherListener.java", "秒杀订单监听"), ("src/order.py", "订单服务 " + "x" * 200), ("src/empty.py", None)]
FILES = [("src/seckill/VoucherListener.java", 40), ("src/test/SeckillTest.java", None), ("src/empty.py", 3)]


def corpus(spark, more=()):
    s = spark.createDataFrame(SYMBOLS + list(more), "path string, name string, line int")
    return door.build_corpus(spark.createDataFrame(FILES, "path string, lines int"), s, spark.createDataFrame(SUMMARIES, "path string, summary string"))


def ask(spark, c, *texts, limit=10):
    q = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return door.search(c, q, "id", "text", limit)


def test_corpus(spark):
    rows = {r.path: r for r in corpus(spark).collect()}
    assert rows["src/seckill/VoucherListener.java"].names == ["onMessage", "handleVoucher"] and len(rows["src/seckill/VoucherListener.java"].units) == 3
    assert len(rows["src/order.py"].summary) == 161 and rows["src/order.py"].lines is None and rows["src/empty.py"].names == []


def test_scores(spark):
    got = {(r.query, r.path.rsplit("/", 1)[-1]): (r.score, r.faces, [u.name for u in r.near]) for r in ask(spark, corpus(spark), "voucher", "seckill voucher", "load", "oa", None, "  ").collect()}
    # `voucher` has seven letters: it matches anywhere; tests score 1 at most
    assert got[0, "VoucherListener.java"] == (6, ["path", "symbols"], ["handleVoucher"]) and got[0, "SeckillTest.java"] == (1, ["symbols"], ["testVoucher"])
    assert got[1, "VoucherListener.java"][0] == 9 and got[2, "order.py"] == (3, ["symbols"], ["load"]) and not any(q in (3, 4, 5) for q, _ in got)


def test_second_asking(spark):
    more = [(f"src/m{k}.py", "run", 1) for k in range(40)]
    rows = ask(spark, corpus(spark, more), "订单监听器", "订单服务", "单监").collect()
    assert {(r.query, r.segmented, r.path) for r in rows} == {(0, True, "src/seckill/VoucherListener.java"), (1, False, "src/order.py"), (2, False, "src/seckill/VoucherListener.java")}


def test_budget(spark):
    more = [(f"src/voucher/m{k:02}.py", f"name{k}_{'y' * 60}_{j}", j) for k in range(15) for j in range(8)]
    found = door.shown(ask(spark, corpus(spark, more), "voucher", limit=99))
    blocks = [r.block for r in found.orderBy("rank").collect()]
    assert 1 < len(blocks) < 15 and sum(map(len, blocks)) <= 2000 and "…共 8 个符号" in blocks[1] + blocks[-1]
    assert ask(spark, corpus(spark), " ").count() == 0
