"""Ropes and fill-in-the-middle documents against plain string work."""

from __future__ import annotations

import hashlib
import random
import re

from lodestone.llm import fill_middle as fm
from tests.llm.helpers import frame, prose


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def cases():
    docs = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "x"), (4, "has <S> inside"), (5, "<<P"), (6, "S><M"), (7, "😀é\u0000퟿" * 9)]
    docs += [(8, "same"), (8, "same"), (8, "other"), (9, prose(9, 200_000)), (10, "<P" * 5_000)]
    return docs + [(100 + k, prose(k, k % 40) + "<" * (k % 5)) for k in range(300)]


def test_query_rows(spark, tmp_path):
    frame(spark, cases()).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = fm.op12_fill_in_middle(spark, str(tmp_path)).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got) == order(plain(d, t) for d, t in cases())
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert fm.op12_fill_in_middle(spark, str(tmp_path)).count() == 0


def test_rope_splits_like_a_string():
    r = random.Random(3)
    for unit in (None, re.compile(r"\s*\w+"), re.compile(r"[^\n]*\n")):
        for n in (0, 1, 5, 64, 1000):
            text = "".join(r.choice("ab é\n😀.") for _ in range(n))
            rope = fm.build(text, unit, leaf=4)
            ends = [0, *(e for leaf in [fm._leaves(text, unit, 1 << 30)] for x in leaf for e in (x.ends or range(1, len(text) + 1)))]
            assert str(rope) == text and rope.chars == n and rope.units == len(ends) - 1 and ends[-1] == n
            for rank in {0, rope.units, *(r.randint(0, rope.units) for _ in range(20))}:
                a, b = fm.split(rope, rank)
                assert (str(a), str(b)) == (text[: ends[rank]], text[ends[rank] :])
                assert (a.units, b.units, a.chars) == (rank, rope.units - rank, ends[rank])
                again = fm.concat(b, a)
                assert str(again) == text[ends[rank] :] + text[: ends[rank]]
                x, y = fm.split(again, b.units)
                assert (str(x), str(y)) == (str(b), str(a))


def test_units_of_words(spark):
    rows = fm.restored(fm.fill_in_middle(frame(spark, {k: prose(k, 50) for k in range(40)}), unit=r"\s*\S+")).collect()
    for r in rows:
        assert r.n == 50 and r.restored == prose(r.doc_id, 50)
        if r.form != "plain":  # cuts lie between words
            p = prose(r.doc_id, 50)
            assert all(c == len(p) or p[c] == " " or c == 0 for c in (r.prefix_chars, r.prefix_chars + r.middle_chars))


def test_a_million_leaves_need_no_deep_recursion():
    rope = fm.build("ab" * 500_000, None, leaf=1)
    for _ in range(50):
        a, b = fm.split(rope, rope.units // 3)
        rope = fm.concat(b, a)
    assert rope.chars == 1_000_000
