"""Conversation repair against a plain search over edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from lodestone.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, step string, copies int"
VALID = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(kinds):
    """(cost, audit) by a search over (cost, audit, state), the least first; kinds: (initial, must go, truncated)."""
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(0, ""): (0, "")}

    def better(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value
            return True

    for i in range(len(kinds) + 1):
        grown = True
        while grown:
            grown = False
            for (row, state), (c, a) in list(best.items()):
                if row == i:
                    for letter in "ua":
                        if (state, letter) in to:
                            grown |= bool(better(best, (i, to[state, letter]), (c + 2, a + "I")))
        if i < len(kinds):
            initial, must, cut = kinds[i]
            for (row, state), (c, a) in list(best.items()):
                if row == i:
                    better(best, (i + 1, state), (c + 3, a + "D"))
                    if not must:
                        if (state, initial) in to:
                            better(best, (i + 1, to[state, initial]), (c + cut, a + "K"))
                        for letter in "ua":
                            if (state, letter) in to:
                                better(best, (i + 1, to[state, letter]), (c + 2 + cut, a + "R"))
    return min(best[len(kinds), s] for s in ("", "a") if (len(kinds), s) in best)


def plain(rows):
    groups = defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        ordered = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in ordered:
            bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(ordered))
        turns = {r[1] for r in ordered if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(kinds)
        lines, at, state = [], 0, ""
        for step in audit:
            role, text = None, ""
            if step != "I":
                role, text = ordered[at][2:]
                at += 1
            if step in "RI":
                role = "assistant" if state == "u" else "user"
            if step != "D":
                state = role[0]
                lines.append(f"{role}:{text}")
        assert VALID.fullmatch("".join(x[0] for x in lines)) and at == len(ordered)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    r = random.Random(11)
    roles = ("user", "assistant", "system", "tool", "", "ünder", None, "user", "assistant")
    texts = ("Fine.", "Is it?", "cut", "x  \t", " ", "", None, "漢字!", "a.b", "\x1f", "Yes!\n")
    rows = [(None, t, r.choice(roles), r.choice(texts)) for t in (None, 1, 1, 5)]
    rows += [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (2, 7, None, None), (3, 1, "user", "w " * 50_000 + ".")]
    for conv in range(10, 400):
        n = r.randint(1, 9)
        rows += [(conv, r.choice((k, k, k, r.randint(-3, 12), None)), *((r.choice(roles), r.choice(texts)) if conv % 2 else (("user", "assistant")[k % 2], f"Turn {k}."))) for k in range(n)]
    hot = [(7, k // 2, r.choice(roles), r.choice((*texts, f"Own {k}."))) for k in range(1500)]
    return rows + hot + [(8, 4, "user", "Again.")] * 300 + [(9, k, "user", "Same.") for k in range(200)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "K", 2) for r in rows], SCHEMA)


def test_query_rows(spark, tmp_path):
    frame(spark, cases()).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_structure_repair(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(cases())


def test_conversations_across_partitions(spark, tmp_path, monkeypatch):
    """The same rows in pieces: the hot conversation crosses some hundred partitions."""
    monkeypatch.setattr(repair, "PART_ROWS", 25)
    frame(spark, cases()).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_structure_repair(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(cases())


def test_pieces_join_to_the_whole():
    r = random.Random(5)
    for _ in range(300):
        kinds = bytes(r.randrange(9) for _ in range(r.randint(3, 40)))
        cuts = sorted(r.sample(range(1, len(kinds)), r.randint(1, 2)))
        pieces = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)])]
        tail = repair.distances(pieces[-1], repair.GOAL)[0].tolist()
        exits = repair._exits([[x for row in repair.crossing(p) for x in row] for p in pieces[:-1]] + [tail])
        state, audit = repair.START, ""
        for k, (p, e) in enumerate(zip(pieces, exits)):
            last = k == len(pieces) - 1
            more, state = repair.walk(p, repair.distances(p, e, last), state, last)
            audit += more
        assert audit == repair.solve(kinds) == cheapest([("x" if k == 0 else "suax"[(k - 1) // 2], k == 0, (k - 1) % 2 if k else 0) for k in kinds])[1]


def test_steps_and_empty_table(spark, tmp_path):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Well")]
    steps, ranged = repair.repair(frame(spark, rows))
    assert [(r.step, r.role, r.text, r.fault) for r in steps.orderBy("part", "place").collect()] == [("K", "user", "Hi.", 0), ("D", None, None, 2), ("R", "assistant", "Well", 3)]
    assert [tuple(r) for r in repair.structure(ranged).collect()] == [(1, 2, 0)]
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op11_structure_repair(spark, str(tmp_path)).count() == 0
