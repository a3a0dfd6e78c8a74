"""The byte watermark: appends, unfinished and bad lines, rotation, truncation, rewriting, restarts, ranges."""

from __future__ import annotations

import json
import os

import pytest

from lodestone.sources import tail


def line(k: int, **more) -> str:
    return json.dumps({"id": f"e{k}", "type": "t", "at": "2026-01-02T03:04:05Z", "payload": {"k": str(k)}, **more}) + "\n"


@pytest.fixture
def run(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    def once(range_bytes=1 << 20):
        rows = tail.tail_journal(spark, str(logs), range_bytes=range_bytes)
        q = tail.append_batches(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None
        out = tmp_path / "out"
        return sorted((r.id, r.offset) for r in spark.read.option("basePath", str(out)).parquet(f"{out}/*").collect()) if out.exists() else []

    return logs, once


def test_appends_restart_and_unfinished_lines(run):
    logs, once = run
    f = logs / "a.jsonl"
    f.write_text(line(1) + "not json\n" + line(2) + line(3)[:20])
    first = once()
    assert [i for i, _ in first] == ["e1", "e2"]
    with f.open("a") as more:
        more.write(line(3)[20:] + line(4))
    (logs / "b.jsonl").write_text(line(9))
    assert [i for i, _ in once()] == ["e1", "e2", "e3", "e4", "e9"]
    assert [i for i, _ in once()] == ["e1", "e2", "e3", "e4", "e9"]  # nothing new: no line twice


def test_rotation_truncation_and_rewriting(run):
    logs, once = run
    f = logs / "a.jsonl"
    f.write_text(line(1) + line(2) + line(3))
    assert len(once()) == 3
    os.rename(f, logs / "a.jsonl.1")
    f.write_text(line(4) + line(5) + line(6) + line(7))  # another head, longer
    assert [i for i, _ in once()] == ["e1", "e2", "e3", "e4", "e5", "e6", "e7"]
    f.write_text(line(8))  # shorter
    assert [i for i, _ in once()][-1] == "e8" and len(once()) == 8
    os.utime(f, (1, 1))
    f.write_text(line(9))  # as long as before
    assert [i for i, _ in once()][-2:] == ["e8", "e9"]
    f.unlink()
    assert len(once()) == 9


def test_ranges_split_between_lines(run):
    logs, once = run
    (logs / "a.jsonl").write_text("".join(line(k, extra="x" * (k % 90)) for k in range(500)))
    got = once(range_bytes=257)
    assert sorted(i for i, _ in got) == sorted(f"e{k}" for k in range(500)) and len({o for _, o in got}) == 500


def test_traces(spark, tmp_path):
    (tmp_path / "engine.jsonl").write_text('{"at": "2026-01-02T03:04:05Z", "kind": "degrade", "traceId": null, "durationMs": 2.5, "detail": {"a": "b"}}\n{"at": 1}\n')
    rows = tail.traces(tail.tail_lines(spark, str(tmp_path)))
    q = tail.append_batches(rows, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out/*").collect()
    assert [(r.kind, r.trace_id, r.duration_ms, r.detail) for r in got] == [("degrade", None, 2.5, {"a": "b"})]
