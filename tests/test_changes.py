"""Keyed state: no-ops, quiet times, late rows, expiry, restarts; a batch written twice counts once."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest

from lodestone.streaming import changes


@pytest.fixture
def run(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    n = iter(range(100))

    def once(*rows, quiet=timedelta(0)):
        if rows:
            (source / f"{next(n):03}.json").write_text("\n".join(json.dumps({"k": k, "t": f"2026-01-02T{t}:00Z", "c": c}) for k, t, c in rows))
        stream = spark.readStream.schema("k string, t timestamp, c string").option("maxFilesPerTrigger", 1).json(str(source))
        out = changes.content_changes(stream, "k", "t", "c", timedelta(hours=1), "10 minutes", quiet)
        q = changes.upsert_batches(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None
        if not (tmp_path / "out").exists():
            return []
        return sorted((r.key, r.at.strftime("%H:%M"), r.change, r.content) for r in spark.read.option("basePath", str(tmp_path / "out")).parquet(f"{tmp_path}/out/batch=*").collect())

    return tmp_path, once


def test_changes_over_batches_and_restarts(spark, run):
    path, once = run
    first = [("a", "03:00", "new", "1"), ("b", "03:01", "new", "x")]
    assert once(("a", "03:00", "1"), ("b", "03:01", "x"), ("a", "03:02", "1")) == first
    # the same content is no change, whatever the batch; a late row is older than what is known
    assert once(("a", "03:05", "1"), ("b", "03:06", "y"), ("a", "03:03", "9"), ("a", "03:06", "2")) == sorted([*first, ("a", "03:03", "changed", "9"), ("a", "03:05", "changed", "1"), ("a", "03:06", "changed", "2"), ("b", "03:06", "changed", "y")])
    seen = once(("a", "03:01", "late"))
    assert ("a", "03:01", "changed", "late") not in seen
    assert {(r.key, r.content) for r in changes.current(spark, f"{path}/out").collect()} == {("a", "2"), ("b", "y")}
    # an hour and the watermark's delay later both are gone
    once(("c", "05:00", "z"))
    seen = once(("c", "05:01", "z"))
    assert {x for x in seen if x[2] == "expired"} == {("a", "03:06", "expired", None), ("b", "03:06", "expired", None)}
    assert {(r.key, r.content) for r in changes.current(spark, f"{path}/out").collect()} == {("c", "z")}
    assert [x for x in once(("a", "05:02", "2")) if x[:2] == ("a", "05:02")] == [("a", "05:02", "new", "2")]


def test_quiet_time_and_a_batch_run_twice(spark, run):
    path, once = run
    rows = [("a", f"03:{m:02}", str(m)) for m in range(5)] + [("a", "03:30", "30"), (None, "03:00", None)]
    want = [("", "03:00", "new", None), ("a", "03:04", "new", "4"), ("a", "03:30", "changed", "30")]
    assert once(*rows, quiet=timedelta(minutes=2)) == want
    for f in (path / "checkpoint" / "commits").iterdir():  # as if the driver had died before the commit
        f.unlink()
    assert once(quiet=timedelta(minutes=2)) == want
