"""The pipeline's stages in turn, each against a plain version on its own input."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from lodestone.llm import mixing, quality
from lodestone.llm.common import cut, table
from tests.conftest import DATA
from tests.llm.helpers import frame, prose
from tests.llm.test_texts import components_plain, contamination_plain, dedup_plain


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    outs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(cut(stage(spark, outs[-1], DATA)))
    assert all(df.columns == columns for df in outs[:5]) and outs[5].columns[: len(columns)] == columns

    raw, good, deduped, single, clean, mixed = map(texts, outs)
    model = quality.fit(docs, table(spark, DATA, "labels"))
    scored = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert Counter(d for d, _ in good) == Counter(d for d, _ in raw if scored[d] >= quality.CUTOFF)

    want = {(d, digest) for d, _, _, digest in dedup_plain(good)}
    assert {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in deduped} == want
    assert Counter(single) == Counter(x for x in deduped if components_plain(deduped)[x[0]][1] == x[0])

    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    hit = {d: n for d, _, n, _ in contamination_plain(single, items)}
    assert Counter(clean) == Counter(x for x in single if not hit[x[0]])

    again = mixing.mix(outs[4])
    assert Counter(texts(again)) == Counter(mixed) and set(mixed) <= set(clean) and mixed


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def folder(spark, path, docs, items):
    frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, no labels."""
    passage = "what is the tallest of the seven hills beyond the old northern river"
    copy = prose(1, 60)
    docs = [(1, None), (2, ""), (None, prose(2, 40)), (None, None), (3, prose(3, 30_000)), (4, copy), (4, copy), (5, copy + " more"), (6, f"{prose(4, 30)} {passage}"), (7, prose(5, 50)), (7, prose(6, 50))]
    path = folder(spark, tmp_path, docs, [(1, passage), (2, None), (3, "")])
    at = table(spark, path, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        at = cut(stage(spark, at, path))
        sizes.append((name, at.count()))
        assert at.columns[: len(table(spark, path, "documents").columns)] == table(spark, path, "documents").columns
    assert sizes[:4] == [("quality", 11), ("line_dedup", 11), ("near_dedup", 10), ("decontamination", 9)]
    assert {r.doc_id for r in at.collect()} <= {None, 3, 4, 7}


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [])).count() == 0
