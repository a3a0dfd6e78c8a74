"""Byte-level BPE through distinct words against the library on whole texts."""

from __future__ import annotations

import hashlib

import pytest

from lodestone.llm import bpe
from tests.llm.helpers import frame, prose

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(docs):
    t = tokenizers.Tokenizer.from_file(PATH)
    out = []
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def cases():
    docs = [(None, "no id here"), (None, None), (1, None), (2, ""), (3, " "), (4, "\n\n  x \t y's it'S  "), (5, "<|endoftext|>"), (6, "a<|endoftext|><|endoftext|> b!<|endoftext|>\n")]
    docs += [(7, "<|endoftext"), (8, "naïve 漢字かな 😀👩‍👩‍👧 \u0085   ١٢٣ ²½"), (9, "new ࡰౝ \U000323af letters don't"), (10, "͸ unassigned"), (11, "\x00\x1c\x1d \x7f")]
    docs += [(20, "same"), (20, "same"), (20, "other"), (21, "q" * 30_000), (22, prose(22, 60_000)), (23, "!?" * 20_000)]
    docs += [(100 + k, f"copied text with a rare zq{'x' * (k % 2)}word") for k in range(200)]
    return docs + [(1000 + k, prose(k, k % 30) + f" unique{k}word") for k in range(200)]


def test_query_rows(spark, tmp_path):
    frame(spark, cases()).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.op13_byte_pair_encoding(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(plain(cases()), key=str)


def test_without_common_words_and_with_all(spark, monkeypatch):
    spec = bpe.load(PATH)
    docs = frame(spark, cases())
    want = sorted((d, n) for d, n, *_ in plain(cases()) if d is not None)
    for sample, common in ((1, 10), (1, 100_000), (1 << 40, 5)):
        monkeypatch.setattr(bpe, "SAMPLE", sample)
        monkeypatch.setattr(bpe, "COMMON_WORDS", common)
        assert sorted((r.doc_id, len(r.ids)) for r in bpe.encode(docs, spec).collect() if r.doc_id is not None) == want


def test_each_code_point_splits_as_in_the_library(spark):
    """All code points, between letters, digits, signs and blanks."""
    from pyspark.sql import functions as F

    texts = []
    for start in range(0, 0x110000, 256):
        points = [c for c in range(start, start + 256) if not 0xD800 <= c <= 0xDFFF]
        texts += ["".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)}  {chr(c)}" for c in points)] if points else []
    # a block with an unassigned code point goes to the library: take the assigned ones of it alone, too
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.rlike("text", F.lit(r"\p{Cn}")).alias("odd"), bpe.words(F.col("text"), []).alias("w")).collect()
    t = tokenizers.Tokenizer.from_file(PATH)
    sure = [r for r in got if not r.odd]
    assert len(sure) > 300
    for r in sure:
        assert r.w == bpe.split_by_library(t, [], r.text)


def test_empty_table_and_reuse(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op13_byte_pair_encoding(spark, str(tmp_path)).count() == 0


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.load(PATH.replace("byte_bpe_50k", "word_bpe_49k"))
