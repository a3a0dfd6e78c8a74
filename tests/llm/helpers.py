"""Small tables with the awkward cases, and plain versions of what is tested."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, tokens string, cell int"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"Word{r.randrange(vocabulary)}" for _ in range(n))


def frame(spark, texts: dict[int | None, str | None] | list):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = list(texts.items()) if isinstance(texts, dict) else texts
    langs = ("en", "de", None)
    return spark.createDataFrame(
        [(d, t, langs[k % 3], f"src{k % 2}" if k % 5 else None, None if t is None else len(t), 0.5, "x", 1) for k, (d, t) in enumerate(rows)], DOCS
    )
