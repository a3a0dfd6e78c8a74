"""Fill-in-the-middle documents by ropes.

A text becomes a rope: a binary tree whose leaves hold up to LEAF units of text
and whose nodes cache the number of units and of code points below them. A cut
at a unit rank walks down one path and shares all other subtrees, so prefix,
middle and suffix are split off and put together in their new order, with the
sentinels between them, without copying text. The inverse finds the sentinels
in the output, splits its rope at their code-point ranks and puts the parts back.

Units are code points, or the matches of a pattern from left to right: what no
match covers belongs to the next one, and what follows the last to the last.
Cuts and form depend on the document's id alone (four numbers from its
SHA-256), so they are the same on every run. A form is `plain` (left as it is:
texts that are empty or hold a sentinel, and the share 1 - fim), `psm` or `spm`.

Restoring is exact: a sentinel's first character occurs in it once, so no text
can grow together with a neighbouring sentinel to a second one.

Defined cases: null text is empty, so plain; a null id hashes as an empty one;
repeated rows give equal rows; a cut may be empty at either end; long texts
give a rope of their own and nothing is ever cut short; an empty table gives no
rows; other columns are not read."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents to rearrange, and of these the ones with the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
LEAF = 2048


class Rope:
    """A leaf (text) or two ropes (left, right), with their units and code points."""

    __slots__ = ("text", "ends", "left", "right", "units", "chars")

    def __init__(self, text: str = "", ends: list[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text, self.ends = left, right, text, ends
        if left is None:
            self.chars, self.units = len(text), len(text) if ends is None else len(ends)
        else:
            self.chars, self.units = left.chars + right.chars, left.units + right.units

    def leaves(self):
        waiting = [self]
        while waiting:
            at = waiting.pop()
            if at.left is None:
                yield at.text
            else:
                waiting += (at.right, at.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def _leaves(text: str, unit: re.Pattern | None, leaf: int) -> list[Rope]:
    if unit is None:
        return [Rope(text[i : i + leaf]) for i in range(0, len(text), leaf)]
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends[-1:] = [len(text)]
    out, start = [], 0
    for k in range(0, len(ends), leaf):
        block = ends[k : k + leaf]
        out.append(Rope(text[start : block[-1]], [e - start for e in block]))
        start = block[-1]
    return out


def build(text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
    """A balanced rope over text."""
    level = _leaves(text, unit, leaf) or [Rope("", None if unit is None else [])]
    while len(level) > 1:
        level = [Rope(left=level[i], right=level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def concat(*ropes: Rope) -> Rope:
    out = ropes[0]
    for rope in ropes[1:]:
        out = rope if not out.chars else out if not rope.chars else Rope(left=out, right=rope)
    return out


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rope.left is None:
        at = rank if rope.ends is None else rope.ends[rank - 1] if rank else 0
        heads, tails = (None, None) if rope.ends is None else (rope.ends[:rank], [e - at for e in rope.ends[rank:]])
        return Rope(rope.text[:at], heads), Rope(rope.text[at:], tails)
    if rank <= rope.left.units:
        a, b = split(rope.left, rank)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - rope.left.units)
    return concat(rope.left, a), b


def rearrange(rope: Rope, first: int, second: int, form: str) -> tuple[Rope, int, int]:
    """The output's rope, and the code points of prefix and middle."""
    prefix, rest = split(rope, first)
    middle, suffix = split(rest, second - first)
    parts = (Rope(PREFIX), prefix, Rope(SUFFIX), suffix) if form == "psm" else (Rope(SUFFIX), suffix, Rope(PREFIX), prefix)
    return concat(*parts, Rope(MIDDLE), middle), prefix.chars, middle.chars


def restore(output: str, form: str) -> str:
    """The text that gave this output in this form."""
    if form == "plain":
        return output
    second, third = output.index(SUFFIX if form == "psm" else PREFIX), output.index(MIDDLE)
    head, middle = split(build(output), third)
    head, last = split(head, second)
    cut = lambda rope: split(rope, len(PREFIX))[1]
    first, last, middle = cut(head), cut(last), cut(middle)
    return str(concat(first, middle, last) if form == "psm" else concat(last, middle, first))


def draws(doc_id: Column) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of `1:` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _fill(unit: str | None, fim: int, spm: int):
    def run(batch: pa.RecordBatch) -> dict:
        pattern = re.compile(unit) if unit else None
        ids, texts, *h = (c.to_pylist() for c in batch.columns)
        out: dict[str, list] = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
        for text, h1, h2, h3, h4 in zip(texts, *h):
            text = text or ""
            rope = build(text, pattern)
            if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim:
                row = rope.units, "plain", None, None, text
            else:
                a, b = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
                form = "spm" if h4 % 100 < spm else "psm"
                whole, before, inside = rearrange(rope, a, b, form)
                row = rope.units, form, before, inside, str(whole)
            for values, value in zip(out.values(), row):
                values.append(value)
        return out | {"doc_id": batch.column(0)}

    return run


def fill_in_middle(docs: DataFrame, unit: str | None = None, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws(F.col("doc_id")))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(rows, _fill(unit, fim_percent, spm_percent), schema)


def restored(filled: DataFrame) -> DataFrame:
    """The same rows with `restored`, the text rebuilt from output and form."""
    names = filled.columns

    def run(batch: pa.RecordBatch) -> dict:
        out = {name: batch.column(i) for i, name in enumerate(names)}
        return out | {"restored": [restore(o, f) for o, f in zip(out["output"].to_pylist(), out["form"].to_pylist())]}

    return map_batches(filled, run, f"{filled.schema.simpleString()[7:-1]}, restored: string", "output")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM g
"""
