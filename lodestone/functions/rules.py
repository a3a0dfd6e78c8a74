"""Small decisions as columns: units and topics, tiers, scores, names, probes, layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the units that are still practised, the types of exercise kinds, steps of generation.
LIVE_UNITS = ("impact:", "implementation:", "llm:", "llm-code:")
KIND_TYPES = {"llm_rubric": "analysis", "patch_edit": "design", "author_function": "design"}
SEGMENTS = ("prompt", "code", "tests")

# Endings of source files by language.
LANGUAGES = {
    "typescript": ".ts .tsx .js .jsx .mjs .cjs .mts .cts", "vue": ".vue", "python": ".py", "java": ".java", "go": ".go", "rust": ".rs", "csharp": ".cs",
    "cpp": ".c .h .cc .cpp .cxx .hpp .hh",
}


def is_live_unit(unit: Column) -> Column:
    out = F.lit(False)
    for p in LIVE_UNITS:
        out = out | unit.startswith(p)
    return out


def topic_of_unit(unit: Column) -> Column:
    """The part after `llm:` or `llm-code:`; null for other units and where it is empty."""
    return F.nullif(F.regexp_extract(unit, "^llm(?:-code)?:([^:]*)", 1), F.lit(""))


def exercise_type(kind: Column) -> Column:
    out = F.lit("comprehension")
    for k, t in KIND_TYPES.items():
        out = F.when(kind == k, t).otherwise(out)
    return out


def segment_of_step(step: Column) -> Column:
    head = F.substring_index(step, "-", 1)
    return F.when(head.isin(*SEGMENTS), head)


def language_of(ending: Column) -> Column:
    """Of an ending with or without its dot, in any case."""
    e = F.lower(F.trim(ending))
    e = F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))
    out = F.lit(None).cast("string")
    for language, endings in LANGUAGES.items():
        out = F.when(e.isin(*endings.split()), language).otherwise(out)
    return out


def days_since(at: Column, now: Column) -> Column:
    """Whole days, not below 0; null if never."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000)).cast("int")


def rubric_score(value: str) -> Column:
    """A judge's number (a column of texts) held between 0 and 1, in hundredths; null if it is none."""
    number = F.expr(f"try_cast(trim({value}) AS DOUBLE)")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.floor(number * 100 + 0.5) / 100)))


def tier(a_rate: Column, b_rate: Column, rounds: Column) -> Column:
    """What becomes of an exam point by the shares of its two samples; a middling share is watched for three rounds."""
    return (
        F.when(a_rate >= 0.5, "enabled").when(a_rate >= 0.25, F.when(rounds >= 3, "grey").otherwise("observe"))
        .when(b_rate < 0.25, "disabled").when(b_rate < 0.5, "grey").otherwise("tune_signal")
    )


def diagram_name(name: Column, limit: int = 40) -> Column:
    """Blanks collapsed and trimmed, of `limit` characters at most; never null."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " "), 1, limit)


def version_stamp(at: Column) -> Column:
    return F.date_format(at, "MM-dd HH:mm")


def probes(text: Column) -> Column:
    """`a & b; c` as [[a, b], [c]]: groups of which one must hold, of terms that all must; empty ones go."""
    groups = F.transform(F.split(text, ";"), lambda g: F.filter(F.transform(F.split(g, "&"), lambda t: F.trim(t)), lambda t: t != ""))
    return F.filter(groups, lambda g: F.size(g) > 0)


def share_of_context(tokens: int, share: Column, chars_per_token: int = 4) -> Column:
    return F.floor(F.lit(tokens * chars_per_token) * share).cast("long")


def relevance(folder: Column, preferred: Column, related: Column, changes: Column) -> Column:
    """60 for a preferred folder, 15 for one under the same top folder, 45 for a related file, a point for each change up to 10."""
    top = lambda p: F.substring_index(p, "/", 1)
    same_top = F.exists(preferred, lambda p: top(p) == top(folder))
    return (
        F.when(F.array_contains(preferred, folder), 60).otherwise(0) + F.when(same_top, 15).otherwise(0) + F.when(related, 45).otherwise(0)
        + F.least(F.coalesce(changes, F.lit(0)), F.lit(10))
    )


def first_object(text: Column) -> Column:
    """From the first { to the last }, as it is; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def note_relevance(point: Column, path: Column, symbol: Column, points: Column, paths: Column, words: Column) -> Column:
    """3 for the point, 2 for the file, 1 for a word of the theme in the symbol's name."""
    named = F.exists(words, lambda w: F.contains(F.lower(symbol), w))
    return (
        F.when(F.array_contains(points, point), 3).otherwise(0) + F.when(F.array_contains(paths, path), 2).otherwise(0) + F.when(F.coalesce(named, F.lit(False)), 1).otherwise(0)
    )


def concepts(theme: Column, table: dict[str, list[str]]) -> Column:
    """The concepts that a theme names: by their name or a synonym, then those of which a word of three letters or more stands in it."""
    needle = F.lower(F.trim(theme))
    exact = [F.when(needle.isin(*{w.lower() for w in (c, *s)}), c) for c, s in table.items()]
    inside = []
    for c, s in table.items():
        held = F.lit(False)
        for w in (c, *s):
            if len(w) >= 3:
                held = held | F.contains(needle, F.lit(w.lower()))
        inside.append(F.when(held, c))
    found = F.array_distinct(F.filter(F.array(*exact, *inside), lambda c: c.isNotNull()))
    return F.when(needle == "", F.array().cast("array<string>")).otherwise(found)


# The grid of a diagram.
CELL = (264, 112)
GAP = 32
TITLE, PAD, BETWEEN, ORIGIN, COLUMNS = 32, 28, 28, 80, 5


def cell_at(index: Column, x: Column, y: Column) -> Column:
    """Where the index-th box (from 0) of a grid with its corner at (x, y) stands."""
    return F.struct((x + (index % COLUMNS) * (CELL[0] + GAP)).cast("int").alias("x"), (y + F.floor(index / COLUMNS) * (CELL[1] + GAP)).cast("int").alias("y"))


def group_height(members: Column) -> Column:
    rows = F.greatest(F.lit(1), F.ceil(members / COLUMNS))
    return (TITLE + rows * CELL[1] + (rows - 1) * GAP + PAD).cast("int")


def needs_layout(nodes: Column, places: Column) -> Column:
    """Whether so many nodes stand on so few distinct places that they must be laid out."""
    return (nodes >= 2) & (places <= F.greatest(F.lit(1), F.floor(nodes / 3)))
