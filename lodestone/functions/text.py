"""Text and path expressions, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def theme_tokens(text: Column) -> Column:
    """The whole lower-cased text and its parts of two characters or more, distinct, in order."""
    low = F.lower(text)
    parts = F.filter(F.split(low, r"[\s,，、/·:：_-]+"), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.concat(F.array(low), parts))


def words_of(text: Column) -> Column:
    """Identifier words: camel case split, lower-cased, cut at anything but a-z and 0-9."""
    spaced = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(spaced, "[^a-z0-9]+"), lambda t: t != "")


def segment_for_lookup(text: Column) -> Column:
    """Runs of Han characters become overlapping pairs; other runs are trimmed; all joined by blanks."""
    runs = F.regexp_extract_all(text, F.lit(r"([一-鿿]+|[^一-鿿]+)"), F.lit(1))

    def cut(run: Column) -> Column:
        pairs = F.array_join(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))), " "
        )
        return F.when(run.rlike(r"^[一-鿿]"), pairs).otherwise(F.trim(run))

    return F.array_join(F.filter(F.transform(runs, cut), lambda x: x != ""), " ")


def token_hits(token: Column, text: Column) -> Column:
    """Long or non-ASCII tokens match anywhere; ASCII ones of five characters or fewer start a word."""
    loose = (F.length(token) >= 6) | token.rlike(r"[^\x00-\x7F]")
    return F.when(loose, F.contains(F.lower(text), token)).otherwise(F.exists(words_of(text), lambda w: F.startswith(w, token)))


def normalize_route(path: Column) -> Column:
    """Query and fragment go, parameters become {*}, slashes collapse, one leading and no trailing slash."""
    p = F.regexp_replace(path, r"(?s)[?#].*$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\$?\{[^}]*\}", "{*}"), r"<[^>]*>", "{*}")
    p = F.regexp_replace(p, r"/:\w+", "/{*}")
    p = F.regexp_replace(F.concat(F.lit("/"), p), "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def mask_ids(url: Column) -> Column:
    """Repository ids and UUIDs become placeholders."""
    url = F.regexp_replace(url, "(?i)repo_[0-9a-f]+", ":repoId")
    return F.regexp_replace(url, "(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", ":id")


def package_identity(language: Column, spec: Column) -> Column:
    """The part of an import that names its package: 1 segment in Python, 4 in Java and
    C#, 3 in Go if the first is a domain, 2 of a scoped node package."""
    dots, slashes = F.split(spec, r"\."), F.split(spec, "/")
    first = lambda parts, n, sep: F.array_join(F.slice(parts, 1, n), sep)
    return (
        F.when(language == "python", F.get(dots, F.lit(0)))
        .when(language.isin("java", "csharp"), first(dots, 4, "."))
        .when(language == "go", F.when(F.get(slashes, F.lit(0)).contains("."), first(slashes, 3, "/")).otherwise(F.get(slashes, F.lit(0))))
        .when(spec.startswith("@"), first(slashes, 2, "/"))
        .otherwise(F.get(slashes, F.lit(0)))
    )


def package_roots(spec: Column) -> Column:
    """The prefixes of two and three dotted segments."""
    parts = F.split(spec, r"\.")
    return F.filter(
        F.transform(F.sequence(F.lit(2), F.lit(3)), lambda n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, 1, n), "."))),
        lambda x: x.isNotNull(),
    )


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def thread_title(question: Column) -> Column:
    """The first five characters of a question with blanks collapsed."""
    return F.substring(F.trim(F.regexp_replace(question, r"\s+", " ")), 1, 5)


def truncated(text: Column, limit: int = 2000) -> Column:
    """(text, truncated) with at most `limit` characters."""
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"))


# Folders of tests, and names of test files.
TEST_FOLDERS = ("test", "tests", "__tests__", "test-fixtures", "fixtures", "spec", "specs", "testing", "e2e")
TEST_NAMES = r"^conftest\.py$|^test_.*\.py$|_test\.(py|go|rb)$|\.(test|spec)\.[cm]?[jt]sx?$"


def is_test_path(path: Column) -> Column:
    """By a folder on the way, or by the file's name."""
    low = F.lower(path)
    return F.arrays_overlap(F.split(dirname(low), "/"), F.array(*map(F.lit, TEST_FOLDERS))) | basename(low).rlike(TEST_NAMES)


def import_origin(language: Column, spec: Column, own: Column) -> Column:
    """stdlib, in-repo, external or unknown; `own` says whether the tree declares the module.
    Python's library is what this interpreter ships."""
    import sys

    first = F.split(spec, r"[./:]")[0]
    python = F.when(spec.startswith(".") | own, "in-repo").when(first.isin(*sorted(sys.stdlib_module_names)), "stdlib").otherwise("external")
    java = F.when(spec.startswith("java."), "stdlib").when(own, "in-repo").otherwise("external")
    rust = F.when(spec.rlike("^(std|core|alloc)(::|$)"), "stdlib").when(spec.rlike("^(crate|self|super)(::|$)") | own, "in-repo").otherwise("external")
    go = F.when(own, "in-repo").when(F.contains(F.substring_index(spec, "/", 1), F.lit(".")), "external").otherwise("stdlib")
    csharp = F.when((spec == "System") | spec.startswith("System."), "stdlib").otherwise("external")
    return (
        F.when(language == "python", python).when(language == "java", java).when(language == "rust", rust).when(language == "go", go)
        .when(language == "csharp", csharp).otherwise(F.when(own, "in-repo").otherwise("unknown"))
    )
