"""Source trees as relations of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

# What is read and what never is.
EXTENSIONS = (".py", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".vue", ".java", ".go", ".rs", ".cs", ".c", ".h", ".cc", ".cpp", ".hpp", ".md", ".json", ".yaml", ".yml", ".toml", ".sql", ".xml", ".properties")
KEY_EXTENSIONS = (".pem", ".key", ".p8", ".p12", ".pfx", ".jks", ".keystore", ".crt", ".cer", ".der")
CREDENTIAL_NAMES = (
    ".npmrc", ".netrc", "_netrc", ".pypirc", ".htpasswd", ".git-credentials", ".dockercfg", "credentials", "credentials.json",
    "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
)
ENV_TEMPLATES = (".example", ".sample", ".template", ".dist")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, bytes, lines, content_hash, content) of the files under a root,
    in any store that Spark reads. Hidden files (leading dot or underscore) are never
    listed by Spark's readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
    text = F.decode("content", "UTF-8")
    return files.select(
        path.alias("path"), T.extension(path).alias("extension"), F.col("length").alias("bytes"), F.size(F.split(text, "\n", -1)).alias("lines"),
        F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), text.alias("content"),
    )


def denied(path: Column) -> Column:
    """Why a file's name forbids reading it: env, key or credential; null if it doesn't."""
    name = F.lower(T.basename(path))
    key = F.lit(False)
    for e in KEY_EXTENSIONS:
        key = key | name.endswith(e)
    template = F.lit(False)
    for e in ENV_TEMPLATES:
        template = template | name.endswith(e)
    env = T.basename(path).startswith(".env") | (T.extension(path) == ".env")
    return F.when(env & ~template, "env").when(key, "key").when(name.isin(*CREDENTIAL_NAMES), "credential")


def ingested(path: Column) -> Column:
    return T.extension(path).isin(*EXTENSIONS) & denied(path).isNull()


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """(regex over a path or an ancestor folder with a trailing slash, negated) of an
    ignore rule: *, ?, **, a leading ! and a trailing slash. Rules match at any depth."""
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule.lstrip("!").strip("/") + ("/" if rule.endswith("/") else "")
    out, at = "", 0
    while at < len(rule):
        if rule.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif rule.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(rule[at], re.escape(rule[at]))
            at += 1
    return f"^(?:.*/)?{out}{'' if rule.endswith('/') else '/?'}$", negated


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a path, or a folder it lies in, is ignored: the last rule that matches decides.
    The rules are one expression, so they reach the scan of the paths."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n < F.size(parts), "/").otherwise("")))
    out = F.lit(False)
    for found in filter(None, map(ignore_pattern, rules)):
        pattern, negated = found
        out = F.when(F.exists(folders, lambda p: p.rlike(pattern)), not negated).otherwise(out)
    return out


def stamps(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, stamp): one hash of each key's `entry` texts joined by `;`, sorted by `order`.
    Null entries are left out; a key with no other has a null stamp. The sorted rows are
    streamed into the hash, so no task holds a key's list; the hash of one text is
    sequential, so one task reads each key."""
    dealt = entries.repartition(key).sortWithinPartitions(key, *order).select(F.col(key).cast("string").alias("key"), "entry")

    def run(batches):
        import hashlib

        import pyarrow as pa

        def row(key, h):
            stamp = h and "content:" + h.hexdigest()[:24]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([stamp], pa.string())], ["key", "stamp"])

        at, begun, h = None, False, None
        for b in batches:
            for k, entry in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not begun or k != at:
                    if begun:
                        yield row(at, h)
                    at, begun, h = k, True, None
                if entry is not None:
                    if h is None:
                        h = hashlib.sha256()
                    else:
                        h.update(b";")
                    h.update(entry.encode())
        if begun:
            yield row(at, h)

    return dealt.mapInArrow(run, "key string, stamp string").withColumnRenamed("key", key)


def fingerprint(files: DataFrame) -> DataFrame:
    """One hash of a tree: sorted path:hash pairs."""
    entries = files.select(F.lit("tree").alias("tree"), F.concat_ws(":", "path", "content_hash").alias("entry"))
    empty = F.concat(F.lit("content:"), T.short_hash(F.lit(""), 24))
    return stamps(entries, "tree", ["entry"]).agg(F.coalesce(F.max("stamp"), empty).alias("stamp"))
