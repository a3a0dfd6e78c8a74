"""Calls resolved to symbols, with Java's receivers, wildcard imports and type dispatch.

Everything is an equi join narrowed by a file or a package, so a name found
everywhere doesn't meet itself: `lines` (path, line, content), `symbols` and `scopes` of
the syntax module, `imports` (src, dst). Java's types are known by the convention that
a file is named after its type. What a file sees: the types it imports (a wildcard brings
the package's), and those of its own package; inferred by package, a type must lie under
the same source root (src/main or src/test). Where one simple name is seen
twice, the own package wins, then the later import.

Both sides of these joins grow with the tree, and Spark's guess of their size knows nothing of
exploded lines: it would send whole sides through the driver. So they ask for a merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import extract, syntax
from lodestone.operators.graph import settle

# Words before a bracket that call nothing; what a call, a declaration and a
# declared name look like. They decide which calls count.
NO_CALL = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "require", "import")
_SITE = r"\b(?:([A-Za-z_$][\w$]*)\s*\.\s*)?([A-Za-z_$][\w$]*)\s*\("
_DECLARES = r"^\s*(?:export\s+)?(?:async\s+)?function\b|^\s*(?:export\s+)?(?:const|let|var)\b.*=>|^\s*(?:async\s+)?def\b|^\s*func\b|^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:unsafe\s+)?(?:async\s+)?fn\b"
_DECLARES_JAVA = r"^\s*(?:@\w+\s*)?(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)+[\w<>\[\],.?\s]+\("
_DECLARED = (
    r"^\s*(?:private|protected|public)\s+(?:static\s+|final\s+|transient\s+|volatile\s+)*([A-Z]\w*)(?:<[^>]*>)?\s+([a-z_]\w*)\s*[=;]",
    r"[(,]\s*([A-Z]\w*)(?:<[^>]*>)?\s+([a-z_]\w*)\s*(?=[,)])",
    r"^\s*(?:final\s+)?([A-Z]\w*)(?:<[^>]*>)?\s+([a-z_]\w*)\s*=",
)
_IMPORT = r"^\s*import\s"


def source_root(path: Column) -> Column:
    """Up to src/main or src/test; empty where there is neither."""
    return F.regexp_extract(path, r"^(.*?(?:^|/)?src/(?:main|test))/", 1)


def _simple(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def java_types(lines: DataFrame) -> DataFrame:
    """(type, path, package, simple, root): one row a Java file that declares a package."""
    package = F.regexp_extract("content", r"^\s*package\s+([A-Za-z_][\w.]*)\s*;", 1)
    per = lines.where(F.col("path").endswith(".java") & (package != "")).groupBy("path").agg(F.min_by(package, "line").alias("package"))
    simple = F.regexp_replace(F.substring_index("path", "/", -1), r"\.java$", "")
    return per.select(F.concat_ws(".", "package", simple).alias("type"), "path", "package", simple.alias("simple"), source_root(F.col("path")).alias("root"))


def java_imports(lines: DataFrame) -> DataFrame:
    """(path, line, specifier, wildcard) of Java files."""
    found = lines.where(F.col("path").endswith(".java")).select("path", "line", F.explode(extract.java_imports(F.col("content"))).alias("i"))
    return found.select("path", "line", F.col("i.specifier").alias("specifier"), F.col("i.wildcard").alias("wildcard"))


def _imported(imports: DataFrame, types: DataFrame) -> DataFrame:
    """Single imports with the type that they name, segments being left out from the end until one is known."""
    single = imports.where("NOT wildcard").select("path", "line", "specifier")
    parts = F.split("specifier", r"\.")
    every = single.select("path", "line", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("t")))).alias("x"))
    met = every.join(types.select(F.col("type").alias("t"), F.col("path").alias("target"), "simple").hint("merge"), F.col("x.t") == F.col("t"))
    return met.groupBy("path", "line").agg(F.max_by(F.struct("target", "simple"), "x.n").alias("b")).select("path", "line", F.col("b.target").alias("target"), F.col("b.simple").alias("simple"))


def _mentions(lines: DataFrame) -> DataFrame:
    """(path, simple): the words of Java files below their imports."""
    body = lines.where(F.col("path").endswith(".java") & ~F.col("content").rlike(_IMPORT))
    return body.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("simple")).distinct()


def _by_package(asked: DataFrame, types: DataFrame, words: DataFrame) -> DataFrame:
    """(path, line, target, simple): the types of a package (path, line, package) that the file mentions, under the file's
    source root. The words decide, so that a large package doesn't meet all files that import it."""
    named = asked.withColumn("root", source_root(F.col("path"))).join(words.hint("merge"), "path")
    return named.join(types.select("package", "root", F.col("path").alias("target"), "simple").hint("merge"), ["package", "root", "simple"]).select("path", "line", "target", "simple")


def wildcard_targets(lines: DataFrame, types: DataFrame) -> DataFrame:
    """(path, target): of a package that a file imports whole, the types that it mentions below its imports."""
    asked = java_imports(lines).where("wildcard").select("path", "line", F.col("specifier").alias("package")).dropDuplicates(["path", "package"])
    return _by_package(asked, types, _mentions(lines)).select("path", "target").distinct()


def java_file_imports(lines: DataFrame, types: DataFrame) -> DataFrame:
    """(src, dst): the files that a Java file depends on by its imports, but itself."""
    single = _imported(java_imports(lines), types).select("path", "target")
    both = single.union(wildcard_targets(lines, types)).where("path <> target").distinct()
    return both.withColumnsRenamed({"path": "src", "target": "dst"})


def visible_types(lines: DataFrame, types: DataFrame) -> DataFrame:
    """(path, simple, target): what a Java file may name without its package, as far as it does."""
    imports, words = java_imports(lines), _mentions(lines)
    wild = _by_package(imports.where("wildcard").select("path", "line", F.col("specifier").alias("package")), types, words)
    own = _by_package(types.select("path", F.lit(1 << 30).alias("line"), "package"), types, words)
    seen = _imported(imports, types).select("path", "line", "target", "simple").unionByName(wild).unionByName(own).where("path <> target")
    return seen.groupBy("path", "simple").agg(F.max(F.struct("line", "target")).alias("b")).select("path", "simple", F.col("b.target").alias("target"))


def dispatch_edges(lines: DataFrame, types: DataFrame) -> DataFrame:
    """(path, target, kind, line): from a Java type to what it extends or implements, if that is a file of the tree."""
    relations = syntax.type_relations(lines.where(F.col("path").endswith(".java")))
    dotted = relations.where(F.instr("to", ".") > 0).select("path", "line", "kind", F.col("to").alias("specifier"), F.lit(False).alias("wildcard"))
    full = _imported(dotted.withColumn("line", F.struct("line", "kind", "specifier")), types).select("path", F.col("line.specifier").alias("to"), F.col("line.kind").alias("kind"), F.col("line.line").alias("line"), F.col("target").alias("named"))
    met = relations.join(full.hint("merge"), ["path", "to", "kind", "line"], "left").withColumn("simple", _simple(F.col("to")))
    met = met.join(visible_types(lines, types).hint("merge"), ["path", "simple"], "left")
    target = F.coalesce("named", "target")
    return met.where(target.isNotNull() & (target != F.col("path"))).groupBy("path", target.alias("target"), "kind").agg(F.min("line").alias("line"))


def receiver_types(coded: DataFrame) -> DataFrame:
    """(path, receiver, type): declared types of a Java file's fields, parameters and locals."""
    java = coded.where(F.col("path").endswith(".java") & ~F.col("code").rlike(_IMPORT))
    found = []
    for pattern in _DECLARED:
        pairs = F.arrays_zip(F.regexp_extract_all("code", F.lit(pattern), F.lit(2)).alias("receiver"), F.regexp_extract_all("code", F.lit(pattern), F.lit(1)).alias("type"))
        found.append(pairs)
    return java.select("path", F.explode(F.concat(*found)).alias("d")).select("path", F.col("d.receiver").alias("receiver"), F.col("d.type").alias("type")).distinct()


def call_sites(coded: DataFrame) -> DataFrame:
    """(path, line, nth, receiver, name, inside): names before brackets, in code alone; `inside`: behind the line's first brace."""
    java = F.col("path").endswith(".java")
    body = coded.where(~F.col("code").rlike(_DECLARES) & ~(java & (F.col("code").rlike(_DECLARES_JAVA) | F.col("code").rlike(_IMPORT))))
    # with the text up to each site, to tell whether a brace stands before it
    sites = F.arrays_zip(F.regexp_extract_all("code", F.lit(_SITE), F.lit(1)).alias("receiver"), F.regexp_extract_all("code", F.lit(_SITE), F.lit(2)).alias("name"), F.split("code", _SITE, -1).alias("before"))
    every = body.select("path", "line", F.posexplode(F.filter(sites, lambda s: s["name"].isNotNull())).alias("nth", "s"), F.transform(sites, lambda s: F.instr(s["before"], "{") > 0).alias("braces"))
    inside = F.exists(F.slice("braces", 1, F.col("nth") + 1), lambda x: x)
    return every.select("path", "line", "nth", F.nullif("s.receiver", F.lit("")).alias("receiver"), F.col("s.name").alias("name"), inside.alias("inside")).where(~F.col("name").isin(*NO_CALL))


def call_edges(lines: DataFrame, imports: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(path, caller, callee_path, callee, line): each call with the symbols it may mean, by id.

    A Java receiver is its declared type (or the type it names): then only that type's methods
    count, of all declared types; a call whose receiver's type is known but has no such method leads nowhere. All
    others mean the first symbol of their name in their own file, else the first, by path
    and line, in an imported one. A symbol's own declaration is no call of itself."""
    types = java_types(lines) if types is None else types
    # masked and scanned once: what both give is read several times
    coded = settle(syntax.code_lines(lines))
    spanned = settle(syntax.spans(coded))
    symbols = syntax.symbols_of(spanned).select("path", "name", "line", "id")
    sites = call_sites(coded).join(syntax.scopes_of(spanned).select("path", "line", F.col("name").alias("caller_name"), F.col("around").alias("caller_line")).hint("merge"), ["path", "line"], "left")
    own_head = F.col("receiver").isNull() & (F.col("caller_line") == F.col("line")) & (F.col("caller_name") == F.col("name")) & ~F.col("inside")
    sites = settle(sites.where(~F.coalesce(own_head, F.lit(False))).withColumn("java", F.col("path").endswith(".java")))
    named = F.col("receiver").rlike("^[A-Z]")
    declared = sites.where(F.col("java") & F.col("receiver").isNotNull() & ~named).join(receiver_types(coded).hint("merge"), ["path", "receiver"])
    typed = declared.unionByName(sites.where(F.col("java") & named).withColumn("type", F.col("receiver")))
    seen = visible_types(lines, types).withColumnsRenamed({"simple": "type", "target": "callee_path"})
    callee = symbols.select(F.col("path").alias("callee_path"), "name", F.col("line").alias("callee_line"), F.col("id").alias("callee"))
    place = ["path", "line", "nth"]
    here = ["path", "line", "caller_name", "caller_line", "callee_path", "callee"]
    by_type = typed.join(seen.hint("merge"), ["path", "type"]).join(callee.hint("merge"), ["callee_path", "name"]).select(*here)
    plain = sites.join(typed.select(*place).distinct().hint("merge"), place, "left_anti")
    first = callee.groupBy("callee_path", "name").agg(F.min_by("callee", "callee_line").alias("callee"))
    own = plain.join(first.withColumnRenamed("callee_path", "path").hint("merge"), ["path", "name"], "left")
    local = own.where("callee IS NOT NULL").withColumn("callee_path", F.col("path")).select(*here)
    away = (
        own.where("callee IS NULL").drop("callee").join(imports.select(F.col("src").alias("path"), F.col("dst").alias("callee_path")).hint("merge"), "path").join(first.hint("merge"), ["callee_path", "name"])
        .groupBy("path", "line", "nth", "caller_name", "caller_line").agg(F.min(F.struct("callee_path", "callee")).alias("b"))
        .select("path", "line", "caller_name", "caller_line", F.col("b.callee_path").alias("callee_path"), F.col("b.callee").alias("callee"))
    )
    every = by_type.unionByName(local).unionByName(away)
    caller = F.when(F.col("caller_line").isNotNull(), syntax.symbol_id("path", "caller_name", "caller_line"))
    return every.select("path", caller.alias("caller"), "callee_path", "callee", "line").distinct()
