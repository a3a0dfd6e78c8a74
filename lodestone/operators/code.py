"""The code graph: lines of source, symbols with their ends, imports, calls and roles.

Everything works on relations: `lines` (path, line from 1, content), `files` (path),
`symbols` (path, name, line, end), `imports` (src, dst) and `calls` (path, line,
receiver, name). Joins by name are always narrowed by a file, so that a name
found everywhere doesn't meet itself."""

from __future__ import annotations

import keyword
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions import text as T
from lodestone.operators.graph import reachable, settle

#: Words before a bracket that call nothing: Python's keywords and the statements of the C family.
STATEMENTS = frozenset(keyword.kwlist) | frozenset("catch do foreach function lock new require sizeof super switch synchronized throw typeof using".split())

_NAME = r"[A-Za-z_]\w*"
_BEFORE = r"(?:(?:export|default|public|private|protected|static|abstract|final|async)\s+)*"
#: A definition: what is defined by a keyword, and functions bound to a name.
DEFINED = rf"^\s*{_BEFORE}(class|interface|def|function|func|fn)\s+\*?({_NAME})"
BOUND = rf"^\s*{_BEFORE}(?:const|let|var)\s+({_NAME})\s*=\s*(?:async\s+)?(?:\([^)]*\)|{_NAME})\s*=>"
SITE = rf"(?:({_NAME})\s*\.\s*)?\b({_NAME})\s*\("


def kind_and_name(content: Column) -> tuple[Column, Column]:
    word, name = F.regexp_extract(content, DEFINED, 1), F.regexp_extract(content, DEFINED, 2)
    bound = F.regexp_extract(content, BOUND, 1)
    kind = F.when(word.isin("class", "interface"), "class").when(word != "", "function").when(bound != "", "function")
    return kind, F.when(word != "", name).when(bound != "", bound)


def indent(content: Column) -> Column:
    return F.length(content) - F.length(F.ltrim(content))


def _braces(content: Column) -> Column:
    return F.length(F.regexp_replace(content, "[^{]", "")) - F.length(F.regexp_replace(content, "[^}]", ""))


_SPANS = "path string, kind string, name string, line int, end int"


def _ends(most: int, with_lines: bool):
    """Definitions with their last lines, in one pass over a file's lines in order; what is open is held, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, depth, last, out = None, [], 0, 0, []  # held: (kind, name, line, indent or depth before its braces)

        def close() -> None:
            # at the end of a file: Python's go to its last line, others have no end but their own line
            out.extend((path, k, n, at, last if path.endswith(".py") else at) for k, n, at, _ in held)

        for batch in batches:
            for p, line, kind, name, indent, braces, full, opened in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if p != path:
                    close() if path else None
                    path, held, depth = p, [], 0
                depth, last = depth + braces, line
                if path.endswith(".py"):
                    while full and held and held[-1][3] >= indent:
                        k, n, at, _ = held.pop()
                        out.append((path, k, n, at, line - 1))
                    if name is not None:
                        held.append((kind, name, line, indent))
                else:
                    ended = [h for h in held if depth <= h[3] or line >= h[2] + most]
                    if ended:
                        out.extend((path, k, n, at, line if line < at + most else at) for k, n, at, _ in ended)
                        held = [h for h in held if not (depth <= h[3] or line >= h[2] + most)]
                    if name is not None and opened:
                        held.append((kind, name, line, depth - braces))
                    elif name is not None:
                        out.append((path, kind, name, line, line))
            if with_lines:
                none = pa.nulls(len(batch), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), none, none, batch.column(1), none.cast(pa.int32())], names=["path", "kind", "name", "line", "end"])
            if len(out) > 10_000:
                yield _rows(out)
                out.clear()
        close() if path else None
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["path", "kind", "name", "line", "end"])


def symbols(lines: DataFrame, most: int = 200, with_lines: bool = False) -> DataFrame:
    """(path, kind, name, line, end). A Python symbol ends before the next line that is
    indented no deeper. Others end where the braces opened on their line are closed
    again, within `most` lines; without a brace they end on their own line, but for an
    arrow at its end, whose body is looked for on the next ones. With_lines gives each
    line, too, as a row without kind, name and end: for those who need both, from one reading."""
    kind, name = kind_and_name(F.col("content"))
    open_ended = (_braces(F.col("content")) > 0) | F.col("content").rlike(r"^[^{]*=>\s*$")
    rows = lines.select(
        "path", F.col("line").cast("int").alias("line"), kind.alias("kind"), name.alias("name"), indent(F.col("content")).alias("indent"), _braces(F.col("content")).alias("braces"),
        (F.trim("content") != "").alias("full"), open_ended.alias("open"),
    )
    return rows.repartition("path").sortWithinPartitions("path", "line").mapInArrow(_ends(most, with_lines), _SPANS)


def call_sites(lines: DataFrame) -> DataFrame:
    """(path, line, receiver, name) of each name before a bracket, but for statements and on lines of definitions."""
    body = lines.where(kind_and_name(F.col("content"))[1].isNull())
    pairs = F.arrays_zip(
        F.regexp_extract_all("content", F.lit(SITE), F.lit(1)).alias("receiver"), F.regexp_extract_all("content", F.lit(SITE), F.lit(2)).alias("name")
    )
    sites = body.select("path", "line", F.posexplode(pairs).alias("nth", "site")).select("path", "line", "nth", F.nullif("site.receiver", F.lit("")).alias("receiver"), F.col("site.name").alias("name"))
    return sites.where(~F.col("name").isin(*sorted(STATEMENTS)))


def python_imports(lines: DataFrame) -> DataFrame:
    """(path, specifier): `from a.b import c` names a.b; `import a.b as x, c` names a.b and c."""
    c = F.col("content")
    source = F.regexp_extract(c, r"^\s*from\s+([.\w]+)\s+import\b", 1)
    several = F.regexp_extract(c, r"^\s*import\s+([\w., \t]+?)\s*(?:#.*)?$", 1)
    names = F.transform(F.split(several, ","), lambda x: F.regexp_extract(x, r"^\s*([\w.]+)", 1))
    specs = F.when(source != "", F.array(source)).when(several != "", F.filter(names, lambda x: x != ""))
    return lines.where(specs.isNotNull()).select("path", F.explode(specs).alias("specifier")).distinct()


def resolve_first(specs: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """Each row of specs with `target`, the first of its candidate paths that is a file; null if none is."""
    rows = specs.withColumn("__row", F.struct(*specs.columns))
    every = rows.select("__row", F.posexplode(candidates).alias("__nth", "__path"))
    hits = every.join(files.select(F.col("path").alias("__path")).distinct(), "__path").groupBy("__row").agg(F.min_by("__path", "__nth").alias("target"))
    return rows.join(hits, "__row", "left").drop("__row")


def module_candidates(specifier: Column) -> Column:
    base = F.replace(specifier, F.lit("."), F.lit("/"))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


#: Endings that a script's specifier may lack, in the order in which they are tried.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx")
#: What may stand behind the run-time endings of script specifiers.
COMPILED = {".js": (".ts", ".tsx"), ".mjs": (".mts",), ".cjs": (".cts",), ".jsx": (".tsx",)}


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path laid on a folder, with . and .. resolved."""
    parts = F.split(F.concat_ws("/", folder, relative), "/")
    walk = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.array_join(walk, "/")


def script_candidates(path: Column, specifier: Column) -> Column:
    """Paths that a relative script specifier may mean: as written, compiled from, with an ending, or a folder's index."""
    base = joined_path(F.nullif(T.dirname(path), F.lit(".")), specifier)
    rewritten = F.array().cast("array<string>")
    for ending, sources in COMPILED.items():
        stem = F.left(base, F.length(base) - len(ending))
        rewritten = F.when(base.endswith(ending), F.array(*[F.concat(stem, F.lit(s)) for s in sources])).otherwise(rewritten)
    ends = [F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS] + [F.concat(base, F.lit(f"/index{e}")) for e in SCRIPT_ENDINGS]
    return F.concat(F.array(base), rewritten, F.array(*ends))


#: As many symbols of imported files are broadcast; more are met by a merge. It decides about speed only.
FEW = 200_000


def call_targets(sites: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, name, callee_path, callee_line): what each name that a file calls means: the first symbol of
    that name in the file, else the first in an imported one. Names that mean nothing are left out.
    A name is looked up once a file, however often it is called."""
    # kept, as several readers would each scan the lines again
    first = settle(symbols.groupBy("path", "name").agg(F.min("line").alias("callee_line")))
    imports = settle(imports.select(F.col("src").alias("path"), "dst").distinct())
    there = first.join(imports.select(F.col("dst").alias("path")).distinct(), "path", "left_semi").withColumnsRenamed({"path": "dst", "callee_line": "there_line"})
    there = settle(there)
    there = F.broadcast(there) if there.count() <= FEW else there.hint("merge")
    unmet = sites.select("path", "name").distinct().join(first, ["path", "name"], "left_anti")
    away = unmet.join(imports, "path").join(there, ["dst", "name"]).groupBy("path", "name").agg(F.min(F.struct("dst", "there_line")).alias("hit"))
    own = first.select("path", "name", F.col("path").alias("callee_path"), "callee_line")
    return own.unionByName(away.select("path", "name", F.col("hit.dst").alias("callee_path"), F.col("hit.there_line").alias("callee_line")))


def resolved_calls(sites: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, line, nth, name, callee_path, callee_line): calls with the symbol that they mean. Calls that resolve to nothing are left out."""
    met = sites.select("path", "line", "nth", "name").join(call_targets(sites, symbols, imports), ["path", "name"])
    return met.select("path", "line", "nth", "name", "callee_path", "callee_line")


def call_edges(sites: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, line, nth, name, caller, callee_path, callee_line): resolved calls with the caller, the last symbol of
    the file, by line, that contains the call."""
    return enclosing(resolved_calls(sites, symbols, imports), symbols)


def _callers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points and symbols of a file in order of lines: the symbols that haven't ended are on a stack."""
    path, stack = None, []
    for batch in batches:
        points, callers = [], []
        for at, (p, line, end, name) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
            if p != path:
                path, stack = p, []
            if end is not None:
                stack.append((end, name))
                continue
            while stack and stack[-1][0] < line:
                stack.pop()
            points.append(at)
            callers.append(stack[-1][1] if stack else None)
        yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(points, pa.int32())), pa.array(callers, pa.string())], names=["p", "caller"])


def enclosing(points: DataFrame | None, symbols: DataFrame) -> DataFrame:
    """The rows (path, line, ...) with `caller`, the name of the last symbol by line that contains
    the line: one pass over both in order, with the open symbols on a stack. Without points they are
    the lines that came with the symbols."""
    in_order = lambda rows: rows.repartition("path").sortWithinPartitions("path", "line", F.col("end").asc_nulls_last(), "name")
    spans = symbols.select("path", F.col("line").cast("int").alias("line"), F.col("end").cast("int").alias("end"), "name")
    if points is None:
        both = in_order(spans).withColumn("p", F.struct("path", "line"))
    else:
        rows = points.select("path", F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("name"), F.struct(*points.columns).alias("p"))
        both = in_order(spans.withColumn("p", F.lit(None).cast(rows.schema["p"].dataType)).unionByName(rows))
    kind = StructType([StructField("p", both.schema["p"].dataType), StructField("caller", StringType())])
    return both.mapInArrow(_callers, kind).select("p.*", "caller")


def file_edges(imports: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst): distinct dependencies of files on others, by import or call (call edges or targets)."""
    called = calls.select(F.col("path").alias("src"), F.col("callee_path").alias("dst"))
    return imports.select("src", "dst").union(called).where("src <> dst").distinct()


def entry_dependencies(edges: DataFrame, entries: DataFrame, dispatch: DataFrame) -> DataFrame:
    """(path): what entries depend on directly, and all that follows from there by dispatch (src, dst) alone."""
    first = edges.join(entries.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return reachable(dispatch, first).select(F.col("node").alias("path")).distinct()


# Words of file names that tell infrastructure, and words that only look like them.
INFRA = (
    "config setting env credential secret database db store storage sql mysql postgres redis mongo cache queue kafka mq scheduler "
    "log logging observability telemetry metric monitor http client sdk gateway proxy webhook docker deploy bootstrap conftest"
).split()
NOT_INFRA = "login logins logout logouts logic logical".split()


def infra_hint(path: Column) -> Column:
    """The first infrastructure word that starts a word of the file's name; null if none does."""
    words = F.filter(F.split(F.lower(F.regexp_replace(T.basename(path), "(?<=[A-Za-z0-9])(?=[A-Z])", " ")), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*NOT_INFRA))
    hits = F.filter(F.array(*map(F.lit, INFRA)), lambda h: F.exists(words, lambda w: F.startswith(w, h)))
    return F.get(hits, F.lit(0))


def roles(files: DataFrame, edges: DataFrame, entries: DataFrame, dispatch: DataFrame) -> DataFrame:
    """(path, role), the first that holds: test, core (an entry), infra (by name), core (an entry
    depends on it), tool (no edge and no dispatch touches it), support."""
    mark = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    ends = lambda df: df.select(F.explode(F.array("src", "dst")).alias("path"))
    flagged = (
        files.select("path").distinct().join(mark(entries, "entry"), "path", "left").join(mark(entry_dependencies(edges, entries, dispatch), "needed"), "path", "left")
        .join(mark(ends(edges).union(ends(dispatch)), "linked"), "path", "left")
    )
    p = F.col("path")
    role = (
        F.when(T.is_test_path(p), "test").when(F.col("entry"), "core").when(infra_hint(p).isNotNull(), "infra").when(F.col("needed"), "core")
        .when(F.col("linked").isNull(), "tool").otherwise("support")
    )
    return flagged.select("path", role.alias("role"))


def impact_order(edges: DataFrame, changed: str, most: int = 4) -> DataFrame:
    """(path, priority): the changed file, then its direct dependents by name, then what else it reaches backwards."""
    spark = edges.sparkSession
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = reachable(back, spark.createDataFrame([(changed,)], "node string")).select("node")
    direct = edges.where(F.col("dst") == changed).select(F.col("src").alias("node"), F.lit(1).alias("near")).distinct()
    ranked = seen.join(direct, "node", "left").select(F.col("node").alias("path"), F.when(F.col("node") == changed, 0).otherwise(F.coalesce("near", F.lit(2))).alias("priority"))
    return ranked.orderBy("priority", "path").limit(most)


def slices(files: DataFrame, edges: DataFrame, symbols: DataFrame, top: int = 8, each: int = 6) -> DataFrame:
    """(path, symbols, uses, used_by): a file's first symbols by line and its first dependencies each way by name."""
    few = lambda col: F.slice(F.sort_array(F.collect_set(col)), 1, each)
    uses = edges.groupBy(F.col("src").alias("path")).agg(few("dst").alias("uses"))
    used = edges.groupBy(F.col("dst").alias("path")).agg(few("src").alias("used_by"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line", "name"))
    first = symbols.withColumn("nth", nth).where(F.col("nth") <= top).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "name"))), lambda s: s["name"]).alias("symbols"))
    none = F.array().cast("array<string>")
    out = files.select("path").join(first, "path", "left").join(uses, "path", "left").join(used, "path", "left")
    return out.select("path", *[F.coalesce(c, none).alias(c) for c in ("symbols", "uses", "used_by")])


def cite(citations: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, line, verdict, target): a cited path is the file of that name, else the only file
    that ends in it; several are ambiguous, none is missing, and a line past the end is out of range. Files are (path, lines)."""
    exact = citations.join(files.select("path", F.col("path").alias("whole"), F.col("lines").alias("whole_lines")), "path", "left")
    parts = F.split("path", "/")
    tails = files.select("path", "lines", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("tail")).where("tail <> ''")
    # a tail that many files share is counted, not joined row by row
    by_tail = tails.groupBy("tail").agg(F.count("*").alias("n"), F.min(F.struct("path", "lines")).alias("only"))
    met = exact.join(by_tail.withColumnRenamed("tail", "path"), "path", "left")
    target = F.coalesce("whole", F.when(F.col("n") == 1, F.col("only.path")))
    last = F.coalesce("whole_lines", F.when(F.col("n") == 1, F.col("only.lines")))
    verdict = (
        F.when(target.isNull() & (F.col("n") > 1), F.concat(F.lit("ambiguous "), F.col("n").cast("string"))).when(target.isNull(), "missing")
        .when(F.col("line").isNotNull() & ((F.col("line") < 1) | (F.col("line") > last)), "out of range").otherwise("found")
    )
    return met.select("id", "path", "line", verdict.alias("verdict"), target.alias("target"))


def declared_at(names: DataFrame, types: DataFrame) -> DataFrame:
    """(path, name, target, ambiguous): a type's name means the one in its own file, else the only
    one there is; of several none is chosen and their files are listed. Types are (path, name)."""
    own = types.select("path", "name").distinct().withColumn("own", F.lit(True))
    every = types.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("files"))
    met = names.join(own, ["path", "name"], "left").join(every, "name", "left")
    one = F.size(F.coalesce("files", F.array().cast("array<string>"))) == 1
    target = F.when(F.col("own"), F.col("path")).when(one, F.get("files", F.lit(0)))
    return met.select("path", "name", target.alias("target"), F.when(target.isNull() & (F.size("files") > 1), F.col("files")).alias("ambiguous"))


def signal(lines: DataFrame) -> DataFrame:
    """(path, line, signal): 3 for control flow within three lines, 2 for a line with several calls
    or an assignment that calls, less 3 for a lone call or assignment."""
    near = F.concat_ws(" ", F.collect_list("content").over(Window.partitionBy("path").orderBy("line").rowsBetween(-3, 3)))
    c = F.col("content")
    control = F.when(near.rlike(r"\b(if|for|while|try|catch|synchronized)\b"), 3).otherwise(0)
    several = (F.length(c) - F.length(F.replace(c, F.lit("("), F.lit(""))) >= 2) | (F.contains(c, F.lit("=")) & c.rlike(r"\w+\("))
    alone = c.rlike(r"^\s*[\w.]+\([^)]*\)\s*;?\s*$") | c.rlike(r"^\s*[\w.]+\s*=\s*[^=]")
    return lines.select("path", "line", (control + F.when(several, 2).otherwise(0) - F.when(alone, 3).otherwise(0)).alias("signal"))
