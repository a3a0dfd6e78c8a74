"""Symbols with their spans, and type relations, from source text as it is nested.

A file's lines pass once through a scanner that knows comments, strings, braces and
indentation, in order, with the open definitions on a stack: so nothing in a comment
or string counts, and every symbol gets its last line and the symbol around it. Lines are brought together
by path in one exchange; Spark's expressions do the matching of names between two
narrow passes over the same sorted partitions. A task holds one batch of lines and
the open definitions, whatever a file's length. Joins ask for a merge: Spark's guess of
a side's size knows nothing of exploded lines and would send it through the driver.

Languages: Python by indentation; Java, TypeScript and JavaScript by braces. What is
a symbol: functions, methods (within a class), classes, types (interface, enum,
type alias), and functions bound to a name. An empty table gives no rows."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPTS = r"\.(?:ts|tsx|js|jsx|mts|cts|mjs|cjs|vue)$"
_NAME = r"[A-Za-z_$][\w$]*"

#: Where something begins that isn't code, and where it ends.
_BEGINS = {
    "py": re.compile(r"#|\"\"\"|'''|\"|'"),
    "java": re.compile(r"//|/\*|\"\"\"|\"|'"),
    "js": re.compile(r"//|/\*|\"|'|`"),
}
_ENDS = {"/*": "*/", '"""': '"""', "'''": "'''", "`": "`", '"': '"', "'": "'"}


def family(path: str) -> str:
    return "py" if path.endswith(".py") else "java" if path.endswith((".java", ".cs")) else "js"


def _code(text: str, kind: str, inside: str | None) -> tuple[str, str | None]:
    """A line with blanks for comments and strings, and what it ends inside of."""
    out, at = [], 0
    while at < len(text):
        if inside is None:
            m = _BEGINS[kind].search(text, at)
            if not m:
                out.append(text[at:])
                break
            out.append(text[at : m.start()])
            at, inside = m.start(), m.group()
            if inside in ("#", "//"):
                out.append(" " * (len(text) - at))
                return "".join(out), None
            out.append(" " * len(inside))
            at = m.end()
        end = _ENDS[inside]
        stop = at
        while (stop := text.find(end, stop)) >= 0 and inside != "/*" and _escaped(text, stop, at):
            stop += 1
        upto = len(text) if stop < 0 else stop + len(end)
        out.append(" " * (upto - at))
        at = upto
        if stop >= 0:
            inside = None
    return "".join(out), inside if inside not in ('"', "'") else None


def _escaped(text: str, at: int, start: int) -> bool:
    n = 0
    while at - n > start and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = inside = kind = None
    for batch in batches:
        paths, lines, texts = (batch.column(k).to_pylist() for k in range(3))
        codes = []
        for p, text in zip(paths, texts):
            if p != path:
                path, inside, kind = p, None, family(p)
            code, inside = _code(text or "", kind, inside)
            codes.append(code)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(codes, pa.string())], names=["path", "line", "content", "code"])


def code_lines(lines: DataFrame) -> DataFrame:
    """Lines (path, line, content) with `code`: comments and strings blank, columns in place; sorted within partitions."""
    ordered = lines.select("path", F.col("line").cast("int").alias("line"), "content").repartition("path").sortWithinPartitions("path", "line")
    return ordered.mapInArrow(_mask, "path string, line int, content string, code string")


_BEFORE = r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:export|default|declare|public|private|protected|static|abstract|final|sealed|async|readonly|override|synchronized|native|strictfp)\s+)*"
_TYPE = rf"^\s*{_BEFORE}(class|interface|enum|record|@interface|type)\s+({_NAME})\b"
_FUNCTION = rf"^\s*{_BEFORE}function\s*\*?\s*({_NAME})"
_BOUND = rf"^\s*{_BEFORE}(?:const|let|var)\s+({_NAME})\b[^=]*=\s*(?:async\s+)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]*)?=>|{_NAME}\s*=>)"
_METHOD_JS = rf"^\s*{_BEFORE}(?:(?:get|set)\s+)?\*?\s*(#?{_NAME})\s*(?:<[^>]*>)?\s*\("
_METHOD_JAVA = rf"^\s*{_BEFORE}(?:default\s+)?(?:<[^(]*>\s+)?(?:[\w.$]+(?:<[^(]*>)?(?:\s*\[\s*\])*\s+)?({_NAME})\s*\("
_PYTHON = rf"^\s*(?:async\s+)?(def|class)\s+({_NAME})"
#: Words that a bracket may follow without a method being declared.
_NO_METHOD = ("if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "do", "try", "super", "this", "function", "synchronized", "await", "typeof", "assert")


def _found(coded: DataFrame) -> DataFrame:
    """What a line may define, as columns `what` and `name`, or null. A method counts only directly in a class.

    Each pattern runs once, in a column of its own, and only over lines that hold what it can't do without."""
    path, code = F.col("path"), F.col("code")
    script, python = path.rlike(SCRIPTS), path.endswith(".py")
    group = lambda pattern, k: F.regexp_extract(code, pattern, k)
    both = lambda pattern: F.struct(group(pattern, 1).alias("word"), group(pattern, 2).alias("name"))
    holds = lambda *words: reduce(or_, (F.contains(code, F.lit(w)) for w in words))
    bracket = holds("(")
    rows = coded.withColumns({
        "py": F.when(python & holds("def", "class"), both(_PYTHON)),
        "type": F.when(~python & holds("class", "interface", "enum", "record", "type"), both(_TYPE)),
        "function": F.when(script & holds("function"), group(_FUNCTION, 1)),
        "bound": F.when(script & holds("="), group(_BOUND, 1)),
        "method": F.when(~python & bracket, F.when(script, group(_METHOD_JS, 1)).otherwise(group(_METHOD_JAVA, 1))),
    })
    word, method = F.col("type.word"), F.col("method")
    kind = F.when(word.isin("class", "record"), "class").when((word != "") & ((word != "type") | script), "type")
    braces = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.col("type.name").alias("name")))
    for column, is_one in (("function", F.col("function") != ""), ("bound", F.col("bound") != ""), ("method", (method != "") & ~method.isin(*_NO_METHOD))):
        braces = braces.when(is_one, F.struct(F.lit("method" if column == "method" else "function").alias("kind"), F.col(column).alias("name")))
    of_python = F.when(F.col("py.word") == "def", "function").when(F.col("py.word") == "class", "class")
    found = F.when(python, F.when(of_python.isNotNull(), F.struct(of_python.alias("kind"), F.col("py.name").alias("name")))).otherwise(braces)
    return rows.withColumn("found", found).select("*", F.col("found.kind").alias("what"), F.col("found.name").alias("name"))


class _Open:
    __slots__ = ("kind", "name", "line", "indent", "body", "brackets", "around", "last")

    def __init__(self, kind: str, name: str, line: int, indent: int, brackets: int, around: _Open | None):
        self.kind, self.name, self.line, self.indent, self.brackets, self.around = kind, name, line, indent, brackets, around
        self.body: int | None = None  # depth of braces inside, once they are open
        self.last = line


_SPANS = "path string, kind string, name string, line int, end int, around int"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, kind, name, line, end, line of the symbol around): emitted as symbols end; and
    for lines with a bracket a row of kind `scope`: the innermost symbol that contains the line, `around` being its line."""
    path, stack, depth, brackets, done, kind = None, [], 0, 0, [], None

    def close(until: int, end: int | None = None) -> None:
        while len(stack) > until:
            s = stack.pop()
            done.append((path, s.kind, s.name, s.line, s.last if end is None else end, s.around.line if s.around else None))

    for batch in batches:
        for p, line, indent, blank, marks, arrow, what, name in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if p != path:
                close(0)
                path, depth, brackets, kind = p, 0, 0, family(p)
            top = stack[-1] if stack else None
            if kind == "py":
                if not blank and brackets == 0:
                    keep = len(stack)
                    while keep and stack[keep - 1].indent >= indent:
                        keep -= 1
                    close(keep)
                    if what:
                        inside = any(s.kind == "class" for s in stack)
                        stack.append(_Open("method" if what == "function" and inside else what, name, line, indent, 0, stack[-1] if stack else None))
                if not blank:
                    for s in stack:
                        s.last = line
                if stack and "(" in marks:
                    done.append((path, "scope", stack[-1].name, line, line, stack[-1].line))
                brackets = max(0, brackets + marks.count("(") - marks.count(")"))
                continue
            if what:
                if top and top.body is None and top.line < line and brackets <= top.brackets:
                    close(len(stack) - 1)  # bound without braces or semicolon
                    top = stack[-1] if stack else None
                direct = top is not None and top.kind in ("class", "type") and top.body == depth
                if what != "method" or direct:
                    stack.append(_Open(what, name, line, 0, brackets, top))
            for s in stack:
                s.last = line
            if stack and "(" in marks:
                done.append((path, "scope", stack[-1].name, line, line, stack[-1].line))
            for mark in marks:
                if mark == "(":
                    brackets += 1
                elif mark == ")":
                    brackets -= 1
                elif mark == "{":
                    depth += 1
                    if stack and stack[-1].body is None and stack[-1].brackets == brackets:
                        stack[-1].body = depth
                elif mark == "}":
                    depth -= 1
                    while stack and stack[-1].body is not None and stack[-1].body > depth:
                        close(len(stack) - 1, line)
                elif stack and stack[-1].body is None and stack[-1].brackets == brackets:
                    close(len(stack) - 1, line)
            if arrow and stack and stack[-1].body is None and stack[-1].line == line and stack[-1].brackets == brackets:
                close(len(stack) - 1, line)
        if len(done) >= 10_000:
            yield _batch(done)
            done = []
    close(0)
    if done:
        yield _batch(done)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "kind", "name", "line", "end", "around"])


def _scanned(coded: DataFrame) -> DataFrame:
    marks = F.regexp_replace(F.translate("code", "[]", "()"), r"[^{};()]", "")
    python = F.regexp_replace(F.translate("code", "[]{}", "()()"), r"[^()]", "")
    return _found(coded).select(
        "path", "line", (F.length("code") - F.length(F.ltrim("code"))).alias("indent"), (F.trim("content") == "").alias("blank"),
        F.when(F.col("path").endswith(".py"), python).otherwise(F.when(F.col("path").rlike(SCRIPTS), F.regexp_replace("code", r"[^{};()]", "")).otherwise(marks)).alias("marks"),
        F.col("code").rlike(r"=>\s*[^\s{(]").alias("arrow"), "what", "name",
    )


def symbols(lines: DataFrame) -> DataFrame:
    """(path, kind, name, line, end, around, id): symbols of lines (path, line, content) with the line of the symbol around each."""
    return symbols_of(spans(code_lines(lines)))


def symbols_of(spanned: DataFrame) -> DataFrame:
    return spanned.where("kind <> 'scope'").withColumn("id", symbol_id("path", "name", "line"))


def symbol_id(path: str, name: str, line: str) -> Column:
    return F.concat_ws(":", F.lit("symbol"), path, name, line)


def scopes(lines: DataFrame) -> DataFrame:
    """(path, line, name, around): the innermost symbol that contains each line with a bracket, and where it begins."""
    return scopes_of(spans(code_lines(lines)))


def scopes_of(spanned: DataFrame) -> DataFrame:
    return spanned.where("kind = 'scope'").select("path", "line", "name", "around")


def spans(coded: DataFrame) -> DataFrame:
    """Symbols and scopes of code_lines, in one pass, for those who need both."""
    return _scanned(coded).mapInArrow(_spans, _SPANS)


def _without_generics(head: Column) -> Column:
    for _ in range(4):
        head = F.regexp_replace(head, r"<[^<>]*>", " ")
    return head


def _heads(most: int):
    """(path, start, head): the code of each line that starts a class and of those after it, `most` numbers
    in all, put together in one pass over a file's lines in order; lines are held only until the next start is complete.
    Rows of one line number are ordered by their code, and come as often as rows there start a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4))))
        out, size = [], 0
        for path, of_file in groupby(rows, itemgetter(0)):
            near, begun = deque(), deque()  # (line, its codes), (line, its starts)
            for line, alike in chain(groupby(of_file, itemgetter(1)), [(math.inf, ())]):
                if line is None:
                    continue
                while begun and begun[0][0] + most <= line:
                    start, times = begun.popleft()
                    head = " ".join(code for at, codes in near if start <= at < start + most for code in codes for _ in range(times))
                    out.append((path, start, head))
                    size += len(head)
                first = begun[0][0] if begun else line
                while near and near[0][0] < first:
                    near.popleft()
                here = sorted((code, starts) for _, _, code, starts in alike)
                near.append((line, [code for code, _ in here]))
                if times := sum(starts for _, starts in here):
                    begun.append((line, times))
                if size >= 1_000_000:
                    yield _head_rows(out)
                    out, size = [], 0
        if out:
            yield _head_rows(out)

    return run


def _head_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["path", "start", "head"])


def type_relations(lines: DataFrame, most: int = 12) -> DataFrame:
    """(path, owner, line, kind, to): the names behind `extends` and `implements` of a class's
    head, which ends at its brace within `most` lines, and a Python class's bases. Generics are left out;
    a dotted name stays whole."""
    c = F.col("code")
    python = F.col("path").endswith(".py")
    starts = F.when(python, c.rlike(rf"^\s*class\s+{_NAME}")).otherwise(c.rlike(_TYPE))
    texts = code_lines(lines).select("path", "line", "code", starts.alias("starts")).mapInArrow(_heads(most), "path string, start int, head string")
    head = _without_generics(F.regexp_extract("head", r"^([^{;]*)", 1))
    owner = F.when(python, F.regexp_extract("head", rf"\bclass\s+({_NAME})", 1)).otherwise(F.regexp_extract(head, rf"\b(?:class|interface|enum|record|type)\s+({_NAME})", 1))
    bases = F.when(python, F.regexp_extract("head", rf"\bclass\s+{_NAME}\s*\(([^)]*)\)\s*:", 1)).otherwise(F.regexp_extract(head, r"\bextends\b(.*?)(?:\bimplements\b|$)", 1))
    implemented = F.when(python, F.lit("")).otherwise(F.regexp_extract(head, r"\bimplements\b(.*?)(?:\bextends\b|$)", 1))
    names = lambda text, kind: F.transform(F.split(text, ","), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("to")))
    # a name that comes twice does so within one head
    every = texts.select("path", owner.alias("owner"), F.col("start").alias("line"), F.explode(F.array_distinct(F.concat(names(bases, "extends"), names(implemented, "implements")))).alias("r"))
    good = F.col("r.to").rlike(rf"^{_NAME}(?:\.{_NAME})*$") & (F.substring_index("r.to", ".", -1) != F.col("owner"))
    return every.where(good).select("path", "owner", "line", F.col("r.kind").alias("kind"), F.col("r.to").alias("to"))


def resolved_types(relations: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Relations with `to_file`, where the name is declared: in the same file, else in the only file that declares it;
    `ambiguous` is the number of files where several others do."""
    # both joins read the types through one exchange: distinct rows, and without the nulls that each join would filter for itself
    types = symbols_.where(F.col("kind").isin("class", "type") & F.col("name").isNotNull() & F.col("path").isNotNull()).select("name", F.col("path").alias("declared")).distinct()
    per = types.groupBy("name").agg(F.count("declared").alias("n"), F.min("declared").alias("only"))
    own = types.withColumn("here", F.lit(True))
    simple = relations.withColumn("simple", F.substring_index("to", ".", -1))
    met = simple.join(per.hint("merge"), simple["simple"] == per["name"], "left").drop("name").join(own.hint("merge"), (F.col("simple") == own["name"]) & (F.col("path") == own["declared"]), "left").drop("name", "declared")
    file = F.when(F.col("here"), F.col("path")).when(F.col("n") == 1, F.col("only"))
    several = F.when(F.col("here").isNull() & (F.col("n") > 1), F.col("n"))
    return met.select("path", "owner", "line", "kind", "to", file.alias("to_file"), several.alias("ambiguous"))
