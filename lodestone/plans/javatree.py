"""Symbols, types and calls over a Java tree written from `part`: each part K is a file TK.java,
fifty to a package, every seventh under src/test. It imports the next type by name and a
package whole, extends and implements others, and calls through a field and by type."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import calls, syntax
from lodestone.plans.registry import query, table

#: A file's lines; {+N} is the number of the Nth next part, {pN} its package, {mN} its number modulo 5.
FILE = (
    "package com.acme.p{p0};", "import com.acme.p{p1}.T{+1};", "import com.acme.p{p2}.*;",
    "public class T{+0} extends T{+20} implements I, T{+2}<T{+1}> {", "  private final T{+1} a = null; /* void no() { */", "  public int m{m0}(int n) {", "    a.m{m1}(n);",
    "    T{+2}.m0(n);", '    return m{m0}(n) + h(n) + "h(n) {";', "  }", "  int h(int n) { return n; }", "  // T{+22} b; b.m0(1);", "}",
)


def _root(k):
    return F.when(k % 7 == 0, "src/test").otherwise("src/main")


def _lines(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(_root(k), F.lit("/java/com/acme/p"), F.floor(k / 50).cast("string"), F.lit("/T"), k.cast("string"), F.lit(".java"))

    def line(text):
        out = F.lit(text)
        for n in (0, 1, 2, 20, 22):
            for mark, value in ((f"{{+{n}}}", k + n), (f"{{p{n}}}", F.floor((k + n) / 50)), (f"{{m{n}}}", (k + n) % 5)):
                if mark in text:
                    out = F.replace(out, F.lit(mark), value.cast("string"))
        return out

    files = table(spark, sf_dir, "part").select("p_partkey").distinct()
    return files.select(path.alias("path"), F.posexplode(F.array(*map(line, FILE))).alias("at", "content")).select("path", (F.col("at") + 1).alias("line"), "content")


_SRC = """WITH t AS (SELECT DISTINCT p_partkey AS k, p_partkey // 50 AS p, CASE WHEN p_partkey % 7 = 0 THEN 'src/test' ELSE 'src/main' END AS root FROM part),
f AS (SELECT *, root || '/java/com/acme/p' || p || '/T' || k || '.java' AS path FROM t),
seen AS (SELECT a.k, b.k AS o FROM f a JOIN f b ON b.k IN (a.k + 1, a.k + 2, a.k + 20, a.k + 22) WHERE b.k = a.k + 1 OR (b.root = a.root AND b.p IN (a.p, (a.k + 2) // 50))) """


@query(_SRC + """SELECT path, kind, name, CAST(line AS INTEGER) AS line, CAST("end" AS INTEGER) AS "end", 'symbol:' || path || ':' || name || ':' || line AS id FROM (
  SELECT path, 'class' AS kind, 'T' || k AS name, 4 AS line, 13 AS "end" FROM f UNION ALL SELECT path, 'method', 'm' || (k % 5), 6, 10 FROM f UNION ALL SELECT path, 'method', 'h', 11, 11 FROM f)""")
def x01_symbols(spark, sf_dir):
    return syntax.symbols(_lines(spark, sf_dir)).select("path", "kind", "name", "line", "end", "id")


@query(_SRC + """SELECT a.path, 'T' || a.k AS owner, kind, 'T' || (a.k + n) AS "to", b.path AS to_file FROM f a, (VALUES ('extends', 20), ('implements', 2)) x(kind, n) LEFT JOIN f b ON b.k = a.k + n
UNION ALL SELECT path, 'T' || k, 'implements', 'I', NULL FROM f""")
def x17_type_relations(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return syntax.resolved_types(syntax.type_relations(lines), syntax.symbols(lines)).select("path", "owner", "kind", "to", "to_file")


@query(_SRC + """SELECT a.path, b.path AS target, CASE s.o - s.k WHEN 20 THEN 'extends' ELSE 'implements' END AS kind, 4 AS line FROM seen s JOIN f a ON a.k = s.k JOIN f b ON b.k = s.o WHERE s.o - s.k IN (2, 20)""")
def x13_dispatch_edges(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return calls.dispatch_edges(lines, calls.java_types(lines)).select("path", "target", "kind", "line")


@query(_SRC + """SELECT a.path AS src, b.path AS dst FROM f a JOIN f b ON b.k = a.k + 1 OR (b.k IN (a.k + 2, a.k + 20, a.k + 22) AND b.root = a.root AND b.p = (a.k + 2) // 50)""")
def j07_java_imports(spark, sf_dir):
    """Files that a file depends on: those it imports, and what it mentions of a package that it imports whole."""
    lines = _lines(spark, sf_dir)
    return calls.java_file_imports(lines, calls.java_types(lines))


@query(_SRC + """SELECT path, caller, callee_path, 'symbol:' || callee_path || ':' || callee AS callee, CAST(line AS INTEGER) AS line FROM (
  SELECT a.path, 'symbol:' || a.path || ':m' || (a.k % 5) || ':6' AS caller, b.path AS callee_path, 'm' || (b.k % 5) || ':6' AS callee, 7 AS line FROM f a JOIN f b ON b.k = a.k + 1
  UNION ALL SELECT a.path, 'symbol:' || a.path || ':m' || (a.k % 5) || ':6', b.path, 'm0:6', 8 FROM seen s JOIN f a ON a.k = s.k JOIN f b ON b.k = s.o WHERE s.o = s.k + 2 AND b.k % 5 = 0
  UNION ALL SELECT path, 'symbol:' || path || ':m' || (k % 5) || ':6', path, 'm' || (k % 5) || ':6', 9 FROM f UNION ALL SELECT path, 'symbol:' || path || ':m' || (k % 5) || ':6', path, 'h:11', 9 FROM f)""")
def x12_java_calls(spark, sf_dir):
    """Calls by the declared type of their receiver, by a type's name, or within the file."""
    lines = _lines(spark, sf_dir)
    types = calls.java_types(lines)
    return calls.call_edges(lines, calls.java_file_imports(lines, types), types)
