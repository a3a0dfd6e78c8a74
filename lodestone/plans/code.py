"""The code graph over a source tree written from the tables: each supplier is a Python
module `pkgN/modS.py`, some in `pkgN/tests` or `pkgN/dbmodS.py`, whose lines are its order lines in order. Line numbers within an
order choose the statement (import, def, call, class, return, blank, if), the part
names what is imported, defined or called. Half of the imports lead nowhere."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import code as C
from lodestone.operators.graph import settle
from lodestone.plans.registry import query, table

_SRC = r"""WITH RECURSIVE src AS (SELECT 'pkg' || (l_suppkey % 20) || CASE WHEN l_suppkey % 13 = 0 THEN '/db' WHEN l_suppkey % 11 = 0 THEN '/tests/' ELSE '/' END || 'mod' || l_suppkey || '.py' AS path,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS line,
  CASE l_linenumber WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'from pkg' || (m % 20) || '.mod' || m || ' import f' || k ELSE 'import os.path as p, pkg' || (k % 20) || '.mod' || m || '  # maybe' END
    WHEN 2 THEN 'def f' || k || '(a, b):' WHEN 3 THEN '    x = f' || k || '(a) + obj.g' || (k % 7) || '(b)' WHEN 4 THEN 'class C' || k || ':'
    WHEN 5 THEN '    return f' || k || '(f' || (k % 11) || '(a))' WHEN 6 THEN '' ELSE '    if f' || k || '(b): pass' END AS content
  FROM (SELECT *, l_partkey % 300 AS k, l_partkey % 100 + 1 AS m FROM lineitem)),
files AS (SELECT path, count(*) AS lines FROM src GROUP BY 1),
def AS (SELECT path, line, regexp_extract(content, '^\s*(def|class)\s+(\w+)', 1) AS word, regexp_extract(content, '^\s*(def|class)\s+(\w+)', 2) AS name,
  length(content) - length(ltrim(content)) AS own FROM src WHERE regexp_matches(content, '^\s*(def|class)\s')),
stops AS (SELECT d.path, d.line, min(s.line) - 1 AS stop FROM def d JOIN src s ON s.path = d.path AND s.line > d.line AND trim(s.content) <> '' AND length(s.content) - length(ltrim(s.content)) <= d.own GROUP BY 1, 2),
sym AS (SELECT d.path, CASE word WHEN 'class' THEN 'class' ELSE 'function' END AS kind, name, d.line, CAST(coalesce(stop, lines) AS INTEGER) AS "end"
  FROM def d JOIN files USING (path) LEFT JOIN stops s ON s.path = d.path AND s.line = d.line),
spec AS (SELECT DISTINCT path, specifier FROM (SELECT path, regexp_extract(content, '^from (\S+)', 1) AS specifier FROM src WHERE content LIKE 'from %' UNION ALL
  SELECT path, unnest(['os.path', regexp_extract(content, ', (\S+)', 1)]) FROM src WHERE content LIKE 'import %')),
target AS (SELECT s.path, specifier, f.path AS target FROM spec s LEFT JOIN files f ON f.path = replace(specifier, '.', '/') || '.py'),
imp AS (SELECT DISTINCT path AS src, target AS dst FROM target WHERE target IS NOT NULL),
site AS (SELECT path, line, unnest(range(len(names))) AS nth, unnest(receivers) AS receiver, unnest(names) AS name FROM (SELECT path, line,
  list_transform(regexp_extract_all(content, '(?:([A-Za-z_]\w*)\s*\.\s*)?\b([A-Za-z_]\w*)\s*\(', 1), lambda x: CASE WHEN x <> '' THEN x END) AS receivers,
  regexp_extract_all(content, '(?:([A-Za-z_]\w*)\s*\.\s*)?\b([A-Za-z_]\w*)\s*\(', 2) AS names FROM src WHERE NOT regexp_matches(content, '^\s*(def|class)\s'))),
firsts AS (SELECT path, name, min(line) AS callee_line FROM sym GROUP BY 1, 2),
ranked AS (SELECT s.*, f.path AS callee_path, f.callee_line, row_number() OVER (PARTITION BY s.path, s.line, s.nth ORDER BY f.path <> s.path, f.path, f.callee_line) AS r
  FROM site s JOIN firsts f ON f.name = s.name WHERE f.path = s.path OR EXISTS (SELECT 1 FROM imp i WHERE i.src = s.path AND i.dst = f.path)),
call AS (SELECT path, line, nth, name, callee_path, callee_line FROM ranked WHERE r = 1),
edge AS (SELECT src, dst FROM imp WHERE src <> dst UNION SELECT path, callee_path FROM call WHERE path <> callee_path) """


def _lines(spark, sf_dir):
    k, m, n = F.col("l_partkey") % 300, F.col("l_partkey") % 100 + 1, F.col("l_linenumber")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    content = (
        F.when((n == 1) & (k % 2 == 0), s("from pkg", m % 20, ".mod", m, " import f", k)).when(n == 1, s("import os.path as p, pkg", k % 20, ".mod", m, "  # maybe"))
        .when(n == 2, s("def f", k, "(a, b):")).when(n == 3, s("    x = f", k, "(a) + obj.g", k % 7, "(b)")).when(n == 4, s("class C", k, ":"))
        .when(n == 5, s("    return f", k, "(f", k % 11, "(a))")).when(n == 6, "").otherwise(s("    if f", k, "(b): pass"))
    )
    line = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").select(_path(F.col("l_suppkey")).alias("path"), line.alias("line"), content.alias("content"))


def _path(s):
    folder = F.when(s % 13 == 0, "/db").when(s % 11 == 0, "/tests/").otherwise("/")
    return F.concat(F.lit("pkg"), (s % 20).cast("string"), folder, F.lit("mod"), s.cast("string"), F.lit(".py"))


def _files(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(_path(F.col("l_suppkey")).alias("path")).agg(F.count("*").alias("lines"))


def _targets(spark, sf_dir):
    specs = C.python_imports(_lines(spark, sf_dir))
    return C.resolve_first(specs, C.module_candidates(F.col("specifier")), _files(spark, sf_dir))


def _imports(spark, sf_dir):
    return _targets(spark, sf_dir).where("target IS NOT NULL").select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def _calls(spark, sf_dir, find=C.call_edges):
    lines = _lines(spark, sf_dir)
    return find(C.call_sites(lines), C.symbols(lines), _imports(spark, sf_dir))


def _called(spark, sf_dir):
    """What the names that a file calls mean; own names that it never calls are no edge to another file."""
    return _calls(spark, sf_dir, C.call_targets)


def _edges(spark, sf_dir):
    """Kept, as its readers would each resolve all calls again."""
    return settle(C.file_edges(_imports(spark, sf_dir), _called(spark, sf_dir)))


@query(_SRC + "SELECT * FROM sym")
def x02_symbols(spark, sf_dir):
    return C.symbols(_lines(spark, sf_dir))


@query(_SRC + "SELECT * FROM spec")
def x04_python_imports(spark, sf_dir):
    return C.python_imports(_lines(spark, sf_dir))


@query(_SRC + "SELECT path, line, CAST(nth AS INTEGER) AS nth, receiver, name FROM site WHERE name NOT IN ('if', 'return')")
def x12_call_sites(spark, sf_dir):
    return C.call_sites(_lines(spark, sf_dir))


@query(_SRC + "SELECT path, specifier, target FROM target")
def j02_import_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


@query(_SRC + """SELECT c.path, c.line, CAST(nth AS INTEGER) AS nth, c.name, arg_max(s.name, s.line) AS caller, callee_path, callee_line FROM call c
LEFT JOIN sym s ON s.path = c.path AND s.line <= c.line AND s."end" >= c.line GROUP BY ALL""")
def j01_call_edges(spark, sf_dir):
    return _calls(spark, sf_dir)


@query(_SRC + """SELECT s.path, s.line, arg_max(y.name, y.line) AS caller FROM src s LEFT JOIN sym y ON y.path = s.path AND y.line <= s.line AND y."end" >= s.line GROUP BY 1, 2""")
def j09_enclosing_symbols(spark, sf_dir):
    return C.enclosing(None, C.symbols(_lines(spark, sf_dir), with_lines=True))


@query(_SRC + "SELECT src, dst FROM edge")
def g01_file_edges(spark, sf_dir):
    return C.file_edges(_imports(spark, sf_dir), _called(spark, sf_dir))


@query(_SRC + "SELECT path, count(*) FILTER (path <> callee_path) AS cross_file FROM call GROUP BY 1")
def a48_cross_file_calls(spark, sf_dir):
    return _calls(spark, sf_dir, C.resolved_calls).groupBy("path").agg(F.count_if(F.col("path") != F.col("callee_path")).alias("cross_file"))


@query(_SRC + """SELECT path, (SELECT count(DISTINCT dst) FROM edge WHERE src = path) AS calls_out, (SELECT count(DISTINCT src) FROM edge WHERE dst = path) AS calls_in FROM files""")
def j11_neighbour_counts(spark, sf_dir):
    e = _edges(spark, sf_dir)
    out, into = e.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("i"))
    both = _files(spark, sf_dir).join(out, "path", "left").join(into, "path", "left")
    return both.select("path", F.coalesce("o", F.lit(0)).alias("calls_out"), F.coalesce("i", F.lit(0)).alias("calls_in"))


_ENTRIES = "entry AS (SELECT path FROM files WHERE path LIKE 'pkg3/%'), dispatch AS (SELECT src, dst FROM edge WHERE src LIKE 'pkg1%' AND dst LIKE 'pkg1%'), "
_NEEDED = "needed AS (SELECT dst AS node FROM edge WHERE src IN (SELECT path FROM entry) UNION SELECT d.dst FROM needed n JOIN dispatch d ON d.src = n.node) "


def _entries(spark, sf_dir):
    """Modules of pkg3 are entries; edges among packages pkg1, pkg10 to pkg19 count as dispatch."""
    e = _edges(spark, sf_dir)
    return e, _files(spark, sf_dir).where(F.col("path").startswith("pkg3/")), e.where(F.col("src").startswith("pkg1") & F.col("dst").startswith("pkg1"))


@query(_SRC + ", " + _ENTRIES + _NEEDED + "SELECT DISTINCT node AS path FROM needed")
def g03_entry_dependencies(spark, sf_dir):
    e, entries, dispatch = _entries(spark, sf_dir)
    return C.entry_dependencies(e, entries, dispatch)


@query(_SRC + ", " + _ENTRIES + _NEEDED + """SELECT path, CASE WHEN path LIKE '%/tests/%' THEN 'test' WHEN path IN (SELECT path FROM entry) THEN 'core' WHEN path LIKE '%/db%' THEN 'infra' WHEN path IN (SELECT node FROM needed) THEN 'core'
  WHEN path NOT IN (SELECT src FROM edge UNION SELECT dst FROM edge) THEN 'tool' ELSE 'support' END AS role FROM files""")
def p03_file_roles(spark, sf_dir):
    e, entries, dispatch = _entries(spark, sf_dir)
    return C.roles(_files(spark, sf_dir), e, entries, dispatch)


@query(_SRC + """SELECT DISTINCT path FROM (SELECT src AS path, dst AS near FROM imp UNION ALL SELECT dst, src FROM imp) WHERE near IN ('pkg1/mod1.py', 'pkg2/mod2.py')""")
def g10_related_paths(spark, sf_dir):
    """Importers and imports of two modules."""
    i, near = _imports(spark, sf_dir), ["pkg1/mod1.py", "pkg2/mod2.py"]
    return i.where(F.col("dst").isin(near)).select(F.col("src").alias("path")).union(i.where(F.col("src").isin(near)).select("dst")).distinct()


@query(_SRC + """, seen AS (SELECT 'pkg5/mod5.py' AS node UNION SELECT e.src FROM seen s JOIN edge e ON e.dst = s.node)
SELECT node AS path, CASE WHEN node = 'pkg5/mod5.py' THEN 0 WHEN node IN (SELECT src FROM edge WHERE dst = 'pkg5/mod5.py') THEN 1 ELSE 2 END AS priority FROM seen ORDER BY priority, path LIMIT 4""")
def g11_impact_order(spark, sf_dir):
    return C.impact_order(_edges(spark, sf_dir), "pkg5/mod5.py")


@query(_SRC + """SELECT path, coalesce(array_to_string((SELECT list(name ORDER BY line, name) FROM (SELECT name, line FROM sym WHERE sym.path = f.path ORDER BY line, name LIMIT 8)), ','), '') AS symbols,
  coalesce(array_to_string(list_sort((SELECT list(DISTINCT dst) FROM edge WHERE src = f.path))[:6], ','), '') AS uses,
  coalesce(array_to_string(list_sort((SELECT list(DISTINCT src) FROM edge WHERE dst = f.path))[:6], ','), '') AS used_by FROM files f""")
def g12_slices(spark, sf_dir):
    s = C.slices(_files(spark, sf_dir), _edges(spark, sf_dir), C.symbols(_lines(spark, sf_dir)))
    return s.select("path", *[F.array_join(c, ",").alias(c) for c in ("symbols", "uses", "used_by")])


@query(_SRC + """, t AS (SELECT DISTINCT path, name FROM sym WHERE kind = 'class'), e AS (SELECT name, list_sort(list(path)) AS files FROM t GROUP BY 1),
n AS (SELECT path, 'C' || (CAST(lines AS BIGINT) % 320) AS name FROM files UNION SELECT path, name FROM t WHERE length(name) = 4)
SELECT n.path, n.name, CASE WHEN t.path IS NOT NULL THEN n.path WHEN len(files) = 1 THEN files[1] END AS target,
  CASE WHEN t.path IS NULL AND len(files) > 1 THEN array_to_string(files, ',') END AS ambiguous FROM n LEFT JOIN t ON t.path = n.path AND t.name = n.name LEFT JOIN e ON e.name = n.name""")
def j08_type_files(spark, sf_dir):
    types = C.symbols(_lines(spark, sf_dir)).where("kind = 'class'").select("path", "name").distinct()
    asked = _files(spark, sf_dir).select("path", F.concat(F.lit("C"), (F.col("lines") % 320).cast("string")).alias("name"))
    names = asked.union(types.where(F.length("name") == 4)).distinct()
    return C.declared_at(names, types).withColumn("ambiguous", F.array_join("ambiguous", ","))


@query(_SRC + """, c AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'pkg' || (p_partkey % 20) || '/mod' || (p_partkey % 130) || '.py' WHEN 1 THEN 'mod' || (p_partkey % 130) || '.py' ELSE 'none' || p_partkey || '.py' END AS path,
  CASE WHEN p_partkey % 3 = 0 THEN p_size * 40 END AS line FROM part), t AS (SELECT regexp_extract(path, '[^/]+$') AS tail, count(*) AS n, min(path) AS only_path FROM files GROUP BY 1),
r AS (SELECT c.*, coalesce(f.path, CASE WHEN n = 1 THEN only_path END) AS target, n FROM c LEFT JOIN files f ON f.path = c.path LEFT JOIN t ON t.tail = c.path)
SELECT id, r.path, line, CASE WHEN target IS NULL AND n > 1 THEN 'ambiguous ' || n WHEN target IS NULL THEN 'missing' WHEN line IS NOT NULL AND (line < 1 OR line > f.lines) THEN 'out of range' ELSE 'found' END AS verdict, target
FROM r LEFT JOIN files f ON f.path = target""")
def j13_citations(spark, sf_dir):
    p = F.col("p_partkey")
    mod = F.concat(F.lit("mod"), (p % 130).cast("string"), F.lit(".py"))
    path = F.when(p % 4 == 0, F.concat(F.lit("pkg"), (p % 20).cast("string"), F.lit("/"), mod)).when(p % 4 == 1, mod).otherwise(F.concat(F.lit("none"), p.cast("string"), F.lit(".py")))
    cited = table(spark, sf_dir, "part").select(p.alias("id"), path.alias("path"), F.when(p % 3 == 0, F.col("p_size") * 40).alias("line"))
    return C.cite(cited, _files(spark, sf_dir))


@query(_SRC + r"""SELECT path, line, CASE WHEN regexp_matches(string_agg(content, ' ') OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), '\b(if|for|while|try|catch|synchronized)\b') THEN 3 ELSE 0 END
  + CASE WHEN length(content) - length(replace(content, '(', '')) >= 2 OR (contains(content, '=') AND regexp_matches(content, '\w+\(')) THEN 2 ELSE 0 END
  - CASE WHEN regexp_matches(content, '^\s*[\w.]+\([^)]*\)\s*;?\s*$') OR regexp_matches(content, '^\s*[\w.]+\s*=\s*[^=]') THEN 3 ELSE 0 END AS signal FROM src""")
def f17_line_signals(spark, sf_dir):
    return C.signal(_lines(spark, sf_dir))


_NAMES = """WITH f AS (SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_partkey % 12 WHEN 0 THEN '/testing/a.py' WHEN 1 THEN '/conftest.py' WHEN 2 THEN '/test_x.py' WHEN 3 THEN '/x_test.go' WHEN 4 THEN '/b.spec.mts'
  WHEN 5 THEN '/FooTest.java' WHEN 6 THEN '/redisCache.ts' WHEN 7 THEN '/LoginLogger.kt' WHEN 8 THEN '/HTTPClient.py' WHEN 9 THEN '/logical.py' WHEN 10 THEN '/dbStore.go' ELSE '/main.rs' END AS path FROM part) """


def _names(spark, sf_dir):
    ends = "/testing/a.py /conftest.py /test_x.py /x_test.go /b.spec.mts /FooTest.java /redisCache.ts /LoginLogger.kt /HTTPClient.py /logical.py /dbStore.go /main.rs".split()
    end = F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), end).alias("path"))


@query(_NAMES + """SELECT p_partkey, path, p_partkey % 12 <= 4 AS is_test FROM f""")
def p01_test_paths(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("is_test", T.is_test_path(F.col("path")))


@query(_NAMES + """SELECT p_partkey, CASE p_partkey % 12 WHEN 1 THEN 'conftest' WHEN 6 THEN 'redis' WHEN 7 THEN 'log' WHEN 8 THEN 'client' WHEN 10 THEN 'db' END AS hint FROM f""")
def p02_infra_names(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", C.infra_hint(F.col("path")).alias("hint"))
