"""Imports, routes and joins over small source texts written from parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import extract as E
from lodestone.operators import joins as J
from lodestone.plans.registry import query, table


def _s(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _texts(spark, sf_dir, text):
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def _joined(column):
    return F.array_join(column, " ")


def _k():
    return F.col("p_partkey")


@query("SELECT p_partkey, 'a.B' || p_partkey || ':false x.y' || (p_partkey % 7) || ':true' AS imports, 'org.acme.p' || (p_partkey % 5) || '.T' || p_partkey AS type FROM part")
def x05_java_imports(spark, sf_dir):
    """Imports with their wildcard flag (X05), and the full name of the file's type (X11)."""
    text = _s("package org.acme.p", _k() % 5, ";\n\nimport a.B", _k(), ";\n  import static x.y", _k() % 7, ".*;\nimportant x;\n")
    flat = F.transform(E.java_imports(F.col("text")), lambda i: F.concat_ws(":", i["specifier"], i["wildcard"].cast("string")))
    return _texts(spark, sf_dir, text).select("p_partkey", _joined(flat).alias("imports"), E.java_type(_s("src/T", _k(), ".java"), F.col("text")).alias("type"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'fmt lib/p' || p_partkey ELSE 'os' END AS imports FROM part""")
def x06_go_imports(spark, sf_dir):
    text = F.when(_k() % 2 == 0, _s('package a\n\nimport (\n\t"fmt"\n\tx "lib/p', _k(), '"\n)\nvar s = "none"\n')).otherwise(F.lit('import "os"\nx := "y"\n'))
    return _texts(spark, sf_dir, text).select("p_partkey", _joined(E.imports_of(F.col("text"), "go")).alias("imports"))


@query("SELECT p_partkey, 'm' || p_partkey || ' std::io crate::a' || (p_partkey % 3) AS imports FROM part")
def x07_rust_modules(spark, sf_dir):
    text = _s("mod m", _k(), ";\nuse std::io;\n  pub use crate::a", _k() % 3, ";\n// used\nlet module = 1;\n")
    return _texts(spark, sf_dir, text).select("p_partkey", _joined(E.imports_of(F.col("text"), "rust")).alias("imports"))


@query("SELECT p_partkey, 'System.Text Acme.P' || p_partkey AS imports, 'Acme.N' || (p_partkey % 9) AS namespaces FROM part")
def x08_csharp_usings(spark, sf_dir):
    text = _s("using System.Text;\nusing static Acme.P", _k(), ";\nusing (var x = y) {}\nnamespace Acme.N", _k() % 9, "\n{\n}\n")
    return _texts(spark, sf_dir, text).select("p_partkey", _joined(E.imports_of(F.col("text"), "csharp")).alias("imports"), _joined(E.csharp_namespaces(F.col("text"))).alias("namespaces"))


@query("SELECT p_partkey, 'a/h' || p_partkey || '.h b.hpp' AS includes FROM part")
def x09_includes(spark, sf_dir):
    text = _s('#include <vector>\n#include "a/h', _k(), '.h"\n  #  include "b.hpp"\n// include "c.h"\n')
    return _texts(spark, sf_dir, text).select("p_partkey", _joined(E.imports_of(F.col("text"), "cpp")).alias("includes"))


@query("SELECT p_partkey, './a' || p_partkey || ' lib' || (p_partkey % 4) || ' ../c' AS imports FROM part")
def x10_script_imports(spark, sf_dir):
    text = _s("import x from './a", _k(), "';\nconst y = require(\"lib", _k() % 4, "\");\nconst z = await import('../c');\nconst w = 'none';\n")
    return _texts(spark, sf_dir, text).select("p_partkey", _joined(E.imports_of(F.col("text"), "typescript")).alias("imports"))


def _api(spark, sf_dir):
    """Each part declares routes in `apiN.py`, one line of its own behind the file's prefix."""
    n, path = _k() % 12, _s("api", _k() % 12, ".py")
    rows = table(spark, sf_dir, "part").select(path.alias("path"), (F.floor(_k() / 12) + 2).cast("int").alias("line"), F.when(_k() % 2 == 0, _s("@bp.route('/item", _k(), "/<int:id>')")).otherwise(_s('@router.post("act', _k(), '/{name}/")')).alias("content"))
    heads = table(spark, sf_dir, "part").select(path.alias("path"), F.lit(1).alias("line"), F.when(n % 3 == 0, _s("app = APIRouter(prefix='/v", n, "/')")).otherwise("app = App()").alias("content")).distinct()
    return heads.unionByName(rows)


_PROVIDED = """WITH p AS (SELECT 'api' || (p_partkey % 12) || '.py' AS path, CAST(p_partkey // 12 + 2 AS INTEGER) AS line, CASE WHEN p_partkey % 12 % 3 = 0 THEN '/v' || (p_partkey % 12) ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN '/item' || p_partkey || '/{*}' ELSE '/act' || p_partkey || '/{*}' END AS route, CASE WHEN p_partkey % 2 = 0 THEN 'flask' ELSE 'fastapi' END AS framework FROM part) """


@query(_PROVIDED + "SELECT * FROM p")
def x15_route_providers(spark, sf_dir):
    return E.python_routes(_api(spark, sf_dir))


@query(_PROVIDED + """, c AS (SELECT DISTINCT 'web' || (l_suppkey % 9) || '.ts' AS page, CASE WHEN l_partkey % 12 % 3 = 0 AND l_partkey % 5 <> 1 THEN '/v' || (l_partkey % 12) ELSE '' END || CASE WHEN l_partkey % 2 = 0 THEN '/item' ELSE '/act' END || l_partkey || '/{*}' AS route FROM lineitem)
SELECT page, c.route, p.path AS provider, p.framework FROM c LEFT JOIN p ON p.route = c.route""")
def j12_route_links(spark, sf_dir):
    """Requests of scripts with the providers of their normalised routes; a fifth of them leave a prefix out."""
    k = F.col("l_partkey")
    base = _s(F.when((k % 12 % 3 == 0) & (k % 5 != 1), _s("/v", k % 12)).otherwise(""), F.when(k % 2 == 0, "/item").otherwise("/act"), k)
    content = _s("  const r = await fetch(`", base, "/${id}?x=1`);")
    lines = table(spark, sf_dir, "lineitem").select(_s("web", F.col("l_suppkey") % 9, ".ts").alias("path"), F.lit(1).alias("line"), content.alias("content")).distinct()
    asked = E.route_requests(lines).select(F.col("path").alias("page"), "route").distinct()
    provided = E.python_routes(_api(spark, sf_dir)).select("route", F.col("path").alias("provider"), "framework")
    return asked.join(provided, "route", "left").select("page", "route", "provider", "framework")


_CITES = r"""WITH c AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(t, '[A-Za-z0-9_./\-]+\.(?:py|ts|md)(?:[^A-Za-z0-9:]|:\d{1,5}|$)'))) AS c FROM (SELECT conv_id, turn, coalesce(text, '') || ' see src/m' || turn || '.py:' || (conv_id + 1) || ', docs/a.md and x.tsx1 ' AS t FROM conversations)) """


@query(_CITES + r"""SELECT conv_id, regexp_replace(regexp_replace(c, '[^A-Za-z0-9]+$', ''), ':\d+$', '') AS path, TRY_CAST(nullif(regexp_extract(c, ':([0-9]+)$', 1), '') AS INTEGER) AS line, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def x21_citations(spark, sf_dir):
    """Files cited in the turns of conversations."""
    text = _s(F.coalesce("text", F.lit("")), " see src/m", F.col("turn"), ".py:", F.col("conv_id") + 1, ", docs/a.md and x.tsx1 ")
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("of"), text.alias("text"))
    return E.citations(turns, "of", "text", ("py", "ts", "md")).groupBy(F.col("of.conv_id").alias("conv_id"), "path", "line").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_partkey, 'com.acme.m' || (p_partkey % 30) || '.T' || (p_partkey % 50) || '.Inner.x' AS name FROM part), t AS (SELECT 'com.acme.m' || (s_suppkey % 30) || '.T' || s_suppkey AS fqn FROM supplier UNION SELECT 'com.acme.m' || (s_suppkey % 30) FROM supplier)
SELECT p_partkey, arg_max(fqn, length(fqn)) AS type FROM n LEFT JOIN t ON starts_with(name || '.', fqn || '.') GROUP BY 1""")
def j03_longest_types(spark, sf_dir):
    """A qualified name's type: segments are left out from the end until one is known."""
    s = F.col("s_suppkey")
    types = table(spark, sf_dir, "supplier").select(F.explode(F.array(_s("com.acme.m", s % 30, ".T", s), _s("com.acme.m", s % 30))).alias("type")).distinct()
    names = table(spark, sf_dir, "part").select("p_partkey", _s("com.acme.m", _k() % 30, ".T", _k() % 50, ".Inner.x").alias("name"))
    return J.longest_prefix_join(names, "name", types, "type").select("p_partkey", "type")


@query("""WITH f AS (SELECT 'src/d' || (s_suppkey % 5) || '/inc/h' || (s_suppkey % 60) || '.h' AS path FROM supplier), c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'inc/h' ELSE 'nc/h' END || (p_partkey % 130) || '.h' AS spec FROM part)
SELECT p_partkey, path FROM c JOIN (SELECT DISTINCT path FROM f) ON ends_with('/' || path, '/' || spec)""")
def j05_include_files(spark, sf_dir):
    """All files that an include names by their end, at the border of a segment."""
    s = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(_s("src/d", s % 5, "/inc/h", s % 60, ".h").alias("path")).distinct()
    specs = table(spark, sf_dir, "part").select("p_partkey", _s(F.when(_k() % 2 == 0, "inc/h").otherwise("nc/h"), _k() % 130, ".h").alias("spec"))
    return J.suffix_join(files, "path", specs, "spec").select("p_partkey", "path")


@query("""WITH f AS (SELECT 'm' || (s_suppkey % 3) || '/pkg' || (s_suppkey % 20) AS dir, 'f' || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN '_test.go' ELSE '.go' END AS name FROM supplier),
i AS (SELECT p_partkey, 'example.org/mod' || (p_partkey % 4) || '/pkg' || (p_partkey % 20) AS spec FROM part)
SELECT p_partkey, dir || '/' || name AS path FROM i JOIN f ON spec LIKE 'example.org/mod_/%' AND substr(spec, 16, 1) IN ('0', '1', '2') AND dir = 'm' || substr(spec, 16) WHERE name NOT LIKE '%_test.go'""".replace("LIKE '%_test.go'", "SIMILAR TO '.*_test[.]go'"))
def j06_go_packages(spark, sf_dir):
    """An import's module gives its folder; all files there but tests are meant. Module 3 is none of the tree's."""
    s = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(_s("m", s % 3, "/pkg", s % 20, "/f", s, F.when(s % 4 == 0, "_test.go").otherwise(".go")).alias("path"))
    modules = spark.createDataFrame([(f"example.org/mod{k}", f"m{k}") for k in range(3)], "module string, root string")
    imports = table(spark, sf_dir, "part").select("p_partkey", _s("example.org/mod", _k() % 4, "/pkg", _k() % 20).alias("specifier"))
    placed = J.longest_prefix_join(imports, "specifier", modules, "module", "/").where("module IS NOT NULL")
    rest = F.substring(F.col("specifier"), 1, 10_000)
    folder = F.concat("root", F.substr(rest, F.length("module") + 1))
    sources = files.where(~F.col("path").endswith("_test.go")).withColumn("folder", T.dirname(F.col("path")))
    return placed.withColumn("folder", folder).join(sources, "folder").select("p_partkey", "path")


@query("""WITH b AS (SELECT DISTINCT p_partkey % 20 AS f, p_size AS s, p_size + p_partkey % 160 AS e FROM part), p AS (SELECT event_id, user_id % 20 AS f, event_id % 130 AS at_line FROM events),
r AS (SELECT event_id, s, e, row_number() OVER (PARTITION BY event_id ORDER BY e - s, s DESC) AS r FROM p LEFT JOIN b ON b.f = p.f AND at_line BETWEEN s AND e) SELECT event_id, s AS start, e AS "end" FROM r WHERE r = 1""")
def j10_smallest_blocks(spark, sf_dir):
    """Uses with the smallest block that holds them."""
    blocks = table(spark, sf_dir, "part").select((_k() % 20).alias("f"), F.col("p_size").cast("long").alias("start"), (F.col("p_size") + _k() % 160).alias("end")).distinct()
    uses = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("f"), (F.col("event_id") % 130).alias("at_line"))
    return J.containing_interval(uses, blocks, ["f"], "at_line", "start", "end").select("event_id", F.col("start"), F.col("end"))


@query("""SELECT n.p_partkey, count(*) AS declared FROM (SELECT p_partkey, p_brand AS binding FROM part) n JOIN (SELECT p_partkey AS other, p_brand AS binding FROM part WHERE p_partkey % 37 = 0) d ON d.binding = n.binding AND d.other <> n.p_partkey GROUP BY 1""")
def j21_bindings(spark, sf_dir):
    """How many other files declare what a file asks for by name."""
    p = table(spark, sf_dir, "part")
    declared = p.where(_k() % 37 == 0).groupBy("p_brand").agg(F.count("*").alias("n"))
    own = p.select("p_partkey", "p_brand", (_k() % 37 == 0).cast("int").alias("own")).join(declared, "p_brand")
    return own.select("p_partkey", (F.col("n") - F.col("own")).alias("declared")).where("declared > 0")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), i AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R')
SELECT a, b, CASE WHEN (a, b) IN (SELECT (a, b) FROM i) THEN 'static' WHEN (a, b) IN (SELECT (a, b) FROM c) THEN 'code' ELSE 'claimed' END AS origin FROM e""")
def j22_verified_edges(spark, sf_dir):
    """A drawn edge is static if there is an import, code if there is a call, and else only claimed: one pass over the evidence."""
    of = lambda flag: F.max((F.col("l_returnflag") == flag).cast("int"))
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(of("A").alias("imported"), of("R").alias("called"))
    return e.select("a", "b", F.when(F.col("imported") == 1, "static").when(F.col("called") == 1, "code").otherwise("claimed").alias("origin"))


@query("""WITH f AS (SELECT 'd' || (p_partkey % 40) || '/p' || p_partkey || '.py' AS path FROM part), r AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'file:d' || (s_suppkey % 40) || '/p' || s_suppkey || '.py' WHEN 1 THEN 'dir:d' || (s_suppkey % 50) ELSE 'symbol:d' || (s_suppkey % 40) || '/p' || s_suppkey || '.py#run' END AS ref FROM supplier)
SELECT s_suppkey, count(path) AS files FROM r LEFT JOIN f ON CASE WHEN ref LIKE 'file:%' THEN path = substr(ref, 6) WHEN ref LIKE 'dir:%' THEN starts_with(path, substr(ref, 5) || '/') ELSE path = split_part(substr(ref, 8), '#', 1) END GROUP BY 1""")
def j25_node_files(spark, sf_dir):
    """Files of a diagram's nodes: by path, by folder, or by the path of a symbol."""
    s = F.col("s_suppkey")
    files = table(spark, sf_dir, "part").select(_s("d", _k() % 40, "/p", _k(), ".py").alias("path"))
    ref = F.when(s % 3 == 0, _s("file:d", s % 40, "/p", s, ".py")).when(s % 3 == 1, _s("dir:d", s % 50)).otherwise(_s("symbol:d", s % 40, "/p", s, ".py#run"))
    target = F.substring_index(F.regexp_replace("ref", "^(file|dir|symbol):", ""), "#", 1)
    refs = table(spark, sf_dir, "supplier").select("s_suppkey", ref.alias("ref")).withColumn("target", target)
    parts = F.split("path", "/")
    known = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("target"))
    # a folder's name never ends where a file's does, so one equi join serves all three kinds
    met = refs.join(known.groupBy("target").agg(F.count("*").alias("files")), "target", "left")
    return met.select("s_suppkey", F.coalesce("files", F.lit(0)).alias("files"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'stdlib' WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 'in-repo' ELSE 'external' END WHEN 2 THEN 'in-repo' ELSE CASE WHEN p_partkey % 8 = 3 THEN 'stdlib' ELSE 'external' END END AS origin FROM part""")
def r04_import_origins(spark, sf_dir):
    """Where an import comes from: Python, Java, Rust and Go rules; a module of the tree is in-repo."""
    m, odd = _k() % 4, _k() % 8
    language = F.when(m == 0, "java").when(m == 1, "python").when(m == 2, "rust").otherwise("go")
    spec = F.when(m == 0, "java.util.List").when(m == 1, F.when(odd == 1, "own.mod").otherwise("numpy.linalg")).when(m == 2, "crate::a").otherwise(F.when(odd == 3, "fmt/sub").otherwise("github.com/a/b"))
    rows = table(spark, sf_dir, "part").select("p_partkey", language.alias("language"), spec.alias("specifier"))
    own = spark.createDataFrame([("own.mod", True)], "specifier string, own boolean")
    return rows.join(F.broadcast(own), "specifier", "left").select("p_partkey", T.import_origin(F.col("language"), F.col("specifier"), F.coalesce("own", F.lit(False))).alias("origin"))
