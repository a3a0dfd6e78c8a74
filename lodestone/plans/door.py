"""The search door over files written from `part`, asked by `nation`: parts are files with symbols and a summary, every
eleventh a test; nations ask for symbols, types, Han words that only pairs find, and nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import door
from lodestone.plans.registry import query, table


def _corpus(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    path = text(F.when(k % 11 == 0, "tests/").otherwise("src/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), "/m", k, ".py")
    files = p.select(path.alias("path"), F.col("p_size").alias("lines")).where("lines % 7 <> 0")
    names = F.array(text("load", k % 50), text("Item", k % 13), text("load", k % 50), F.lit("run_all"))
    symbols = p.where(k % 6 != 0).select(path.alias("path"), F.posexplode(names).alias("at", "name")).select("path", "name", (F.col("at") * 3 + 1).alias("line"))
    summary = text(F.col("p_name"), F.when(k % 9 == 0, " 订单服务").when(k % 9 == 1, " 单服").otherwise(""), F.when(k % 17 == 0, F.repeat(F.lit(" long"), 40)).otherwise(""))
    return door.build_corpus(files, symbols, p.select(path.alias("path"), summary.alias("summary")))


def _asked(spark, sf_dir):
    n = F.col("n_nationkey")
    ask = F.when(n % 5 == 0, F.concat(F.lit("load"), n.cast("string"))).when(n % 5 == 1, F.concat(F.lit(" RunAll item"), (n % 13).cast("string"))).when(n % 5 == 2, "订单服务查询").when(n % 5 == 3, F.concat(F.lit("zzqq"), n.cast("string"))).otherwise("small, standard")
    return table(spark, sf_dir, "nation").select(n.alias("query"), ask.alias("text"))


_SRC = r"""WITH k AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'tests/' ELSE 'src/' END || lower(replace(p_type, ' ', '_')) || '/m' || p_partkey || '.py' AS path, p_size, p_name FROM part),
f AS (SELECT k, path, CASE WHEN p_size % 7 <> 0 THEN p_size END AS lines, CASE WHEN k % 6 <> 0 THEN ['load' || (k % 50), 'Item' || (k % 13), 'run_all'] ELSE [] END AS names, p_size % 7 <> 0 OR k % 6 <> 0 AS known,
  p_name || CASE k % 9 WHEN 0 THEN ' 订单服务' WHEN 1 THEN ' 单服' ELSE '' END || CASE WHEN k % 17 = 0 THEN repeat(' long', 40) ELSE '' END AS whole FROM k),
c AS (SELECT k, path, lines, names, CASE WHEN length(whole) > 160 THEN left(whole, 160) || '…' ELSE whole END AS summary FROM f WHERE known),
asked AS (SELECT n_nationkey AS query, CASE n_nationkey % 5 WHEN 0 THEN ['load' || n_nationkey] WHEN 1 THEN ['runall item' || (n_nationkey % 13), 'runall', 'item' || (n_nationkey % 13)] WHEN 2 THEN ['订单服务查询']
  WHEN 3 THEN ['zzqq' || n_nationkey] ELSE ['small, standard', 'small', 'standard'] END AS tokens, 1 AS least FROM nation),
gate AS (SELECT t FROM (SELECT unnest(['订单 单服 服务 务查 查询', '订单', '单服', '服务', '务查', '查询']) AS t) g LEFT JOIN c ON contains(lower(path || ' ' || array_to_string(names, ' ') || ' ' || summary), t)
  GROUP BY t HAVING count(c.k) <= (SELECT greatest(3, floor(count(*) * 0.12)) FROM c)),
every AS (SELECT query, tokens, least, false AS segmented FROM asked UNION ALL SELECT query, (SELECT list(t ORDER BY list_position(['订单 单服 服务 务查 查询', '订单', '单服', '服务', '务查', '查询'], t)) FROM gate), 2, true FROM asked WHERE query % 5 = 2),
faces AS (SELECT q.query, q.least, q.segmented, c.*, face, weight, txt, list_filter(q.tokens, lambda t: CASE WHEN length(t) >= 6 OR regexp_matches(t, '[^\x00-\x7F]') THEN contains(txt, t)
    ELSE len(list_filter(string_split_regex(txt, '[^a-z0-9]+'), lambda w: starts_with(w, t))) > 0 END) AS hit FROM every q, c, (VALUES ('path', 3), ('symbols', 3), ('summary', 2)) x(face, weight),
    LATERAL (SELECT CASE face WHEN 'path' THEN lower(path) WHEN 'symbols' THEN lower(array_to_string(names, ' ')) ELSE lower(summary) END AS txt)),
-- of tokens that overlap in a text only the first counts; here these are pairs of Han characters one after the other
sized AS (SELECT *, CASE WHEN NOT segmented THEN len(hit) ELSE (CASE WHEN contains(txt, '订单服务') THEN 2 WHEN len(hit) > 0 THEN 1 ELSE 0 END) END AS evidence FROM faces),
scored AS (SELECT query, segmented, path, any_value(lines) AS lines, any_value(names) AS names, any_value(summary) AS summary, any_value(k) AS k, CAST(sum(len(hit) * weight) AS INTEGER) AS raw, string_agg(face, '/' ORDER BY face = 'summary', face) FILTER (len(hit) > 0) AS faces,
  any_value(hit) FILTER (face = 'symbols') AS symbol_hits FROM sized GROUP BY query, segmented, path, least HAVING sum(evidence) >= least),
final AS (SELECT *, CASE WHEN path LIKE 'tests/%' THEN least(raw, 1) ELSE raw END AS score FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank, count(*) OVER (PARTITION BY query) AS hits FROM final) """


@query(_SRC + """SELECT path, lines, array_to_string(names, ',') AS names, summary FROM c""")
def t01_corpus(spark, sf_dir):
    """Files with distinct symbols and a cut summary."""
    return _corpus(spark, sf_dir).select("path", "lines", F.array_join("names", ",").alias("names"), "summary")


@query(_SRC + """SELECT query, array_to_string(tokens, '|') AS tokens FROM asked""")
def t02_query_tokens(spark, sf_dir):
    return _asked(spark, sf_dir).select("query", F.array_join(door.query_tokens(F.col("text")), "|").alias("tokens"))


@query(_SRC + """SELECT query, hits, segmented, CAST(rank AS INTEGER) AS rank, path, score, faces FROM r WHERE rank <= 10""")
def t04_search_door(spark, sf_dir):
    """The best ten files of each query; what has no hit is asked again in pairs."""
    found = door.search(_corpus(spark, sf_dir), _asked(spark, sf_dir), "query", "text")
    return found.select("query", "hits", "segmented", "rank", "path", "score", F.array_join("faces", "/").alias("faces"))


@query(_SRC + r""", b AS (SELECT *, '- ' || path || '（' || coalesce(lines || ' 行', '行数未知') || CASE WHEN path LIKE 'tests/%' THEN '，测试文件' ELSE '' END || '）【命中 ' || score || '：' || replace(replace(replace(faces, 'path', '路径'), 'symbols', '符号'), 'summary', '职责')
  || '】' || chr(10) || '  符号: ' || CASE WHEN len(names) = 0 THEN '（无符号）' ELSE array_to_string(names, ', ') END || CASE WHEN len(near) = 0 THEN '' ELSE chr(10) || '  就近: ' || array_to_string(near[1:2], '、') END || chr(10) || '  职责: ' || summary AS block FROM (
    SELECT *, list_filter(['load' || (k % 50) || ':1', 'Item' || (k % 13) || ':4', 'load' || (k % 50) || ':7', 'run_all:10'], lambda u: len(names) > 0 AND len(list_filter(symbol_hits, lambda t: CASE WHEN length(t) >= 6 THEN contains(lower(u), t) ELSE
      len(list_filter(string_split_regex(lower(split_part(u, ':', 1)), '[^a-z0-9]+'), lambda w: starts_with(w, t))) > 0 END)) > 0) AS near FROM r WHERE rank <= 10)),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query ORDER BY rank) AS used FROM b) SELECT query, CAST(rank AS INTEGER) AS rank, block FROM u WHERE used <= 2000""")
def t05_search_output(spark, sf_dir):
    """What the door shows within its budget of characters."""
    return door.shown(door.search(_corpus(spark, sf_dir), _asked(spark, sf_dir), "query", "text")).select("query", "rank", "block")
