"""Search, extraction and scalar-function queries over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evals, extract, search
from lodestone.plans.registry import query, table
from lodestone.sources import repository

_WORDS = r"list_filter(string_split_regex(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""SELECT doc_id, CAST(len({_WORDS.format('text')}) AS INTEGER) AS words FROM documents""")
def f03_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words_of(F.col("text"))).alias("words"))


#: Pages' paths, with numbers as parameters in the shapes that routes are written in.
_ROUTE_SQL = r"""SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS p, page_id % 6 AS m FROM pages"""
_ROUTED_SQL = r"""SELECT page_id, CASE m WHEN 0 THEN p || '?a=1#b' WHEN 1 THEN p || '/{id}/x' WHEN 2 THEN p || '//<int:id>/' WHEN 3 THEN p || '/${a/b}' WHEN 4 THEN p || '/:9x/' ELSE p END AS p FROM raw"""


def _routes(spark, sf_dir):
    p, m = F.regexp_replace("url", "^https?://[^/]+", ""), F.col("page_id") % 6
    end = F.when(m == 0, "?a=1#b").when(m == 1, "/{id}/x").when(m == 2, "//<int:id>/").when(m == 3, "/${a/b}").when(m == 4, "/:9x/").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(p, end).alias("p"))


@query(rf"""WITH raw AS ({_ROUTE_SQL}), r AS ({_ROUTED_SQL}), s AS (SELECT page_id, regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '[?#].*$', '', 's'),
  '\$?\{{[^}}]*\}}', '{{*}}', 'g'), '<[^>]*>', '{{*}}', 'g'), '/:\w+', '/{{*}}', 'g'), '/+', '/', 'g') AS p FROM r)
SELECT page_id, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END AS route FROM s""")
def f05_routes(spark, sf_dir):
    """Paths with parameters in every shape: {id}, <int:id>, ${a/b}, :9x."""
    return _routes(spark, sf_dir).select("page_id", T.normalize_route(F.col("p")).alias("route"))


@query(r"""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1""")
def a20_pages_by_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("pages"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY 1, 2""")
def x15_links(spark, sf_dir):
    return extract.links(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(strlen(text) AS BIGINT) AS bytes, substr(sha256(text), 1, 16) AS content_hash FROM documents""")
def s01_file_relation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(F.split("text", "\n", -1)).alias("lines"), F.octet_length("text").cast("long").alias("bytes"), T.short_hash(F.col("text")).alias("content_hash")
    )


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
b AS (SELECT doc_id, line, CASE WHEN line - lag(line) OVER w <= 2 THEN 0 ELSE 1 END AS b FROM l WHERE contains(content, '.') WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
i AS (SELECT doc_id, line, sum(b) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM b)
SELECT doc_id, CAST(min(line) AS INTEGER) AS first, CAST(max(line) AS INTEGER) AS last, count(*) AS n FROM i GROUP BY doc_id, island HAVING count(*) >= 2""")
def x22_line_islands(spark, sf_dir):
    rows = extract.lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.contains("content", F.lit(".")))
    return extract.islands(rows, ["doc_id"], "line")


@query(r"""WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 5)) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 30""")
def x23_identifier_clues(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where(F.length("word") >= 5)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(30)


@query("""SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'public') THEN 3 ELSE 0 END
  + CASE WHEN contains(lower(source), 'public') THEN 2 ELSE 0 END + CASE WHEN contains(lower(source), 'license') THEN 2 ELSE 0 END AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def t03_search(spark, sf_dir):
    scored = search.face_scores(table(spark, sf_dir, "documents"), ["license", "public"], {"text": 3, "source": 2})
    return search.ranked(scored, "doc_id").select("doc_id", "score")


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS token FROM documents),
df AS (SELECT token, count(*) AS df FROM t GROUP BY 1) SELECT token, df FROM df WHERE df > 1 AND df <= (SELECT greatest(3, CAST(floor(0.12 * count(*)) AS BIGINT)) FROM documents)""")
def t04_gated_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("token")).where(F.length("token") >= 2)
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return search.gated_tokens(df, docs.count())


@query("""SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 1 AND hit) AS hit, round(avg(hit::INTEGER) FILTER (quality = 1), 8) AS recall, count(*) FILTER (quality <> 1) AS negatives,
  count(*) FILTER (quality <> 1 AND hit) AS negatives_hit FROM (SELECT quality, n_chars > 500 AS hit FROM labels JOIN documents USING (doc_id))""")
def a34_retrieval_score(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    path = F.col("doc_id").cast("string")
    cases = rows.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.array(path)).otherwise(F.array().cast("array<string>")).alias("gold"))
    hits = rows.where("n_chars > 500").select(F.col("doc_id").alias("id"), F.lit(1).alias("rank"), path.alias("path"))
    return evals.retrieval_score(cases, hits, 5).withColumn("recall", F.round("recall", 8))


@query("""SELECT source, 'content:' || substr(sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || substr(sha256(text), 1, 16), ';' ORDER BY CAST(doc_id AS VARCHAR), sha256(text))), 1, 24) AS stamp FROM documents GROUP BY source""")
def a42_version_stamp(spark, sf_dir):
    """A stamp for each source."""
    path, digest = F.col("doc_id").cast("string"), T.short_hash(F.col("text"))
    entries = table(spark, sf_dir, "documents").select("source", path.alias("path"), F.concat(path, F.lit(":"), digest).alias("entry"))
    return repository.stamps(entries, "source", ["path", "entry"])


@query("""SELECT lang, count(*) AS files, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens FROM documents GROUP BY 1""")
def a40_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.ceil(F.sum(F.length("text")) / 4).alias("tokens"))


@query(r"""WITH c AS (SELECT doc_id, text LIKE '%License%' AS named, n_chars FROM documents) SELECT named, count(*) AS docs, round(avg(n_chars), 6) AS mean_chars FROM c GROUP BY 1""")
def a38_identifier_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.contains("text", F.lit("License")).alias("named")).agg(F.count("*").alias("docs"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
r AS (SELECT *, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS used FROM l WHERE line > 1 AND line <= 12)
SELECT doc_id, count(*) AS lines, CAST(max(line) + 1 AS INTEGER) AS continues FROM r WHERE used <= 600 OR line = 2 GROUP BY 1""")
def s19_line_window(spark, sf_dir):
    """Lines 2 to 12 under a budget of 600 characters; the first line always fits."""
    from pyspark.sql import Window

    rows = extract.lines(table(spark, sf_dir, "documents"), "doc_id", "text").where("line > 1 AND line <= 12")
    used = F.sum(F.length("content") + 1).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("used", used).where("used <= 600 OR line = 2")
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), (F.max("line") + 1).alias("continues"))
