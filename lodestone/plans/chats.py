"""Chat queries over conversations: soft deletes, next rows, folds, BM25 recall."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import search
from lodestone.plans.registry import query, table


@query("""SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations""")
def q18_next_message(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("role").over(w).alias("next_role"))


@query("""SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS questions FROM conversations c
WHERE EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'assistant') GROUP BY 1""")
def q16_sessions_with_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answered = c.where("role = 'assistant'").select("conv_id").distinct()
    return c.join(answered, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("questions"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT CASE WHEN i <= 2 THEN 'head' WHEN i > n - 6 THEN 'tail' ELSE 'folded' END AS band, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM r GROUP BY 1""")
def t07_conversation_fold(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").withColumns({"i": F.row_number().over(w.orderBy("turn")), "n": F.count("*").over(w)})
    return c.groupBy(search.fold_band(F.col("i"), F.col("n")).alias("band")).agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT conv_id, turn, list_aggregate(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 'string_agg', '|') AS before FROM conversations WHERE text IS NOT NULL""")
def j26_prior_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    before = F.collect_list("text").over(w)
    return c.select("conv_id", "turn", F.when(F.size(before) > 0, F.array_join(before, "|")).alias("before"))


@query("""WITH m AS (SELECT *, role <> 'assistant' AS open FROM conversations), s AS (SELECT conv_id, turn, open, max(turn) FILTER (NOT open) OVER (PARTITION BY conv_id) AS closed FROM m)
SELECT conv_id, count(*) FILTER (closed IS NULL OR turn > closed) AS streak FROM s GROUP BY 1""")
def w07_trailing_streak(spark, sf_dir):
    """Turns after the last answer of each conversation."""
    closed = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    c = table(spark, sf_dir, "conversations").withColumn("closed", closed)
    return c.groupBy("conv_id").agg(F.count_if(F.col("closed").isNull() | (F.col("turn") > F.col("closed"))).alias("streak"))


@query(r"""SELECT conv_id, turn, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 5) AS title, substr(text, 1, 40) AS head, length(text) > 40 AS truncated FROM conversations WHERE role = 'user'""")
def f15_thread_titles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", T.thread_title(F.col("text")).alias("title"), T.truncated(F.col("text"), 40).alias("t")).select(
        "conv_id", "turn", "title", F.col("t.text").alias("head"), "t.truncated"
    )


_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), l AS (SELECT doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
st AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
qt AS (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS term FROM benchmark),
t AS (SELECT doc_id, n, unnest(w) AS term FROM l), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT item_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc)
SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3 AND score >= 1.2""")
def t06_bm25_recall(spark, sf_dir):
    """The best three documents for each benchmark item over all documents."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != "")
    s = search.bm25(docs, "doc_id", words, asked, "item_id", words).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return s.withColumn("rank", rank).where("rank <= 3 AND score >= 1.2")
