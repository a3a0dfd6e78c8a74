"""Rules and text functions over columns of the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import learning as L
from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.plans.registry import query, table
from lodestone.sources import repository


def _pick(at, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _sql_pick(at, *values):
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[CAST({at} % {len(values)} AS INTEGER) + 1]"


@query(r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(t)), '|') AS tokens FROM (SELECT p_partkey, list_prepend(lower(x), list_filter(string_split_regex(lower(x), '[\s,，、/·:：_-]+'), lambda w: length(w) >= 2)) AS t
  FROM (SELECT p_partkey, p_name || ' - ' || p_brand || '/a:' || p_type AS x FROM part))""")
def f01_theme_tokens(spark, sf_dir):
    """Sorted, as the twin's distinct keeps no order."""
    x = F.concat_ws("", "p_name", F.lit(" - "), "p_brand", F.lit("/a:"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.theme_tokens(x)), "|").alias("tokens"))


@query("""SELECT p_partkey, '漢字 字解 解析 ' || p_name || ' 中文 ' || p_brand || ' 一' AS looked_up FROM part""")
def f02_lookup_segments(spark, sf_dir):
    x = F.concat(F.lit("漢字解析 "), "p_name", F.lit(" 中文"), "p_brand", F.lit("一"))
    return table(spark, sf_dir, "part").select("p_partkey", T.segment_for_lookup(x).alias("looked_up"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '') AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(words, lambda x: starts_with(x, 'the'))) > 0 AS short_hit, contains(lower(text), 'license') AS long_hit, contains(lower(text), 'é') AS other_hit FROM w""")
def f04_token_hits(spark, sf_dir):
    hit = lambda t: T.token_hits(F.lit(t), F.col("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", hit("the").alias("short_hit"), hit("license").alias("long_hit"), hit("é").alias("other_hit"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(u, 'repo_[0-9a-f]+', ':repoId', 'gi'), '[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}', ':id', 'gi') AS route FROM (SELECT page_id, url || '/Repo_' || substr(md5(url), 1, 6) || 'g/'
  || substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12) AS u FROM pages)""")
def f06_masked_urls(spark, sf_dir):
    h = F.md5(F.col("url").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    u = F.concat(F.col("url"), F.lit("/Repo_"), F.substring(h, 1, 6), F.lit("g/"), uuid)
    return table(spark, sf_dir, "pages").select("page_id", T.mask_ids(u).alias("route"))


_SPECS = ("os.path.join", "org.acme.core.util.Lists", "System.Text.Json.Nodes", "github.com/acme/tool/pkg", "fmt/sub", "@acme/ui/button", "lodash/fp", "com.acme")
_SPEC_LANGUAGES = ("python", "java", "csharp", "go", "go", "node", "node", "java")


@query(f"""WITH s AS (SELECT p_partkey, {_sql_pick('p_partkey', *_SPECS)} AS spec, {_sql_pick('p_partkey', *_SPEC_LANGUAGES)} AS language FROM part)
SELECT p_partkey, CASE WHEN language = 'python' THEN split_part(spec, '.', 1) WHEN language IN ('java', 'csharp') THEN array_to_string(string_split(spec, '.')[:4], '.')
  WHEN language = 'go' THEN CASE WHEN contains(split_part(spec, '/', 1), '.') THEN array_to_string(string_split(spec, '/')[:3], '/') ELSE split_part(spec, '/', 1) END
  WHEN starts_with(spec, '@') THEN array_to_string(string_split(spec, '/')[:2], '/') ELSE split_part(spec, '/', 1) END AS identity FROM s""")
def f07_package_identities(spark, sf_dir):
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p, T.package_identity(_pick(p, *_SPEC_LANGUAGES), _pick(p, *_SPECS)).alias("identity"))


@query(f"""WITH s AS (SELECT p_partkey, string_split({_sql_pick('p_partkey', *_SPECS)}, '.') AS parts FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN len(parts) >= 2 THEN array_to_string(parts[:2], '.') END, CASE WHEN len(parts) >= 3 THEN array_to_string(parts[:3], '.') END], lambda x: x IS NOT NULL), ' ') AS roots FROM s""")
def f08_package_roots(spark, sf_dir):
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p, F.array_join(T.package_roots(_pick(p, *_SPECS)), " ").alias("roots"))


@query("SELECT event_id, substr(sha256(user_id || '|' || event_type || '|' || event_id), 1, 24) AS id FROM events")
def f09_deterministic_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.short_hash(F.concat_ws("|", "user_id", "event_type", "event_id"), 24).alias("id"))


@query("SELECT event_id, CASE WHEN value / 400 >= 0.95 THEN 5 WHEN value / 400 >= 0.8 THEN 4 WHEN value / 400 >= 0.6 THEN 3 WHEN value / 400 >= 0.4 THEN 2 WHEN value / 400 > 0 THEN 1 ELSE 0 END AS quality FROM events")
def f10_qualities(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", L.quality_for_score(F.col("value") / 400).alias("quality"))


_MODES, _KINDS, _TRIES = ("execution", "set_match", "rubric", "else", None), ("patch_edit", "llm_rubric", "impact_analysis", "author_function"), ("first", "retry", "review")


@query(f"""WITH e AS (SELECT event_id, {_sql_pick('event_id', *_MODES)} AS mode, {_sql_pick('event_id', *_KINDS)} AS kind, {_sql_pick('event_id', *_TRIES)} AS attempt, value > 100 AS passed FROM events)
SELECT event_id, round((CASE mode WHEN 'execution' THEN 1 WHEN 'set_match' THEN 0.8 WHEN 'rubric' THEN 0.5 ELSE CASE kind WHEN 'llm_rubric' THEN 0.5 WHEN 'patch_edit' THEN 1 WHEN 'author_function' THEN 1 ELSE 0.8 END END)::DOUBLE
  * (CASE WHEN attempt = 'review' THEN CASE WHEN passed THEN 0.5 ELSE -1 END WHEN passed THEN 1 ELSE -0.6 END)::DOUBLE, 6) AS delta FROM e""")
def f11_answer_deltas(spark, sf_dir):
    i = F.col("event_id")
    weight = L.evidence_weight(_pick(i, *_MODES), _pick(i, *_KINDS)) * L.answer_weight(_pick(i, *_TRIES), F.col("value") > 100)
    return table(spark, sf_dir, "events").select(i, F.round(weight, 6).alias("delta"))


_STEPS = ("prompt-1", "code-2-x", "tests", "other-1", "")


@query(f"""SELECT event_id, CASE {_sql_pick('event_id', *_KINDS)} WHEN 'llm_rubric' THEN 'analysis' WHEN 'patch_edit' THEN 'design' WHEN 'author_function' THEN 'design' ELSE 'comprehension' END AS type,
  CASE event_id % 5 WHEN 0 THEN 'prompt' WHEN 1 THEN 'code' WHEN 2 THEN 'tests' END AS segment FROM events""")
def f12_exercise_types(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i, R.exercise_type(_pick(i, *_KINDS)).alias("type"), R.segment_of_step(_pick(i, *_STEPS)).alias("segment"))


@query("SELECT event_id, CAST(greatest(0, floor((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 86400000000)) AS INTEGER) AS days FROM events")
def f13_days_since(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.days_since(F.col("ts").cast("timestamp"), F.lit(datetime(2024, 1, 20, 12)).cast("timestamp")).alias("days"))


@query("""WITH n AS (SELECT page_id, page_id % 4 AS repository, substr(trim(regexp_replace('  ' || split_part(url, '/', 3) || '   map  ', '\\s+', ' ', 'g')), 1, 40) AS wanted FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY repository, wanted ORDER BY page_id) AS n FROM n) SELECT page_id, CASE WHEN n = 1 THEN wanted ELSE wanted || ' (' || n || ')' END AS name FROM r""")
def f16_diagram_names(spark, sf_dir):
    """Names made unique within a repository by a counter, in order of creation."""
    wanted = R.diagram_name(F.concat(F.lit("  "), F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.lit("   map  ")))
    rows = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4).alias("repository"), wanted.alias("wanted"))
    n = F.row_number().over(Window.partitionBy("repository", "wanted").orderBy("page_id"))
    return rows.withColumn("n", n).select("page_id", F.when(F.col("n") == 1, F.col("wanted")).otherwise(F.concat("wanted", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'sym:' || p_brand || '|text:' || p_name || '/mod:a' WHEN 1 THEN 'call:x|sym:' || p_brand WHEN 2 THEN '' END AS probes FROM part""")
def f18_probes(spark, sf_dir):
    p = F.col("p_partkey")
    raw = F.when(p % 3 == 0, F.concat(F.lit(" sym:"), "p_brand", F.lit(" & text:"), "p_name", F.lit(" & ; mod:a;"))).when(p % 3 == 1, F.concat(F.lit("call:x &sym:"), "p_brand")).otherwise(" ; & ")
    return table(spark, sf_dir, "part").select(p, F.array_join(F.transform(R.probes(raw), lambda g: F.array_join(g, "|")), "/").alias("probes"))


@query("SELECT p_partkey, CAST(floor(32768 * 4 * (p_size / 100.0::DOUBLE)) AS BIGINT) AS chars FROM part")
def f21_context_shares(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.share_of_context(32768, F.col("p_size") / F.lit(100.0)).alias("chars"))


_ENDINGS = (".TS", "mjs", " .vue ", "py", ".java", "go", ".rs", "cs", ".HPP", "kt", "", "constructor")


@query(f"""SELECT p_partkey, {_sql_pick('p_partkey', 'typescript', 'typescript', 'vue', 'python', 'java', 'go', 'rust', 'csharp', 'cpp', None, None, None)} AS language FROM part""")
def f22_languages(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.language_of(_pick(F.col("p_partkey"), *_ENDINGS)).alias("language"))


_FOLDERS, _NEAR = ("src/a", "src/b", "lib", "lib/x", "docs"), ("src/a", "lib")


@query(f"""SELECT p_partkey, CASE WHEN f IN ('src/a', 'lib') THEN 60 ELSE 0 END + CASE WHEN split_part(f, '/', 1) IN ('src', 'lib') THEN 15 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 45 ELSE 0 END + least(p_size, 10) AS relevance
  FROM (SELECT *, {_sql_pick('p_partkey', *_FOLDERS)} AS f FROM part)""")
def f24_relevance(spark, sf_dir):
    near = F.array(*map(F.lit, _NEAR))
    return table(spark, sf_dir, "part").select("p_partkey", R.relevance(_pick(F.col("p_partkey"), *_FOLDERS), near, F.col("p_size") % 2 == 0, F.col("p_size")).alias("relevance"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::BIGINT AS missing, event_id % 2 = 0 AS valid FROM events")
def f26_json_fields(spark, sf_dir):
    """Typed fields of a payload; what doesn't parse is null."""
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("x"), "props"))
    number = lambda path: F.get_json_object("props", path).cast("long")
    return table(spark, sf_dir, "events").select("event_id", number("$.k").alias("k"), number("$.none.z").alias("missing"), F.try_parse_json(broken).isNotNull().alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS object, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def f27_reply_objects(spark, sf_dir):
    """The object in a reply with words around it."""
    m = F.col("event_id") % 3
    reply = F.when(m == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n``` done"))).when(m == 1, F.concat(F.lit("x "), "props")).otherwise("none at all }")
    found = R.first_object(reply)
    return table(spark, sf_dir, "events").select("event_id", found.alias("object"), F.get_json_object(found, "$.k").cast("long").alias("k"))


@query("SELECT event_id, strftime(ts, '%m-%d %H:%M') AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events")
def f29_time_stamps(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", R.version_stamp(ts).alias("stamp"), F.date_format(ts, "yyyy-MM-dd").alias("day"))


@query("""WITH g AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_partkey FROM part),
h AS (SELECT p_brand, 32 + greatest(1, ceil(count(*) / 5.0)) * 112 + (greatest(1, ceil(count(*) / 5.0)) - 1) * 32 + 28 AS h FROM g GROUP BY 1),
t AS (SELECT p_brand, h, 80 + coalesce(sum(h + 28) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM h)
SELECT p_partkey, CAST(108 + (i % 5) * 296 AS INTEGER) AS x, CAST(y + 32 + (i // 5) * 144 AS INTEGER) AS y FROM g JOIN t USING (p_brand)""")
def f30_layout(spark, sf_dir):
    """Groups below each other, their boxes in rows of five. Groups are brands, as many as a diagram shows."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i"))
    heights = rows.groupBy("p_brand").agg(R.group_height(F.count("*")).alias("h"))
    above = F.sum(F.col("h") + R.BETWEEN).over(Window.orderBy("p_brand").rowsBetween(Window.unboundedPreceding, -1))
    tops = heights.select("p_brand", (F.coalesce(above, F.lit(0)) + R.ORIGIN).alias("top"))
    place = R.cell_at(F.col("i"), F.lit(R.ORIGIN + R.PAD), F.col("top") + R.TITLE)
    return rows.join(tops, "p_brand").select("p_partkey", place.alias("at")).select("p_partkey", "at.x", "at.y")


_UNITS = ("impact:src/a.py", "implementation:symbol:x", "llm:topic one:2", "llm-code:t2:9", "workflow:y", "llm:", "llm-code::z")


@query(f"""WITH u AS (SELECT event_id, {_sql_pick('event_id', *_UNITS)} AS unit, CASE WHEN event_id % 2 = 0 THEN 'given' END AS topic FROM events)
SELECT event_id, event_id % 7 <> 4 AS live, coalesce(topic, CASE event_id % 7 WHEN 2 THEN 'topic one' WHEN 3 THEN 't2' END) AS topic FROM u""")
def p05_unit_topics(spark, sf_dir):
    """P04, P05 and the topic of P06: given, else named by the unit."""
    i, unit = F.col("event_id"), _pick(F.col("event_id"), *_UNITS)
    return table(spark, sf_dir, "events").select(i, R.is_live_unit(unit).alias("live"), F.coalesce(F.when(i % 2 == 0, "given"), R.topic_of_unit(unit)).alias("topic"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id WHEN event_id % 3 = 1 THEN 't' || user_id END AS unit, coalesce(CASE WHEN event_id % 4 = 0 THEN event_type END, 'unknown') AS kind FROM events""")
def p06_projection(spark, sf_dir):
    """unit_id, else target_unit_id; an unnamed kind is unknown."""
    i, m = F.col("event_id"), F.col("event_id") % 3
    u = F.col("user_id").cast("string")
    payload = F.create_map(F.lit("unit_id"), F.when(m == 0, F.concat(F.lit("u"), u)), F.lit("target_unit_id"), F.when(m < 2, F.concat(F.lit("t"), u)), F.lit("kind"), F.when(i % 4 == 0, F.col("event_type")))
    rows = table(spark, sf_dir, "events").select(i, payload.alias("p"))
    return rows.select(i, F.coalesce(F.col("p")["unit_id"], F.col("p")["target_unit_id"]).alias("unit"), F.coalesce(F.col("p")["kind"], F.lit("unknown")).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(value AS BIGINT) END AS number, event_id % 5 = 0 AS denied FROM (SELECT event_id, floor(value) AS value FROM events)""")
def p07_typed_scalars(spark, sf_dir):
    """Numbers and flags out of a payload of texts; what isn't a number is null."""
    i = F.col("event_id")
    payload = F.create_map(F.lit("n"), F.when(i % 3 == 0, "many").otherwise(F.floor("value").cast("string")), F.lit("denied"), F.when(i % 5 == 0, "true"))
    return table(spark, sf_dir, "events").select(i, payload.alias("p")).select(i, F.expr("try_cast(p['n'] AS BIGINT)").alias("number"), (F.coalesce(F.col("p")["denied"], F.lit("")) == "true").alias("denied"))


@query("""SELECT c_nationkey, count(*) >= 2 AND count(DISTINCT (c_custkey % 7, c_custkey % 3)) <= greatest(1, count(*) // 3) AS needed FROM customer GROUP BY 1""")
def p13_needs_layout(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy("c_nationkey").agg(R.needs_layout(F.count("*"), F.countDistinct(F.col("c_custkey") % 7, F.col("c_custkey") % 3)).alias("needed"))


@query("SELECT event_id, least(200, greatest(1, CAST(floor(value) AS BIGINT))) AS wanted, CASE WHEN event_id % 3 = 0 THEN 50 ELSE least(200, greatest(1, CAST(floor(value) AS BIGINT))) END AS given FROM events")
def p16_limits(spark, sf_dir):
    """Asked numbers of rows held between 1 and 200; 50 if none is asked."""
    asked = F.floor("value")
    held = L.clamp(asked, 1, 200).cast("long")
    return table(spark, sf_dir, "events").select("event_id", held.alias("wanted"), F.when(F.col("event_id") % 3 == 0, F.lit(50).cast("long")).otherwise(held).alias("given"))


@query("""WITH e AS (SELECT doc_id, text, [lang, source, 'License'] AS names FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(list_filter(names, lambda x: x IS NOT NULL AND contains(lower(text), lower(x)))) AS INTEGER) AS mentioned, len(list_filter(names, lambda x: x IS NOT NULL AND contains(lower(text), lower(x)))) = 0 AS low FROM e""")
def p17_anchor_coverage(spark, sf_dir):
    """How many of a file's first three names its text mentions; none is low coverage."""
    names = F.slice(F.array("lang", "source", F.lit("License"), F.lit("fourth")), 1, 3)
    n = F.size(F.filter(names, lambda x: F.coalesce(F.contains(F.lower("text"), F.lower(x)), F.lit(False))))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", n.alias("mentioned"), (n == 0).alias("low"))


_JUDGED = ("0.756", " 1.4 ", "-3", "", "none", "0.005", "1e-1", "NaN", "Infinity")


@query(f"SELECT event_id, {_sql_pick('event_id', 0.76, 1.0, 0.0, None, None, 0.01, 0.1, None, None)}::DOUBLE AS score FROM events")
def l08_rubric_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", _pick(F.col("event_id"), *_JUDGED).alias("raw"))
    return rows.select("event_id", R.rubric_score("raw").alias("score"))


@query("""WITH a AS (SELECT user_id, avg((value > 60)::INTEGER) AS a, avg((event_type = 'purchase')::INTEGER) AS b, count(*) % 5 AS rounds FROM events GROUP BY 1)
SELECT user_id, CASE WHEN a >= 0.5 THEN 'enabled' WHEN a >= 0.25 THEN CASE WHEN rounds >= 3 THEN 'grey' ELSE 'observe' END WHEN b < 0.25 THEN 'disabled' WHEN b < 0.5 THEN 'grey' ELSE 'tune_signal' END AS tier FROM a""")
def l10_tiers(spark, sf_dir):
    """A50's rates by exam point, and the tier that L10 decides from them."""
    rates = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.avg((F.col("value") > 60).cast("int")).alias("a"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("b"), (F.count("*") % 5).alias("rounds")
    )
    return rates.select("user_id", R.tier(F.col("a"), F.col("b"), F.col("rounds")).alias("tier"))


@query("""WITH r AS (SELECT user_id || ':' || event_type AS exercise, event_id, ts, value, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + to_days(CAST(1 + event_id % 3 AS INTEGER)) AS due FROM events)
SELECT event_id, CASE WHEN due IS NULL THEN 'first' WHEN due <= ts THEN 'review' ELSE 'retry' END AS attempt FROM r""")
def l03_online_attempts(spark, sf_dir):
    """Without a schedule an answer is the first, one that is due a review, any other a retry."""
    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("due", before + F.make_dt_interval((1 + F.col("event_id") % 3).cast("int")))
    return rows.select("event_id", F.when(F.col("due").isNull(), "first").when(F.col("due") <= F.col("ts"), "review").otherwise("retry").alias("attempt"))


_CONCEPTS = {"caching": ["cache", "redis"], "bolts": ["bolt", "screw"], "gadgetry": ["gadget", "Widget"], "io": ["io", "os"]}


@query("""WITH t AS (SELECT p_partkey, lower(p_name) AS n FROM part) SELECT p_partkey, concat_ws('|', CASE WHEN contains(n, 'bolt') OR contains(n, 'screw') THEN 'bolts' END, CASE WHEN contains(n, 'gadget') OR contains(n, 'widget') THEN 'gadgetry' END,
  CASE WHEN contains(n, 'cache') OR contains(n, 'redis') OR contains(n, 'caching') THEN 'caching' END) AS concepts FROM t""")
def t11_concepts(spark, sf_dir):
    """Part names hold concept words; `io` is too short to be found inside a name."""
    c = R.concepts(F.concat(F.lit(" "), "p_name"), _CONCEPTS)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(c), "|").alias("concepts"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 IN (1, 2) THEN 3 ELSE 0 END + CASE WHEN p_brand IN ('Brand#11', 'Brand#13', 'Brand#2', 'Brand#3') THEN 2 ELSE 0 END
  + CASE WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'cold') THEN 1 ELSE 0 END AS score FROM part""")
def t14_note_relevance(spark, sf_dir):
    of = lambda *x: F.array(*map(F.lit, x))
    score = R.note_relevance((F.col("p_size") % 5).cast("string"), F.col("p_brand"), F.col("p_name"), of("1", "2"), of("Brand#11", "Brand#13", "Brand#2", "Brand#3"), of("bolt", "cold"))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


_FILES = (".env", "a/.env.local", "b/.env.example", "prod.env", "x/credentials.json", "k/server.PEM", "id_rsa", "_netrc", "src/app.py", "docs/readme.md", "m/key.p8", ".env.dist", "img/a.png", "lib/x.min.js")


@query(f"""SELECT p_partkey, {_sql_pick('p_partkey', 'env', 'env', None, 'env', 'credential', 'key', 'credential', 'credential', None, None, 'key', None, None, None)} AS denied,
  p_partkey % 14 IN (8, 9, 13) AS ingested FROM part""")
def s05_denied_names(spark, sf_dir):
    path = _pick(F.col("p_partkey"), *_FILES)
    return table(spark, sf_dir, "part").select("p_partkey", repository.denied(path).alias("denied"), repository.ingested(path).alias("ingested"))


_RULES = ["# generated", "build/", "*.min.js", "!keep.min.js", "docs/**/draft?.md", "lib/vendor"]
_TREE = ("build/x.py", "src/build/x.py", "buildx/y.py", "a/b.min.js", "a/keep.min.js", "docs/a/b/draft1.md", "docs/draft22.md", "lib/vendor/z.c", "pkg/lib/vendor/z.c", "lib/vendors.c")


@query(f"SELECT p_partkey, {_sql_pick('p_partkey', True, True, False, True, False, True, False, True, True, False)} AS ignored FROM part")
def s04_ignored_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", repository.ignored(_pick(F.col("p_partkey"), *_TREE), _RULES).alias("ignored"))
