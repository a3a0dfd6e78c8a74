"""The code-search door: a stated set of queries against a corpus of files, by words.

A corpus row is a file with its path, the names of its symbols and a summary. Queries are few
and stated: their words go to the executors in blocks, and every file is scored for a block's queries in the
scan itself, so nothing is shuffled but hits: counts are summed before the exchange, and a
rank filter lets each task keep only the best of each query. Queries without any hit are asked again with
Han pairs, if their words are rare enough and two of them hit side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Bounds of the search and of what it shows.
MAX_TOKENS, DEFAULT_LIMIT, MAX_LIMIT = 12, 10, 15
MAX_CHARS, SYMBOLS_SHOWN, UNITS_SHOWN, SUMMARY_CHARS = 2_000, 6, 2, 160
DF_SHARE, DF_LEAST, FALLBACK_HITS = 0.12, 3, 2
WEIGHTS = {"path": 3, "symbols": 3, "summary": 2}
#: Queries scored in one scan.
BLOCK = 64


def build_corpus(files: DataFrame, symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """(path, lines, names, units, summary) of the files that have symbols or are listed as analysed:
    files (path, lines), symbols (path, name, line), summaries (path, summary). Names count once, units keep their lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "name")))
    per = symbols.groupBy("path").agg(ordered.alias("s"))
    units = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line")))
    named = per.select("path", F.array_distinct(F.transform("s", lambda x: x["name"])).alias("names"), units.alias("units"))
    short = F.when(F.length("summary") > SUMMARY_CHARS, F.concat(F.left("summary", F.lit(SUMMARY_CHARS)), F.lit("…"))).otherwise(F.col("summary"))
    met = files.select("path", "lines").join(named, "path", "full_outer").join(summaries.select("path", short.alias("summary")), "path", "left")
    none = F.array().cast("array<string>")
    return met.select("path", "lines", F.coalesce("names", none).alias("names"), F.coalesce("units", F.array().cast("array<struct<name:string,line:int>>")).alias("units"), F.coalesce("summary", F.lit("")).alias("summary"))


def query_tokens(text: Column, most: int = MAX_TOKENS) -> Column:
    """The query's themes and words of two characters or more, in order, once each."""
    low = F.lower(F.trim(text))
    return F.slice(F.filter(F.array_distinct(F.concat(T.theme_tokens(low), T.words_of(low))), lambda t: F.length(t) >= 2), 1, most)


def _faces(corpus: DataFrame) -> DataFrame:
    """The corpus with its searched texts in lower case, and their words."""
    texts = {"path": F.lower("path"), "symbols": F.lower(F.array_join("names", " ")), "summary": F.lower("summary")}
    texts["all"] = F.concat_ws(" ", *texts.values())
    return corpus.withColumns({f"f_{k}": v for k, v in texts.items()}).withColumns({f"w_{k}": T.words_of(F.col(f"f_{k}")) for k in texts})


def _hits(token: Column, text: Column, words: Column) -> Column:
    """token_hits over a text whose words are known."""
    loose = (F.length(token) >= 6) | token.rlike(r"[^\x00-\x7F]")
    return F.when(loose, F.contains(text, token)).otherwise(F.exists(words, lambda w: F.startswith(w, token)))


def _hit_by(tokens: Column | str, face: str) -> Column:
    return F.filter(tokens, lambda t: _hits(t, F.col(f"f_{face}"), F.col(f"w_{face}")))


def _evidence(text: Column, tokens: Column) -> Column:
    """How many of the tokens stand in a text side by side: overlapping ones count once."""
    start = lambda t: F.greatest(F.instr(text, t) - 1, F.lit(0))
    spans = F.array_sort(F.transform(tokens, lambda t, k: F.struct(start(t).alias("a"), k.alias("k"), (start(t) + F.length(t)).alias("z"))))
    first = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"))
    step = lambda acc, s: F.when(s["a"] < acc["at"], acc).otherwise(F.struct(s["z"].alias("at"), (acc["n"] + 1).alias("n")))
    return F.aggregate(spans, first, step, lambda acc: acc["n"])


def score(corpus: DataFrame, queries: list[tuple[object, list[str]]], least: int) -> DataFrame:
    """(query, path, lines, names, summary, score, faces, near) of the files that each query hits at `least` places."""
    faced = _faces(corpus)
    out = None
    for at in range(0, len(queries), BLOCK):
        block = F.array(*[F.struct(F.lit(q).alias("query"), F.array(*map(F.lit, tokens)).cast("array<string>").alias("tokens")) for q, tokens in queries[at : at + BLOCK]])
        rows = faced.withColumn("q", F.explode(block))
        rows = rows.withColumns({f"h_{k}": _hit_by("q.tokens", k) for k in WEIGHTS}).where(" OR ".join(f"size(h_{k}) > 0" for k in WEIGHTS))
        if least > 1:
            rows = rows.where(sum((_evidence(F.col(f"f_{k}"), F.col(f"h_{k}")) for k in WEIGHTS), F.lit(0)) >= least)
        total = sum((F.size(f"h_{k}") * w for k, w in WEIGHTS.items()), F.lit(0))
        capped = F.when(T.is_test_path(F.col("path")), F.least(total, F.lit(1))).otherwise(total)
        near = F.slice(F.filter("units", lambda u: F.exists("h_symbols", lambda t: T.token_hits(t, F.lower(u["name"])))), 1, UNITS_SHOWN)
        faces = F.array_compact(F.array(*[F.when(F.size(f"h_{k}") > 0, k) for k in WEIGHTS]))
        found = rows.select("q.query", "path", "lines", "names", "summary", capped.alias("score"), faces.alias("faces"), near.alias("near"))
        out = found if out is None else out.unionByName(found)
    return out


def _best(scored: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The best of each query, and how many files each hits."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "path"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit), scored.groupBy("query").agg(F.count("*").alias("hits"))


def search(corpus: DataFrame, queries: DataFrame, key: str, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(query, hits, segmented, rank, path, lines, names, summary, score, faces, near): the best files of each query;
    queries without words are left out. `segmented` tells that only the second asking found them."""
    limit = max(1, min(MAX_LIMIT, limit))
    full = queries.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    loose = query_tokens(T.segment_for_lookup(F.trim(F.col(text))), 3 * MAX_TOKENS)
    asked = [(r.query, r.tokens, r.loose) for r in full.select(F.col(key).alias("query"), query_tokens(F.col(text)).alias("tokens"), loose.alias("loose")).orderBy("query").collect()]
    best, hits = _best(score(corpus, [(q, t) for q, t, _ in asked], 1), limit) if asked else (None, None)
    if best is None:
        empty = score(corpus, [(0, ["?"])], 1).where(F.lit(False))
        best, hits = _best(empty, limit)
        return _finish(best, hits, False)
    found = _finish(best, hits, False)
    met = {r.query for r in hits.select("query").collect()}
    rest = [(q, t) for q, _, t in asked if q not in met]
    rare = _rare(corpus, sorted({x for _, t in rest for x in t}))
    again = [(q, kept) for q, t in rest if len(kept := [x for x in t if x in rare][:MAX_TOKENS]) >= FALLBACK_HITS]
    if not again:
        return found
    return found.unionByName(_finish(*_best(score(corpus, again, FALLBACK_HITS), limit), True))


def _finish(best: DataFrame, hits: DataFrame, segmented: bool) -> DataFrame:
    return best.join(hits, "query").select("query", "hits", F.lit(segmented).alias("segmented"), "rank", "path", "lines", "names", "summary", "score", "faces", "near")


def _rare(corpus: DataFrame, tokens: list[str]) -> set[str]:
    """Tokens that few enough files hold."""
    if not tokens:
        return set()
    faced = _faces(corpus)
    held = _hit_by(F.array(*map(F.lit, tokens)), "all")
    counts = {r.t: r.n for r in faced.select(F.explode(held).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    most = max(DF_LEAST, int(corpus.count() * DF_SHARE))
    return {t for t in tokens if counts.get(t, 0) <= most}


def _block() -> Column:
    """How a hit is shown; the words are fixed values, as their length counts against the budget."""
    faces = F.transform("faces", lambda f: F.when(f == "path", "路径").when(f == "symbols", "符号").otherwise("职责"))
    lines = F.when(F.col("lines").isNull(), "行数未知").otherwise(F.concat(F.col("lines").cast("string"), F.lit(" 行")))
    test = F.when(T.is_test_path(F.col("path")), "，测试文件").otherwise("")
    names = F.when(F.size("names") == 0, "（无符号）").otherwise(F.array_join(F.slice("names", 1, SYMBOLS_SHOWN), ", "))
    more = F.when(F.size("names") > SYMBOLS_SHOWN, F.concat(F.lit("…共 "), F.size("names").cast("string"), F.lit(" 个符号"))).otherwise("")
    units = F.array_join(F.transform("near", lambda u: F.concat_ws(":", u["name"], u["line"].cast("string"))), "、")
    near = F.when(F.size("near") > 0, F.concat(F.lit("\n  就近: "), units)).otherwise("")
    duty = F.when(F.col("summary") != "", F.concat(F.lit("\n  职责: "), "summary")).otherwise("")
    return F.concat(F.lit("- "), "path", F.lit("（"), lines, test, F.lit("）【命中 "), F.col("score").cast("string"), F.lit("："), F.array_join(faces, "/"), F.lit("】\n  符号: "), names, more, near, duty)


def shown(found: DataFrame) -> DataFrame:
    """Hits with `block`, as far as a query's blocks stay within the budget of characters."""
    used = F.sum(F.length("block")).over(Window.partitionBy("query").orderBy("rank"))
    return found.withColumn("block", _block()).withColumn("used", used).where(F.col("used") <= MAX_CHARS)
