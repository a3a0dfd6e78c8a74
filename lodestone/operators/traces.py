"""Trace histories from a journal, and the settling of generations that never ended.

A journal is (ord, type, at, repository_id, session_id, trace_id, payload map of strings). Events of a trace are
ordered by time, then by `ord`. A run is one row, found by conditional aggregates with a
map-side part, so that a trace of any length is no list in memory; its steps are rows,
numbered within the trace. Orphans are found over starts and endings alone, which are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import settle

# What the scenes in a journal are called in a history.
SCENES = {
    "teach": "teaching.turn", "map_chat": "map.chat", "practice_chat": "practice.chat",
    "exercise_generate": "practice.generate", "exercise_generate_code": "practice.generate", "exercise_llm_generate": "practice.generate",
}
GENERATION = ("exercise_started", "exercise_generated", "exercise_declined", "exercise_aborted")
ENDINGS = ("exercise_generated", "exercise_declined", "exercise_aborted")
LIMITS = ("budget", "rounds", "reads")
QUIET_MINUTES = 30


def _p(key: str) -> Column:
    return F.col("payload")[key]


def _scene() -> Column:
    out = F.lit(None).cast("string")
    for name, shown in SCENES.items():
        out = F.when(_p("scene") == name, shown).otherwise(out)
    return out


def trace_runs(journal: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One row a run: scene, status, thread, title, start, end, tools and tokens.

    The first event of a known scene gives the scene; a trace with none is a generation if it
    has such an event, else no run. Status: aborted before error before limited before
    ok. Runs whose question was deleted (session_id, content) go, and so do aborted ones of a
    repository in which any message was deleted, as they can't be told apart."""
    rows = journal.where("trace_id IS NOT NULL").withColumns({"at_": F.struct("at", "ord"), "scene_": _scene()})
    kind = F.col("type")
    is_ = lambda *names: kind.isin(*names)
    turn = is_(*GENERATION, "turn_text", "turn_aborted") | (is_("loop_round", "turn_context", "token_usage") & F.col("scene_").isNotNull())
    first = lambda value, when: F.min_by(value, F.when(when, F.col("at_")))
    last = lambda value, when: F.max_by(value, F.when(when, F.col("at_")))
    loop, usage, text = is_("loop_round"), is_("token_usage"), is_("turn_text")
    counted = {"reads": ("tool_reads", "file_read"), "searches": ("tool_searches", "code_search"), "skills": ("tool_skills", "skill_read"), "external": ("tool_external", "mcp_call")}
    if deleted is not None:
        asked = deleted.select(F.col("session_id").alias("d_session"), F.col("content").alias("d_content"), F.lit(True).alias("gone")).distinct()
        hit = rows.where(text).join(asked, F.col("session_id").eqNullSafe(F.col("d_session")) & (_p("question") == F.col("d_content"))).select(F.col("repository_id").alias("h_repository"), F.col("trace_id").alias("h_trace")).distinct()
        rows = rows.join(hit, (F.col("trace_id") == F.col("h_trace")) & F.col("repository_id").eqNullSafe(F.col("h_repository")), "left_anti")
    runs = rows.groupBy("repository_id", "trace_id").agg(
        F.coalesce(first(F.col("scene_"), F.col("scene_").isNotNull()), F.when(F.bool_or(is_(*GENERATION)), F.lit("practice.generate"))).alias("scene"),
        F.bool_or(turn).alias("turn"),
        F.bool_or(is_("exercise_generated")).alias("generated"), F.bool_or(is_("exercise_declined")).alias("declined"),
        F.bool_or(is_("exercise_aborted", "turn_aborted")).alias("stopped"),
        last(_p("aborted"), loop).alias("loop_aborted"), last(_p("outcome"), loop).alias("outcome"), last(_p("stopped_by"), loop).alias("stopped_by"), last(_p("tool_rounds"), loop).cast("int").alias("rounds"),
        first(F.col("session_id"), F.col("session_id").isNotNull()).alias("thread_id"),
        F.nullif(F.trim(first(_p("title"), is_("exercise_generated"))), F.lit("")).alias("title"),
        first(_p("question"), text).alias("question"), first(_p("reason"), is_("exercise_declined")).alias("reason"),
        F.coalesce(first(_p("answer"), text), F.lit("")).alias("answer"), F.max(F.when(usage, F.col("at"))).alias("usage_at"), F.min(F.when(text, F.col("at"))).alias("text_at"),
        last(_p("input_tokens"), usage).cast("long").alias("input_tokens"), last(_p("output_tokens"), usage).cast("long").alias("output_tokens"), last(_p("provider"), usage).alias("provider"),
        F.bool_or(is_("turn_invariant") & (F.coalesce(_p("failed"), F.lit("")) != "")).alias("invariant_failed"),
        *(F.coalesce(last(_p(key), loop).cast("long"), F.count_if(is_(event))).alias(name) for name, (key, event) in counted.items()),
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"),
    )
    aborted = F.col("stopped") | (F.coalesce("loop_aborted", F.lit("")) == "true") | (F.coalesce("outcome", F.lit("")) == "aborted")
    failed = F.col("declined") | (F.coalesce("outcome", F.lit("")) == "failed")
    status = F.when(aborted, "aborted").when(failed, "error").when(F.col("stopped_by").isin(*LIMITS), "limited").otherwise("ok")
    runs = runs.where("scene IS NOT NULL AND turn").withColumn("status", status)
    purged = journal.where("type = 'message_deleted'").select(F.col("repository_id").alias("p_repository"), F.lit(True).alias("purged")).distinct()
    kept = runs.join(purged, F.col("repository_id").eqNullSafe(F.col("p_repository")), "left").drop("p_repository")
    return kept.where(~((F.col("status") == "aborted") & F.coalesce("purged", F.lit(False)))).drop("purged", "turn", "stopped", "loop_aborted", "declined")


def history(runs: DataFrame, limit: int, thread_id: str | None = None, scenes: tuple[str, ...] | None = None) -> DataFrame:
    """The latest runs; a run without a thread belongs to all."""
    if thread_id is not None:
        runs = runs.where(F.col("thread_id").isNull() | (F.col("thread_id") == thread_id))
    if scenes is not None:
        runs = runs.where(F.col("scene").isin(*scenes))
    return runs.orderBy(F.desc("ended_at"), "repository_id", "trace_id").limit(limit)


def _tool() -> Column:
    """struct(tool, ok) of an event that is a tool's step, else null."""
    step = lambda tool, ok: F.struct((tool if isinstance(tool, Column) else F.lit(tool)).alias("tool"), ok.alias("ok"))
    kind, true = F.col("type"), lambda key: F.coalesce(_p(key) == "true", F.lit(False))
    server, tool = F.coalesce(_p("server"), F.lit("")), F.coalesce(_p("tool"), F.lit(""))
    named = F.when((server != "") & (tool != ""), F.concat(F.lit("mcp__"), server, F.lit("__"), tool)).when(tool != "", tool).otherwise("mcp__unknown")
    return (
        F.when(kind == "file_read", step("read_file", ~true("denied") & (F.coalesce(_p("error"), F.lit("")) == "")))
        .when(kind == "code_search", step("search_code", F.lit(True)))
        .when(kind == "skill_read", step("read_skill", true("found")))
        .when(kind == "mcp_call", step(named, true("ok")))
        .when((kind == "turn_asked") & _p("outcome").isin("asked", "refused"), step("ask_user", _p("outcome") == "asked"))
        .when((kind == "diagram_created") & (_p("source") == "agent") | (kind == "diagram_edited") & (_p("via") == "agent"), step("set_diagram", F.lit(True)))
    )


def trace_steps(journal: DataFrame, runs: DataFrame) -> DataFrame:
    """(repository_id, trace_id, seq, kind, status, tool, at): the run's opening, then model replies and tools as they happened.

    A chat's model step is its answer; a generation's are its model replies; with neither, the
    usage stands for one. Tools count from `occurred_at` where it is given. At equal times models come first."""
    keys = ["repository_id", "trace_id"]
    rows = journal.join(runs.select(*keys, "answer"), keys)
    at = F.coalesce(F.try_to_timestamp(_p("occurred_at")), F.col("at"))
    tools = rows.withColumn("t", _tool()).where("t IS NOT NULL").select(*keys, F.lit("tool").alias("kind"), F.when(F.col("t.ok"), "ok").otherwise("error").alias("status"), F.col("t.tool").alias("tool"), at.alias("at"), F.lit(2).alias("rank"), "ord")
    shown = (F.coalesce(_p("reply"), F.lit("")) != "") | (F.coalesce(_p("detail"), F.lit("")) != "") | ((_p("finish_reason") == "stop") & _p("attempt").isNotNull())
    replies = rows.where((F.col("type") == "exercise_model_reply") & (F.col("answer") == "") & F.coalesce(shown, F.lit(False))).select(*keys, "at", "ord")
    model = lambda df: df.select(*keys, F.lit("model").alias("kind"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("tool"), "at", F.lit(1).alias("rank"), "ord")
    answers = runs.where("answer <> ''").select(*keys, F.col("text_at").alias("at"), F.lit(0).cast("long").alias("ord"))
    silent = runs.where("answer = '' AND usage_at IS NOT NULL").join(replies.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("usage_at").alias("at"), F.lit(0).cast("long").alias("ord"))
    opening = runs.select(*keys, F.lit("turn").alias("kind"), "status", F.lit(None).cast("string").alias("tool"), F.col("started_at").alias("at"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ord"))
    every = opening.unionByName(tools).unionByName(model(answers)).unionByName(model(replies)).unionByName(model(silent))
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("rank") != 0, "at", "rank", "ord")) - 1
    return every.select(*keys, seq.alias("seq"), "kind", "status", "tool", "at")


def numbered_starts(marks: DataFrame) -> DataFrame:
    """marks (repository_id, at, ord, starts, ...) with `segment`, the number of a repository's starts up to a mark.
    Marks are dealt to ranges of time, counted within each range and moved on by the starts of the ranges before."""
    ranged = marks.repartitionByRange("repository_id", "at", "ord").withColumn("__part", F.spark_partition_id())
    # kept, so that ranges drawn twice can't differ
    within = Window.partitionBy("repository_id", "__part").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = settle(ranged.withColumn("segment", F.sum(F.col("starts").cast("long")).over(within)))
    counts = rows.groupBy("repository_id", "__part").agg(F.max("segment").alias("n"))
    earlier = Window.partitionBy("repository_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("repository_id").alias("__of"), F.col("__part").alias("__at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    # a row for each repository and range
    moved = rows.join(F.broadcast(before), (F.col("__part") == F.col("__at")) & F.col("repository_id").eqNullSafe(F.col("__of")))
    return moved.select(*marks.columns, (F.col("segment") + F.col("__before")).alias("segment"))


def settle_orphans(journal: DataFrame, now: Column, active: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Journal rows that end what was interrupted: exercise_aborted, and token_usage where the
    log of model calls (trace_id, scene, model, input, output) knows what was used and the journal doesn't.

    A generation runs from its start to the repository's next start; without an ending between
    them, and if its job isn't `active` (job_id), it was interrupted. Older traces have no start: those with a
    model reply but neither start nor ending are settled when their first reply is 30 minutes old."""
    kind = F.col("type")
    starts, ends = kind == "exercise_started", kind.isin(*ENDINGS)
    marks = journal.where(starts | ends | (kind == "token_usage")).select(
        "repository_id", "at", "ord", starts.alias("starts"), ends.alias("ends"), *[F.when(starts, c).alias(n) for n, c in {"trace_id": F.col("trace_id"), "job_id": _p("job_id"), "tag": _p("tag")}.items()]
    )
    start = lambda value: F.min_by(value, F.when(F.col("starts"), F.struct("at", "ord")))
    runs = numbered_starts(marks).where("segment > 0").groupBy("repository_id", "segment").agg(
        F.bool_or("ends").alias("ended"), F.bool_or(~F.col("starts") & ~F.col("ends")).alias("used"),
        start(F.col("trace_id")).alias("trace_id"), start(F.col("job_id")).alias("job_id"), F.coalesce(start(F.col("tag")), F.lit("")).alias("tag"), start(F.col("at")).alias("started_at"),
    ).where("NOT ended")
    if active is not None:
        runs = runs.join(active.select("job_id").distinct(), "job_id", "left_anti")
    columns = ["repository_id", "trace_id", "job_id", "tag", "started_at", "used"]
    known = kind.isin("exercise_model_reply", "exercise_started", *ENDINGS, "token_usage")
    replies = journal.where(F.col("trace_id").isNotNull() & known).groupBy("repository_id", "trace_id").agg(
        F.min(F.when(kind == "exercise_model_reply", F.col("at"))).alias("started_at"), F.bool_or(kind.isin("exercise_started", *ENDINGS)).alias("known"), F.bool_or(kind == "token_usage").alias("used"),
    )
    quiet = F.col("started_at") <= now - F.expr(f"INTERVAL {QUIET_MINUTES} MINUTES")
    old = replies.where(F.col("started_at").isNotNull() & ~F.col("known") & quiet).withColumns({"job_id": F.lit(None).cast("string"), "tag": F.lit("")})
    settled = runs.select(*columns).unionByName(old.select(*columns))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    pairs = lambda **x: F.map_from_arrays(F.array(*map(F.lit, x)), F.array(*x.values()))
    end = settled.select("repository_id", "trace_id", F.lit("exercise_aborted").alias("type"), pairs(scene=F.lit("practice.generate"), reason=F.lit("interrupted"), job_id=F.col("job_id"), tag=F.col("tag"), started_at=text(F.col("started_at"))).alias("payload"))
    if calls is None:
        return end
    spent = calls.where(F.col("scene").startswith("practice.generate")).groupBy("trace_id").agg(
        F.coalesce(F.sum("input"), F.lit(0)).alias("input"), F.coalesce(F.sum("output"), F.lit(0)).alias("output"), F.coalesce(F.min_by("model", F.when(F.col("model") != "", F.col("ord"))), F.lit("")).alias("model")
    ).where("input <> 0 OR output <> 0")
    usage = settled.where("NOT used AND trace_id IS NOT NULL").join(spent, "trace_id").select(
        "repository_id", "trace_id", F.lit("token_usage").alias("type"),
        pairs(input_tokens=F.col("input").cast("string"), output_tokens=F.col("output").cast("string"), provider=F.col("model"), scene=F.lit("exercise_generate_code"), outcome=F.lit("interrupted")).alias("payload"),
    )
    return end.unionByName(usage)
