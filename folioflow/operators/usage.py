"""Usage, cost, run metrics and queue roll-ups over agent events and task states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("noncached", "cached", "output")
#: Rows that one block of a running sum holds, on average, and blocks at most; blocks grow beyond that, sorted with spills.
BLOCK, BLOCKS = 100_000, 200
# Kinds of agent tasks by falling priority; cross-table tasks run under the limit of tables.
KINDS = ("find", "cross_table", "table", "image")


def usage_of(events: DataFrame, *by: str) -> DataFrame:
    """by, n, noncached, cached, input, output, total, cost: usage of assistant messages, with totals of each prefix.

    ``events``: by, noncached, cached, output, cost (nulls count as 0).  Cost has 6 places."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTS]
    out = events.rollup(*by).agg(F.count("*").alias("n"), *sums, F.bround(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"))
    out = out.withColumn("input", F.col("noncached") + F.col("cached"))
    return out.withColumn("total", F.col("input") + F.col("output")).withColumn("ratio", hit_ratio(F.col("cached"), F.col("input")))


def hit_ratio(cached: Column, read: Column) -> Column:
    """Share of input that came from a cache, 4 places; 0 where nothing was read."""
    return F.when(read > 0, F.bround(cached / read, 4)).otherwise(0.0)


def usage_rollup(events: DataFrame) -> DataFrame:
    """stage, job, n, tokens, cached, ratio: sums by job, by stage (job null) and in all (both null)."""
    out = events.rollup("stage", "job").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("cached").alias("cached"))
    return out.withColumn("ratio", hit_ratio(F.col("cached"), F.col("tokens")))


def log_profile(events: DataFrame) -> DataFrame:
    """job, n, tool_calls, types, text: what a job's log holds: events by type, tool calls, the last assistant text.

    ``events``: job, seq, type, role, text, tools (calls inside a message).  Types are counted before they are
    listed, so a long log is a handful of rows."""
    calls = F.sum(F.when(F.col("type") == "tool_execution_start", 1).otherwise(0)) + F.sum(F.coalesce("tools", F.lit(0)))
    said = (F.col("type") == "message_end") & (F.col("role") == "assistant") & (F.trim("text") != "")
    kinds = events.groupBy("job", "type").agg(F.count("*").alias("n"), calls.alias("calls"), F.max(F.when(said, F.struct("seq", "text"))).alias("last"))
    out = kinds.groupBy("job").agg(F.sum("n").alias("n"), F.sum("calls").alias("tool_calls"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"), F.max("last").alias("last"))
    return out.select("job", "n", "tool_calls", "types", F.col("last.text").alias("text"))


def last_text(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text: the last non-empty assistant text of each conversation."""
    said = turns.where((F.col("role") == "assistant") & (F.trim("text") != ""))
    last = said.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x"))
    return last.select("conv_id", "x.turn", "x.text")


def content_text(content: Column) -> Column:
    """A message's content as text: a JSON string as it is, of an array the texts of its text blocks by lines."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.when(F.startswith(F.trim(content), F.lit("[")), listed).when(F.startswith(F.trim(content), F.lit('"')), F.from_json(F.concat(F.lit('{"x":'), content, F.lit("}")), "x string")["x"]).otherwise("")


def running(ticks: DataFrame, key: str, at: str, add: str) -> DataFrame:
    """``ticks`` (key, at, add; one row for each key and at) with level, what added up to each row.

    A key may hold most rows, so sums run in up to BLOCKS blocks of about BLOCK rows, cut at quantiles of ``at``, and blocks
    carry over; a block is one task's work."""
    count = ticks.count()
    cuts = max(1, min(BLOCKS, -(-count // BLOCK)))
    edges = ticks.agg(F.percentile_approx(at, F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), 10_000)).first()[0] if cuts > 1 else []
    block = sum((F.when(F.col(at) > e, 1).otherwise(0) for e in edges), F.lit(0))
    dealt = ticks.withColumn("block", block)
    inside = Window.partitionBy(key, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy(key, "block").agg(F.sum(add).alias("sum"))  # one row a key and block
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(key, "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("carry"))
    own = dealt.withColumn("own", F.sum(add).over(inside))
    return own.join(carry, [key, "block"]).select(*ticks.columns, (F.col("own") + F.col("carry")).alias("level"))


def scheduler_summary(records: DataFrame) -> DataFrame:
    """stage, n, peak: records of each kind and the largest number running at once.

    Each record starts at ``ts`` and runs ``run`` seconds; ends count before starts of the same time."""
    ticks = records.select("stage", "ts", F.lit(1).alias("d")).unionByName(records.select("stage", (F.col("ts") + F.col("run")).alias("ts"), F.lit(-1).alias("d")))
    sums = ticks.groupBy("stage", "ts").agg(F.sum("d").alias("net"), F.count_if(F.col("d") > 0).alias("up"))
    level = running(sums, "stage", "ts", "net")
    return level.groupBy("stage").agg(F.sum("up").alias("n"), F.max("level").alias("peak"))


def status_counts(records: DataFrame) -> DataFrame:
    """stage, status, n, wait, run: records by kind and state, and the seconds they waited and ran."""
    seconds = [F.bround(F.sum(F.coalesce(c, F.lit(0.0))), 3).alias(n) for c, n in (("wait_seconds", "wait"), ("run_seconds", "run"))]
    return records.groupBy("stage", "status").agg(F.count("*").alias("n"), *seconds)


def percentiles(values: DataFrame, q: float = 0.2) -> DataFrame:
    """stage, p: nearest-rank percentile of ``v``: at zero-based place (n - 1) * q, rounded half to even.

    Equal values are counted and counts run up over blocks, so a stage of any size is never one list."""
    counts = values.where("v is not null").groupBy("stage", "v").agg(F.count("*").alias("n"))
    place = counts.groupBy("stage").agg(F.bround((F.sum("n") - 1) * F.lit(q)).alias("place"))
    upto = running(counts, "stage", "v", "n").join(place, "stage").where(F.col("level") > F.col("place"))
    return upto.groupBy("stage").agg(F.min("v").alias("p"))


def latest_failure(states: DataFrame) -> DataFrame:
    """doc, task, ended: the failed task that ended last, ties to the task that sorts last."""
    last = states.where("status = 'failed'").groupBy("doc").agg(F.max(F.struct("ended", "task")).alias("x"))
    return last.select("doc", "x.task", "x.ended")


def metrics(states: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """doc, wall_seconds, tasks, work (by stage), pages (of tables), usage (by stage), total: a run's report.

    ``states``: doc, task, status, elapsed; ``jobs``: doc, stage, page, elapsed, pages (that a job covered);
    ``events``: doc, stage and what usage_of takes.  Wall time sums completed tasks; work sums jobs.  Each
    input is summed by document and stage before documents meet."""
    task = F.struct("task", "status", F.bround("elapsed", 3).alias("elapsed"))
    wall = states.groupBy("doc").agg(F.bround(F.sum(F.when(F.col("status") == "completed", F.col("elapsed")).otherwise(0.0)), 3).alias("wall_seconds"), F.sort_array(F.collect_list(task)).alias("tasks"))
    by_page = jobs.groupBy("doc", "stage", "page").agg(F.sum("elapsed").alias("seconds"), F.flatten(F.collect_list(F.coalesce("pages", F.array().cast("array<int>")))).alias("covered"))
    page = F.struct("stage", "page", F.bround("seconds", 3).alias("seconds"), F.array_sort(F.array_distinct("covered")).alias("covered"))
    pages = by_page.groupBy("doc").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    stage = by_page.groupBy("doc", "stage").agg(F.sum("seconds").alias("seconds"))
    work = stage.groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", F.bround("seconds", 3))))).alias("work"))
    used = usage_of(events, "doc", "stage").where("doc is not null")
    item = F.struct("stage", *COUNTS, "input", "total", "cost", "ratio")
    usage = used.groupBy("doc").agg(F.sort_array(F.collect_list(F.when(F.col("stage").isNotNull(), item))).alias("usage"), F.max(F.when(F.col("stage").isNull(), item)).alias("total"))
    return wall.join(work, "doc", "full_outer").join(pages, "doc", "full_outer").join(usage, "doc", "full_outer")


def after_rerun(usage: DataFrame, again: DataFrame, stage: str = "table") -> DataFrame:
    """doc, stage, noncached, cached, output, cost: usage after one stage ran again: its old rows give way where a
    document was run again, all others stay."""
    columns = ["doc", "stage", *COUNTS, "cost"]
    gone = again.select("doc").distinct().withColumn("stage", F.lit(stage))
    return usage.select(*columns).join(gone, ["doc", "stage"], "left_anti").unionByName(again.withColumn("stage", F.lit(stage)).select(*columns))


def batch_outcome(jobs: DataFrame) -> DataFrame:
    """batch, discovered, pending, succeeded, failed, skipped, invalid, interrupted, status of each batch of documents."""
    kinds = ("pending", "succeeded", "failed", "skipped", "invalid", "interrupted")
    out = jobs.groupBy("batch").agg(F.count("*").alias("discovered"), *(F.count_if(F.col("state") == k).alias(k) for k in kinds))
    status = F.when(F.col("interrupted") > 0, "interrupted").when((F.col("failed") > 0) | (F.col("invalid") > 0), "failed").otherwise("completed")
    return out.withColumn("status", status)


def result_counts(tables: DataFrame, layout: DataFrame, images: DataFrame) -> DataFrame:
    """doc, tables, images, layout_tables and the numbers of replaced, absorbed, ambiguous and unmatched ones."""
    states = {"replaced": "replaced", "absorbed": "absorbed_into_merged_table", "ambiguous": "ambiguous_continuation", "unmatched": "unmatched"}
    t, i = (d.groupBy("doc").agg(F.count("*").alias(n)) for d, n in ((tables, "tables"), (images, "images")))
    lay = layout.groupBy("doc").agg(F.count("*").alias("layout_tables"), *(F.count_if(F.col("status") == v).alias(k) for k, v in states.items()))
    out = t.join(i, "doc", "full_outer").join(lay, "doc", "full_outer")
    return out.select("doc", *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "doc"))


def monotone(before: DataFrame, now: DataFrame, key: str = "doc") -> DataFrame:
    """Counters by ``key`` that never fall: of both readings the larger one, each counter for itself."""
    names = [c for c in now.columns if c != key]
    both = before.select(key, *names).unionByName(now.select(key, *names))
    return both.groupBy(key).agg(*(F.max(c).alias(c) for c in names))


def discovered(records: DataFrame, active: DataFrame, ready: DataFrame) -> DataFrame:
    """doc, discovered: groups known so far, finished, running and ready ones together."""
    every = records.select("doc").unionByName(active.select("doc")).unionByName(ready.select("doc"))
    return every.groupBy("doc").agg(F.count("*").alias("discovered"))


def dispatch(queue: DataFrame, running_: DataFrame, limits: dict[str, int], workers: int = 5) -> DataFrame:
    """doc, kind, sequence: queued tasks that may start now: kinds by priority, first come first served, under the
    limit of each kind and of all workers.  ``queue``: doc, kind, sequence; ``running_``: doc, kind."""
    shared = lambda c: F.when(c == "cross_table", "table").otherwise(c)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    busy = running_.groupBy("doc", shared(F.col("kind")).alias("group")).agg(F.count("*").alias("busy"))
    all_ = running_.groupBy("doc").agg(F.count("*").alias("all"))
    allowed = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    waiting = queue.withColumn("rank", rank).withColumn("group", shared(F.col("kind"))).join(busy, ["doc", "group"], "left").join(all_, "doc", "left")
    turn = F.row_number().over(Window.partitionBy("doc", "group").orderBy("rank", "sequence"))
    free = waiting.withColumn("turn", turn).where(F.col("turn") <= F.coalesce(F.try_element_at(allowed, F.col("group")), F.lit(workers)) - F.coalesce("busy", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("rank", "sequence"))
    return free.withColumn("place", place).where(F.col("place") <= workers - F.coalesce("all", F.lit(0))).select("doc", "kind", "sequence")
