"""Calls of agents behind one contract, their replies as rows; prompts; what page lists and extractor code say.

An agent is any callable (prompt, images) -> (reply, usage); which program answers is not the engine's business.
Calls run in Python workers, one job a row; a call that fails or takes too long is a row too, never a failed job.
"""

from __future__ import annotations

import ast
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Agent = Callable[[str, list[bytes]], tuple[str, dict]]
REPLY = "doc long, job string, status string, code int, attempts int, reply string, input long, cached long, output long, cost double, seconds double, message string"
TIMED_OUT = 124


def replies(jobs: DataFrame, agent: Agent, check: Callable[[str], list[str]] | None = None, attempts: int = 2, timeout: float = 1800.0) -> DataFrame:
    """REPLY of each job (doc, job, prompt, images: array of binary).

    ``check`` lists what is wrong with a reply; as long as something is, and attempts are left, the job is asked
    again with that list.  A job without a good reply has status "failed" and the last problem as message."""

    def ask(prompt: str, images: list[bytes]) -> tuple[str, dict]:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(agent, prompt, images).result(timeout)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def one(doc: int, job: str, prompt: str, images: list[bytes]) -> dict:
        began, sums, problems = time.time(), {"input": 0, "cached": 0, "output": 0, "cost": 0.0}, []
        out = {"doc": doc, "job": job, "status": "failed", "code": 1, "reply": None, "message": ""}
        for turn in range(1, attempts + 1):
            out["attempts"] = turn
            again = "" if not problems else "\n\nThe reply before had these problems; send all of it again without them:\n" + "\n".join(f"- {p}" for p in problems)
            try:
                reply, usage = ask(prompt + again, images)
            except Late:
                out |= {"code": TIMED_OUT, "message": f"no reply within {timeout:g} seconds"}
                break
            except Exception as e:  # an agent's failures have no common type
                out["message"] = str(e)[:500]
                continue
            for name in sums:
                sums[name] += usage.get(name) or 0
            problems = check(reply) if check else []
            if not problems:
                out |= {"status": "completed", "code": 0, "reply": reply, "message": ""}
                break
            out["message"] = "; ".join(problems)
        return out | sums | {"seconds": time.time() - began}

    names = [c.split()[0] for c in REPLY.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in REPLY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = one(row["doc"], row["job"], row["prompt"], row["images"] or [])
                yield pa.RecordBatch.from_pydict({n: [found[n]] for n in names}, schema=arrow)

    return jobs.select(F.col("doc").cast("long"), F.col("job").cast("string"), "prompt", "images").mapInArrow(run, REPLY)


def replayed(recorded: dict[str, str]) -> Agent:
    """An agent that answers from a table of prompts and replies, for runs without any."""

    def agent(prompt: str, images: list[bytes]) -> tuple[str, dict]:
        return recorded[prompt], {}

    return agent


def translated_events(lines: DataFrame) -> DataFrame:
    """``lines`` (job, seq, line) of the other kind of log as events of the first kind: results and assistant
    messages become message_end, tool uses tool_execution_start; that log reports no usage, so none is given."""
    shape = "type string, result string, message struct<role:string,content:array<struct<type:string,text:string>>>"
    e = lines.withColumn("e", F.from_json("line", shape)).where("e.type is not null")
    texts = F.array_join(F.transform(F.filter("e.message.content", lambda c: c["type"] == "text"), lambda c: c["text"]), "\n")
    tools = F.coalesce(F.size(F.filter("e.message.content", lambda c: c["type"] == "tool_use")), F.lit(0))
    said = F.col("e.type").isin("assistant", "result")
    return e.select(
        "job", "seq", F.when(said, "message_end").otherwise(F.col("e.type")).alias("type"), F.when(said, "assistant").otherwise(F.col("e.message.role")).alias("role"),
        F.coalesce("e.result", texts).alias("text"), F.when(F.col("e.message").isNotNull(), F.greatest(tools, F.lit(0))).otherwise(0).alias("tools"), F.lit(None).cast("bigint").alias("total"),
    )


#: What agents are asked, by kind; braces name columns.
PROMPTS = {
    "detection": "Look at pages {pages}. For every page, in this order, say in one JSON object with the array \"pages\": page, has_table, table_count_estimate, may_merge_with_previous, has_image, image_count_estimate, image_kinds, image_confidence, image_reason.{context}",
    "image": "List all images on page {page} as one JSON object with page and the array \"images\". Boxes are fractions of the page. Known pictures: {hints}. Headings so far: {headings}.",
    "extraction": "Extract every table of page {page} into CSV files, one for each table, with its title, box and number of header rows.",
    "continuation": "Does the first table of page {page} go on with the last one of page {previous}? Answer with {{\"merge_with_previous\": true}} or false.",
    "merge_plan": "Group pages {pages} by tables that run over them: one JSON object with \"groups\", runs of consecutive pages; a page where one table ends and another begins stands in both groups.",
    "group": "Pages {pages} hold one table that runs over all of them. Extract it as one grid, then name all pages in \"processed_pages\".",
}


def prompt(kind: str) -> Column:
    """A prompt with its columns filled in; arrays are listed with commas, nulls are empty."""
    parts = re.split(r"(\{\{|\}\}|\{\w+\})", PROMPTS[kind])
    out = []
    for part in parts:
        if re.fullmatch(r"\{\w+\}", part):
            out.append(F.coalesce(F.col(part[1:-1]).cast("string"), F.lit("")))
        elif part:
            out.append(F.lit({"{{": "{", "}}": "}"}.get(part, part)))
    return F.concat(*out)


def listed(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ", ")


def _whole(node: ast.AST) -> int | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, int) else None


def code_pages(source: str) -> list[int]:
    """Pages that an extractor's code names: files of pages, lists and ranges bound to names of pages, loops over them."""
    found = {int(x) for x in re.findall(r"page_(\d{4})\.pdf", source)}

    def literal(node: ast.AST) -> list[int]:
        items = node.args if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "range" else getattr(node, "elts", [])
        values = [_whole(x) for x in items]
        if isinstance(node, ast.Call):
            return list(range(*values)) if values and None not in values else []
        return [v for v in values if v is not None]

    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError):
        return sorted(found)
    for node in nodes:
        if isinstance(node, ast.For):
            names, value = [node.target], node.iter if isinstance(node.iter, ast.Call) else None
        else:
            names, value = getattr(node, "targets", [getattr(node, "target", None)]), getattr(node, "value", None)
            value = value if isinstance(node, (ast.Assign, ast.AnnAssign)) else None
        if value is not None and any("PAGE" in getattr(n, "id", "").upper() for n in names):
            found.update(literal(value))
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def pages_of_code(sources: pd.Series) -> pd.Series:
    """code_pages() of each row; source code has no built-in parser."""
    return sources.map(lambda s: code_pages(s) if isinstance(s, str) else [])


def pages_with_code(tables: DataFrame) -> DataFrame:
    """``tables`` (page, pages, code) with the pages that their code names, where these touch the anchor page."""
    own = F.col("code_pages")
    near = (F.size(own) > 0) & (F.array_contains(own, F.col("page")) | F.array_contains(own, F.col("page") + 1) | F.col("page").between(F.array_min(own), F.array_max(own)))
    out = tables.withColumn("code_pages", pages_of_code("code"))
    return out.withColumn("pages", F.when(near, F.array_sort(F.array_union("pages", own))).otherwise(F.col("pages"))).drop("code_pages")


def register_page_range(spark: SparkSession, name: str = "page_range") -> None:
    """A table function for SQL: page_range('1,3,8-12') gives its pages in order; an invalid list is an error."""

    class Pages:
        def eval(self, spec: str):
            pages: set[int] = set()
            for part in spec.split(","):
                ends = re.fullmatch(r"\s*([1-9]\d*)(?:-([1-9]\d*))?\s*", part)
                low, high = (int(ends[1]), int(ends[2] or ends[1])) if ends else (1, 0)
                if high < low:
                    raise ValueError(f"not a page list: {spec}")
                pages.update(range(low, high + 1))
            for page in sorted(pages):
                yield (page,)

    spark.udtf.register(name, F.udtf(Pages, returnType="page int"))


def failed(reply_rows: DataFrame) -> DataFrame:
    """doc, job, problem of jobs without a reply, as JSON for a run's report."""
    return reply_rows.where("status <> 'completed'").select("doc", "job", F.to_json(F.struct("code", "attempts", "message")).alias("problem"))


def usage_events(reply_rows: DataFrame, stage: str) -> DataFrame:
    """doc, stage, noncached, cached, output, cost: what replies used, for usage_of()."""
    return reply_rows.select("doc", F.lit(stage).alias("stage"), F.col("input").alias("noncached"), "cached", "output", "cost")


def recorded(reply_rows: DataFrame, prompts: DataFrame) -> dict[str, str]:
    """Prompts and replies of a small run, for replayed(); the caller bounds it."""
    return {r.prompt: r.reply for r in prompts.join(reply_rows.where("reply is not null"), ["doc", "job"]).select("prompt", "reply").collect()}


