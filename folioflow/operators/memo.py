"""Memoised stages: order of tasks, signatures, cache hits, states, re-runs, reasons why a run is not complete."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    """A stage of a run: what it needs, and what it does; ``run`` takes the frames of the stages it needs."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    version: int = 1


def ordered(tasks: list[Task], wanted: list[str] | None = None) -> list[Task]:
    """Tasks that ``wanted`` ones need, needs first, else in the order given; a circle is an error."""
    known, out, open_ = {t.name: t for t in tasks}, [], []

    def visit(name: str) -> None:
        if name not in known:
            raise ValueError(f"unknown task: {name}")
        if name in open_:
            raise ValueError(f"tasks need each other: {' -> '.join([*open_, name])}")
        if known[name] in out:
            return
        open_.append(name)
        for need in known[name].needs:
            visit(need)
        open_.pop()
        out.append(known[name])

    for name in wanted or [t.name for t in tasks]:
        visit(name)
    return out


@dataclass
class State:
    task: str
    status: str
    signature: str
    elapsed: float
    path: str | None = None
    message: str = ""


@dataclass
class Runner:
    """Runs tasks over tables in a shared folder: a stage whose signature, input and version are unchanged and whose
    table is there is read, not run; a failure is recorded and raised again."""

    spark: object
    folder: str
    options: dict = field(default_factory=dict)
    states: dict[str, State] = field(default_factory=dict)

    def signature(self, task: Task) -> str:
        import hashlib

        parts = {"task": task.name, "version": task.version, "options": self.options, "needs": [self.states[n].signature for n in task.needs if n in self.states]}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()

    def cached(self, task: Task, signature: str) -> DataFrame | None:
        """The stage's table of this signature, if it was written whole."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{task.name}-{signature[:16]}/_SUCCESS")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.parquet(str(place.getParent()))

    def run(self, tasks: list[Task], inputs: dict[str, DataFrame], wanted: list[str] | None = None, force: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        frames = dict(inputs)
        for task in ordered(tasks, wanted):
            began, signature = time.time(), self.signature(task)
            path = f"{self.folder}/{task.name}-{signature[:16]}"
            held = None if task.name in force else self.cached(task, signature)
            status = "cached" if held is not None else "completed"
            try:
                if held is None:
                    task.run(frames).write.mode("overwrite").parquet(path)
                    held = self.spark.read.parquet(path)
            except Exception as e:
                self.states[task.name] = State(task.name, "failed", signature, time.time() - began, None, str(e)[:500])
                raise
            frames[task.name] = held
            self.states[task.name] = State(task.name, status, signature, time.time() - began, path)
        return frames


def signature(*parts: Column) -> Column:
    """sha256 of the parts in order; a null part differs from an empty one."""
    return F.sha2(F.concat_ws(chr(31), *(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts)), 256)


def canonical_sha256(record: Column) -> Column:
    """sha256 of a struct as JSON with its fields in the order of their names."""
    return F.sha2(F.to_json(record), 256)


def cache_hits(wanted: DataFrame, states: DataFrame) -> DataFrame:
    """doc, task, hit: whether a completed state with the same signature and outputs exists."""
    good = states.where("status = 'completed' and n_outputs > 0").select("doc", "task", "signature", F.lit(True).alias("hit")).distinct()
    return wanted.join(good, ["doc", "task", "signature"], "left").select("doc", "task", F.coalesce("hit", F.lit(False)).alias("hit"))


def output_problems(outputs: DataFrame) -> DataFrame:
    """doc, task, path, problem: outputs that make a cached state useless: missing, empty, or JSON that does not parse.

    ``outputs``: doc, task, path, content (null where there is no file)."""
    bad_json = F.col("path").endswith(".json") & F.try_parse_json("content").isNull()
    problem = F.when(F.col("content").isNull(), "missing").when(F.length("content") == 0, "empty").when(bad_json, "not_json")
    return outputs.select("doc", "task", "path", problem.alias("problem")).where("problem is not null")


def completed_reason(runs: DataFrame) -> DataFrame:
    """doc, reason: the first thing that keeps a run from counting as complete; null if nothing does."""
    reason = (
        F.when(F.coalesce("status", F.lit("")) != "completed", "not completed").when(~F.coalesce("valid", F.lit(False)), "validation failed")
        .when(F.col("stored").isNull(), "no hash").when(F.col("stored") != F.col("actual"), "source changed").when(F.coalesce("size", F.lit(0)) == 0, "empty output")
    )
    return runs.select("doc", reason.alias("reason"))


def rerun_refused(results: DataFrame, drafts: DataFrame) -> DataFrame:
    """doc, reason: results whose tables cannot be run again: reviewed already, without blocks, or of another source."""
    drafted = drafts.select("doc").distinct().withColumn("drafted", F.lit(True))
    out = results.join(drafted, "doc", "left")
    reason = F.when(F.col("drafted"), "has drafts").when(~F.coalesce("has_blocks", F.lit(False)), "blocks missing").when(F.coalesce(F.col("stored") != F.col("actual"), F.lit(True)), "source changed")
    return out.select("doc", reason.alias("reason"))


def swapped(old: DataFrame, new: DataFrame, problems: DataFrame) -> DataFrame:
    """Rows (doc, ..) of documents after a re-run: new ones where nothing is wrong with them, else all old ones.

    A document's rows are never mixed; documents that were not run again keep theirs."""
    done = new.select("doc").distinct().join(problems.select("doc").distinct(), "doc", "left_anti")
    return old.join(done, "doc", "left_anti").unionByName(new.join(done, "doc", "left_semi"))
