"""The engine: a run over tables of documents, its tasks, results and re-runs.

Inputs are tables: docs, blocks, tables and images of any number of documents.  Tasks are written one by one
under the engine's folder, each under a signature of its options, version and needs, so that a run that was cut
short goes on where it stopped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import lineage, memo, pages, usage, validate
from .operators.memo import Runner, State, Task
from .options import ConfigurationError, ExecutionError, Options, batch_name
from .sinks import writers

#: Inputs and the columns that they must have.
INPUTS = {
    "docs": ("doc", "file", "sha256", "page_count", "selected"),
    "blocks": ("doc", "page", "ord", "kind", "markdown", *pages.BOX),
    "tables": ("doc", "id", "page", "pages", "page_table_index", "markdown", "csv", "extra_csvs", *pages.BOX),
    "images": ("doc", "page", "pos", "id", "block", "caption", "included", "slot", "image", "text", *pages.BOX),
}
#: Where a re-run of tables starts: what it has changed and all that depends on it run again.
RERUN = ("claims", "lineage", "layout_tables", "merged", "page_texts", "output", "metadata", "issues", "report")


@dataclass
class Result:
    """Frames by task name, states, and a summary."""

    batch_id: str
    frames: dict[str, DataFrame]
    states: dict[str, State]

    def counts(self) -> DataFrame:
        """doc, and how many tables, images and layout tables of each kind it has."""
        return usage.result_counts(self.frames["tables"], self.frames["layout_tables"], self.frames["images"])

    def to_dict(self) -> dict:
        return {"batch_id": self.batch_id, "tasks": {n: {"status": s.status, "seconds": round(s.elapsed, 3)} for n, s in self.states.items()}}


def _ordered(tables: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("doc", "page").orderBy("top", "page_table_index", "id"))
    return tables.withColumn("k", turn.cast("int"))


def tasks(options: Options) -> list[Task]:
    """The tasks of a run in their fixed order."""

    def chosen(f: dict) -> DataFrame:
        docs = f["docs"].select("doc", F.coalesce("selected", F.sequence(F.lit(1), F.col("page_count"))).alias("pages"))
        return docs.select("doc", F.explode("pages").alias("page"))

    def claims(f: dict) -> DataFrame:
        return pages.direct_relations(pages.page_frame(_ordered(f["tables"]), f["blocks"]))

    def lineage_(f: dict) -> DataFrame:
        return lineage.continuations(f["tables"], f["blocks"], f["claims"])

    def layout_tables(f: dict) -> DataFrame:
        records = lineage.by_layout_table(lineage.layout_ids(f["blocks"]), lineage.edges(f["claims"], f["lineage"]), f["lineage"])
        return lineage.retained(records, f["blocks"], options.retain_layout_tables).join(f["blocks"].select(*pages.KEY, "ord", *pages.BOX), [*pages.KEY, "ord"], "left")

    def merged(f: dict) -> DataFrame:
        hidden = pages.hidden_before_tables(f["blocks"], f["images"], f["lineage"].where("id is not null"), text.normalised)
        frame = pages.page_frame(_ordered(f["tables"]), f["blocks"], f["images"], "markdown")
        return pages.with_images(pages.merges(frame, hidden))

    def page_texts(f: dict) -> DataFrame:
        edges = lineage.edges(f["claims"], f["lineage"])
        titles = lineage.numbered_headings(pages.contained_captions(f["blocks"], text.normalised), f["blocks"], edges, text.numbered_title)
        own = f["tables"].select(*pages.KEY, "id", "markdown", F.array_max("pages").alias("last_page"))
        made = pages.page_markdown(f["merged"], own, titles)
        empty = F.format_string("<!-- page:%d -->", "page")
        return f["pages"].join(made, pages.KEY, "left").select(*pages.KEY, F.coalesce("markdown", empty).alias("markdown"))

    def output(f: dict) -> DataFrame:
        return pages.documents(f["page_texts"])

    def records(f: dict) -> DataFrame:
        """Table records with their merge and lineage."""
        merge = f["merged"].select("doc", F.explode("merges").alias("merge")).select("doc", F.col("merge.id").alias("id"), "merge")
        edges = lineage.edges(f["claims"], f["lineage"])
        of = lineage.by_table(f["tables"], edges, lineage.layout_ids(f["blocks"])).select("doc", "id", F.struct("action", "layout_ids", "relations").alias("lineage"))
        box = F.struct(*pages.BOX).alias("bbox")
        return f["tables"].withColumn("source_pages", F.col("pages")).select("*", box).join(merge, ["doc", "id"], "left").join(of, ["doc", "id"], "left")

    def metadata(f: dict) -> DataFrame:
        docs = f["docs"].join(f["output"], "doc", "left")
        return writers.metadata(docs, f["records"], f["layout_tables"].drop("text"), f["images"].drop("text"))

    def issues(f: dict) -> DataFrame:
        docs = f["docs"].join(f["output"], "doc", "left").withColumn("version", F.lit(validate.VERSION)).withColumn("retain", F.lit(options.retain_layout_tables))
        ids = F.col("lineage.layout_ids")
        t = f["records"].select(
            "doc", F.col("id").cast("string").alias("id"), "page", "top", "page_table_index", "pages", "csv", "extra_csvs", F.array().cast("array<string>").alias("leaked"),
            F.concat_ws(":", F.col("page").cast("string"), F.col("merge.matched").cast("string")).alias("place"), F.col("merge.matched").alias("hit"), F.col("merge.overlap").alias("overlap"), F.col("merge.action").alias("action"),
            F.col("lineage.action").alias("lineage_action"), ids.alias("layout_ids"), F.transform("lineage.relations", lambda r: r["layout_id"]).alias("relation_ids"),
        )
        t = t.withColumn("matched", F.when(F.col("hit").isNotNull(), F.col("place")))
        shown = f["images"].withColumn("analysis_status", F.lit("completed")).withColumn("chart_status", F.lit(None).cast("string")).withColumn("chart_csv", F.lit(None).cast("string"))
        files = f["tables"].select("doc", F.explode(F.concat(F.array("csv"), F.coalesce("extra_csvs", F.array().cast("array<string>")))).alias("path"))
        files = files.unionByName(f["images"].select("doc", F.col("image").alias("path"))).unionByName(f["layout_tables"].where("markdown is not null").select("doc", F.col("markdown").alias("path"))).distinct()
        return validate.issues(docs, t, f["layout_tables"], shown, files)

    def report(f: dict) -> DataFrame:
        return validate.report(f["docs"], f["issues"])

    return [
        Task("pages", chosen), Task("claims", claims), Task("lineage", lineage_, ("claims",)), Task("layout_tables", layout_tables, ("claims", "lineage")), Task("merged", merged, ("lineage",)),
        Task("page_texts", page_texts, ("pages", "claims", "lineage", "merged")), Task("output", output, ("page_texts",)), Task("records", records, ("claims", "lineage", "merged")),
        Task("metadata", metadata, ("output", "records", "layout_tables")), Task("issues", issues, ("output", "records", "layout_tables")), Task("report", report, ("issues",)),
    ]


class Engine:
    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), (options or Options()).checked()

    def preflight(self, inputs: dict[str, DataFrame]) -> None:
        """All that is wrong with the inputs, before any task runs."""
        problems = [f"input {n} is missing" for n in INPUTS if n not in inputs]
        problems += [f"{n} lacks {c}" for n, columns in INPUTS.items() if n in inputs for c in columns if c not in inputs[n].columns]
        if not problems and (wanted := self.options.page_list()):
            beyond = inputs["docs"].where(F.col("page_count") < wanted[-1]).limit(1).count()
            problems += ["pages name one beyond a document's last"] if beyond else []
        if problems:
            raise ConfigurationError(problems, self.options.batch_id)

    def convert(self, inputs: dict[str, DataFrame], wanted: list[str] | None = None, snapshot: str = "") -> Result:
        """All tasks, or those that ``wanted`` need.  ``snapshot`` names the state of the inputs; results of another
        state are not taken for these."""
        self.preflight(inputs)
        batch, pages_ = self.options.batch_id or batch_name(), self.options.page_list()
        if pages_:
            inputs = inputs | {"docs": inputs["docs"].withColumn("selected", F.lit(pages_).cast("array<int>"))}
        runner = Runner(self.spark, f"{self.folder}/{batch}", self.options.signature() | {"snapshot": snapshot})
        every = tasks(self.options)
        force = tuple(t.name for t in every) if self.options.force else ()
        try:
            frames = runner.run(every, inputs, wanted, force)
        except Exception as e:
            failed = next((n for n, s in runner.states.items() if s.status == "failed"), "")
            raise ExecutionError(str(e), failed, batch) from e
        return Result(batch, frames, runner.states)

    def rerun_tables(self, result: Result, tables: DataFrame, drafts: DataFrame, stored: DataFrame) -> Result:
        """The result with new tables for the documents that ``tables`` has, if none of them was reviewed or has
        another source by now; documents whose new output has errors keep their old tables.  ``stored``: doc, actual."""
        asked = tables.select("doc").distinct()
        docs = result.frames["docs"].join(asked, "doc", "left_semi").join(stored, "doc", "left").select("doc", F.lit(True).alias("has_blocks"), F.col("sha256").alias("stored"), "actual")
        if refused := memo.rerun_refused(docs, drafts).where("reason is not null").limit(3).collect():
            raise ConfigurationError([f"{r.doc}: {r.reason}" for r in refused], result.batch_id)
        inputs = {n: result.frames[n] for n in INPUTS}
        old = inputs["tables"]
        tried = self.convert(inputs | {"tables": memo.swapped(old, tables.select(*old.columns), asked.limit(0))}, snapshot=f"rerun-{_plan_hash(tables)}")
        wrong = tried.frames["issues"].where("severity = 'error'").select("doc").join(asked, "doc", "left_semi")
        if not wrong.limit(1).count():
            return tried
        kept = memo.swapped(old, tables.select(*old.columns), wrong)
        return self.convert(inputs | {"tables": kept}, snapshot=f"rerun-kept-{_plan_hash(tables)}")


def _plan_hash(df: DataFrame) -> str:
    """A name for a table's rows that does not depend on their order."""
    total = df.agg(F.bit_xor(F.xxhash64(*(F.col(c).cast("string") if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in df.columns))), F.count("*")).first()
    return hashlib.sha256(repr(tuple(total)).encode()).hexdigest()[:12]
