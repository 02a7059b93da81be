"""Readers of files: document discovery, ragged CSV grids, metadata, event logs, layouts, results and job lists.

Small files are rows; what Spark has no parser for runs in Arrow batches.  Nothing is listed on the driver.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import grid, text

# Names of options that a layout parser takes, and of its engines for reading scans.
OCR_ENGINES = ("auto", "easyocr", "rapidocr", "tesseract", "tesseract_cli", "ocrmac")
LAYOUT_DEFAULTS = {"do_ocr": False, "do_table_structure": True, "images_scale": 2.0, "generate_picture_images": True, "ocr": {"engine": "auto"}, "accelerator": {}}
SINGLE = {"accelerator": {"num_threads": 1}, "layout_batch_size": 1}


def discover(spark: SparkSession, root: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(jobs, rejected): PDF files by folder, in order of their paths; a folder with other than one PDF is rejected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", "modificationTime")
    pdf = files.where(F.lower("path").endswith(".pdf")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    counts = pdf.groupBy("folder").agg(F.count("*").alias("n"))
    jobs = pdf.join(counts.where("n = 1"), "folder").drop("n").withColumn("order", text.casefold(F.col("path")))
    return jobs, counts.where("n <> 1")


def csv_grids(spark: SparkSession, path: str, pad: bool = True) -> DataFrame:
    """path, rows: each CSV file as a grid of strings; quoted line breaks are kept; short rows are filled up, or
    stay as they are without ``pad``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(csv.reader(io.StringIO(c.as_py().decode("utf-8-sig"), newline=""))) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, pa.list_(pa.list_(pa.string())))], ["path", "rows"])

    read = files.mapInArrow(run, "path string, rows array<array<string>>")
    return read.withColumn("rows", grid.padded(F.col("rows"))) if pad else read


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Assistant usage events of JSON-lines logs, either spelling of counts; lines that do not parse are skipped."""
    shape = (
        "type string, message struct<role:string,usage:struct<input:bigint,inputTokens:bigint,cacheRead:bigint,cacheReadTokens:bigint,"
        "cacheWrite:bigint,output:bigint,outputTokens:bigint,cost:struct<total:double>>>"
    )
    raw = spark.read.schema(shape).option("mode", "DROPMALFORMED").json(path)
    u = F.col("message.usage")
    n = lambda *names: F.coalesce(*(u[c] for c in names), F.lit(0))
    return raw.where("type = 'message_end' and message.role = 'assistant'").select(
        F.input_file_name().alias("job"), n("input", "inputTokens").alias("input"), n("cacheRead", "cacheReadTokens").alias("cache_read"), n("cacheWrite").alias("cache_write"),
        n("output", "outputTokens").alias("output"), F.coalesce(u["cost"]["total"], F.lit(0.0)).alias("cost"),
    )


def usage_or_kept(usage: DataFrame, kept: DataFrame) -> DataFrame:
    """doc, input, output: what logs say, or where that is nothing what the run's kept report says."""
    k = kept.select("doc", *(F.col(c).alias(f"kept_{c}") for c in ("input", "output")))
    none = F.coalesce(F.col("input") + F.col("output"), F.lit(0)) == 0
    out = usage.join(k, "doc", "full_outer")
    return out.select("doc", *(F.when(none, F.coalesce(f"kept_{c}", F.lit(0))).otherwise(F.col(c)).alias(c) for c in ("input", "output")))


def layout_options(given: dict | None = None) -> dict:
    """Options of a layout parser: defaults under what is given; unknown names and engines are errors."""
    given = given or {}
    if unknown := sorted(set(given) - set(LAYOUT_DEFAULTS)):
        raise ValueError(f"unknown layout options: {', '.join(unknown)}")
    out = merged(LAYOUT_DEFAULTS, given)
    if out["ocr"].get("engine") not in OCR_ENGINES:
        raise ValueError(f"unknown engine: {out['ocr'].get('engine')}")
    return out


def merged(base: dict, over: dict) -> dict:
    """Nested dictionaries joined; any other value of ``over`` takes the place of the one below."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def layout(spark: SparkSession, path: str | None = None, provider: Callable[[bytes, dict], list[dict]] | None = None, files: DataFrame | None = None, options: dict | None = None) -> DataFrame:
    """Layout blocks: a materialised table at ``path``, or what ``provider`` returns for each file's bytes.

    A provider parses one document's bytes, under the resolved options, into dicts of page, kind, markdown,
    source_ref, box (from the bottom, with the page's height) or None.  Order counts all items, also those
    without a place, which give no block; boxes are turned to start at the top.  A parse that fails is tried
    once more with one thread and batches of one."""
    if path:
        return spark.read.schema(schemas.BLOCKS).parquet(path)
    first = layout_options(options)
    second = merged(first, {"accelerator": SINGLE["accelerator"]}) | {"layout_batch_size": SINGLE["layout_batch_size"]}

    def blocks(doc: str, content: bytes) -> list[dict]:
        try:
            items = provider(content, first)
        except Exception:  # a provider's failures have no common type; the second one is raised
            items = provider(content, second)
        out = []
        for order, item in enumerate(items):
            if item.get("page") is None:
                continue
            box, height = item.get("box"), item.get("page_height")
            turned = None if box is None else {"x0": box[0], "top": height - box[3], "x1": box[2], "bottom": height - box[1]}
            out.append({"doc_id": doc, "id": f"block-{order:05d}", "page": item["page"], "ord": order, "kind": item["kind"], "markdown": item["markdown"], "bbox": turned, "source_ref": item.get("source_ref")})
        return out

    names = [x.split()[0] for x in ("doc_id", "id", "page", "ord", "kind", "markdown", "bbox", "source_ref")]
    arrow = pa.schema([(n, t) for n, t in zip(names, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.struct([(c, pa.float64()) for c in ("x0", "top", "x1", "bottom")]), pa.string()))])

    def run(batches):
        for batch in batches:
            for doc, content in zip(batch.column("path"), batch.column("content")):
                if rows := blocks(doc.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schemas.BLOCKS)


def page_geometry(files: DataFrame, provider: Callable[[bytes], list[dict]]) -> DataFrame:
    """path, page, tables_found, lines_and_rects: what a provider counts on each page of a file."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = [{"path": path.as_py(), "page": p["page"], "tables_found": p["tables_found"], "lines_and_rects": p["lines"] + p["rects"]} for p in provider(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("page", pa.int32()), ("tables_found", pa.int32()), ("lines_and_rects", pa.int32())]))

    return files.select("path", "content").mapInArrow(run, "path string, page int, tables_found int, lines_and_rects int")


def _scalar(value: str):
    value = value.strip()
    if value[:1] in ("'", '"') and value[-1:] == value[:1]:
        return value[1:-1]
    if value[:1] == "[" and value[-1:] == "]":
        return [_scalar(v) for v in value[1:-1].split(",") if v.strip()]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return {"null": None, "~": None, "": None, "true": True, "false": False}.get(value.lower(), value)


def simple_yaml(source: str) -> dict:
    """Nested keys, lists and plain values, as table metadata are written; anything else is kept as text."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in source.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, depth: int):
        if at < len(lines) and lines[at][1].startswith("- "):
            out: list | dict = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
                out.append(_scalar(lines[at][1][2:]))
                at += 1
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == depth and ":" in lines[at][1]:
            key, _, value = lines[at][1].partition(":")
            at += 1
            deeper = at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- ")))
            if not value.strip() and deeper:
                out[str(_scalar(key))], at = block(at, lines[at][0])
            else:
                out[str(_scalar(key))] = _scalar(value)
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def yaml_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, metadata: YAML files of table metadata as JSON text, whose fields JSON functions read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            found = [json.dumps(simple_yaml(c.as_py().decode("utf-8")), ensure_ascii=False) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "metadata"])

    return files.mapInArrow(run, "path string, metadata string")


def restored_blocks(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """path, doc_id, blocks: gzip block files whose bytes have the hash that ``manifest`` (path, sha256) names, as
    JSON text; the job ends with an error at a file that has another one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").join(manifest.select("path", "sha256"), "path")

    def run(batches):
        for batch in batches:
            for file, content, sha in zip(*(batch.column(c) for c in ("path", "content", "sha256"))):
                raw = content.as_py()
                if hashlib.sha256(raw).hexdigest() != sha.as_py():
                    raise ValueError(f"{file.as_py()} does not have the hash of its manifest")
                yield pa.RecordBatch.from_pydict({"path": [file.as_py()], "blocks": [gzip.decompress(raw).decode("utf-8")]})

    return files.mapInArrow(run, "path string, blocks string")


def results(spark: SparkSession, folders: list[str] | None = None, batches: list[str] | None = None, project: str | None = None) -> DataFrame:
    """folder, position: result folders named directly, found in batches (those that hold assets/metadata.json) and
    listed in a project file, each once, where it was first named; no folder at all is an error."""
    parts = []
    if folders:
        parts.append(spark.createDataFrame([(0, i, f.rstrip("/")) for i, f in enumerate(folders)], "source int, at long, folder string"))
    for n, root in enumerate(batches or [], 1):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").load(root).select("path")
        found = files.where(F.col("path").endswith("/assets/metadata.json")).select(F.regexp_replace(F.regexp_replace("path", "/assets/metadata.json$", ""), "^file:/+", "/").alias("folder"))
        parts.append(found.select(F.lit(n).alias("source"), F.lit(0).cast("long").alias("at"), "folder"))
    if project:
        listed = spark.read.schema("results array<string>").option("multiLine", "true").json(project)
        parts.append(listed.select(F.posexplode("results").alias("p", "folder")).select(F.lit(2**30).alias("source"), F.col("p").cast("long").alias("at"), "folder"))
    if not parts:
        raise ValueError("name results, batches or a project")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = every.groupBy("folder").agg(F.min(F.struct("source", "at")).alias("position"))
    if not first.limit(1).count():
        raise ValueError("no result was found")
    return first.select("folder", "position")


def table_jobs(spark: SparkSession, path: str) -> DataFrame:
    """path, pdf, target, id, page: the jobs of JSON lists; relative files stand beside their list; what has no
    target or id is named by its file."""
    shape = "array<struct<pdf:string,target:string,id:string,page:int>>"
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.explode(F.from_json("value", shape)).alias("j"))
    base = F.regexp_replace("path", "/[^/]*$", "")
    pdf = F.when(F.rlike("j.pdf", F.lit("^([a-z0-9]+:)?/")), F.col("j.pdf")).otherwise(F.concat(base, F.lit("/"), F.col("j.pdf")))
    stem = text.slug(F.regexp_replace(F.regexp_replace("j.pdf", "^.*/", ""), r"\.[^.]*$", ""))
    return raw.select("path", pdf.alias("pdf"), F.coalesce("j.target", F.lit("")).alias("target"), F.coalesce(F.nullif(F.col("j.id"), F.lit("")), stem).alias("id"), "j.page")
