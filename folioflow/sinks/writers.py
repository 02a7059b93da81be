"""What a run leaves behind: document text, metadata, assets, manifests.  Writers commit as Spark commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..operators.lineage import public_tables

#: What minimal retention keeps under a run's work folder, and what must be there before anything goes.
KEPT = ("metrics.json", "review", "run-blocks.json.gz", "run-manifest.json", "status.json", "table-code", "diagnostics")
NEEDED = ("output.md", "assets/metadata.json", "work/metrics.json", "work/diagnostics/validation.json")
READABLE = ("exact", "approximate")


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line a row, letters as they are; a reader sees the old files or the new ones."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each document's Markdown as rows of a table partitioned by nothing, keyed by doc."""
    docs.select("doc", "markdown").write.mode(mode).parquet(path)


def metadata(docs: DataFrame, tables: DataFrame, layout: DataFrame, images: DataFrame) -> DataFrame:
    """doc, metadata: final metadata as JSON: source, hash of the output, and all records in order.

    ``docs``: doc, file, sha256, page_count, selected, markdown.  Only public fields of tables are shown."""
    def listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
        own = F.struct(*(c for c in rows.columns if c != "doc"))
        out = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*order, own.alias("own")))).alias("x"))
        return out.select("doc", F.transform("x", lambda x: x["own"]).alias(name))

    t = listed(public_tables(tables), "tables", "page", "page_table_index")
    out = docs.join(t, "doc", "left").join(listed(layout, "layout_tables", "layout_id"), "doc", "left").join(listed(images, "images", "page", "id"), "doc", "left")
    source = F.struct("file", "sha256", "page_count", F.col("selected").alias("selected_pages"))
    whole = F.struct(F.lit(3).alias("schema_version"), source.alias("source"), F.sha2("markdown", 256).alias("output_sha256"), "tables", "layout_tables", "images")
    return out.select("doc", F.to_json(whole).alias("metadata"))


def table_assets(records: DataFrame) -> DataFrame:
    """doc, id, page, page_table_index, folder, csv, extra_csvs of extracted tables.

    Tables are numbered by page, index and folder before those without a CSV are left out, so a number is used up
    even then.  ``records``: doc, page, page_table_index, folder, csvs (names); the first output file is a table's own."""
    order = Window.partitionBy("doc").orderBy("page", "page_table_index", "folder")
    named = records.withColumn("id", F.format_string("table-%04d", F.row_number().over(order)))
    outputs = F.array_sort(F.filter("csvs", lambda c: F.rlike(c, F.lit(r"(^|/)output_[^/]*\.csv$"))))
    found = named.withColumn("outputs", outputs).where(F.size("outputs") > 0)
    rest = F.slice("outputs", F.lit(2), F.greatest(F.size("outputs") - 1, F.lit(0)))
    return found.select("doc", "id", "page", "page_table_index", "folder", F.get("outputs", F.lit(0)).alias("csv"), rest.alias("extra_csvs"))


def image_assets(pictures: DataFrame) -> DataFrame:
    """doc, id, page, ord, image: pictures of the layout that have an image and are no repeated logo, numbered in order."""
    order = Window.partitionBy("doc").orderBy("page", "ord")
    shown = pictures.where("has_image and not header_logo")
    named = shown.withColumn("id", F.format_string("image-%04d", F.row_number().over(order)))
    return named.select("doc", "id", "page", "ord", F.concat(F.lit("assets/images/"), "id", F.lit(".png")).alias("image"))


def chart_files(images: DataFrame) -> DataFrame:
    """doc, id, path, csv: charts that could be read, as CSV for spreadsheets.  ``images``: doc, id, status, columns, rows."""
    readable = images.where(F.col("status").isin(*READABLE))
    path = F.concat(F.lit("assets/chart-tables/"), "id", F.lit(".csv"))
    return readable.select("doc", "id", path.alias("path"), grid.csv_quoted(F.concat(F.array("columns"), F.col("rows"))).alias("csv"))


def retention(files: DataFrame, reports: DataFrame) -> DataFrame:
    """doc, path, length, keep: what minimal retention does with each file under work.

    Only documents whose validation passed and that have all NEEDED files lose any.  ``files``: doc, path
    (relative), length; ``reports``: doc, status."""
    whole = files.where(F.col("path").isin(*NEEDED)).groupBy("doc").agg(F.count_distinct("path").alias("n")).where(F.col("n") == len(NEEDED))
    good = reports.where("status = 'passed'").select("doc").join(whole, "doc").select("doc", F.lit(True).alias("good"))
    name = F.regexp_extract("path", "^work/([^/]+)", 1)
    kept = ~F.startswith("path", F.lit("work/")) | name.isin(*KEPT)
    return files.join(good, "doc", "left").select("doc", "path", "length", (kept | F.col("good").isNull()).alias("keep"))


def retention_sizes(decided: DataFrame) -> DataFrame:
    """doc, before, after: bytes of a result before and after retention()."""
    return decided.groupBy("doc").agg(F.sum("length").alias("before"), F.sum(F.when(F.col("keep"), F.col("length")).otherwise(0)).alias("after"))


def manifest(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc, manifest: a run's manifest as JSON: source, options, and hashes of its files by path."""
    listed = F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "sha256"))))
    own = files.groupBy("doc").agg(listed.alias("files"))
    return docs.join(own, "doc", "left").select("doc", F.to_json(F.struct(F.lit(1).alias("schema_version"), "file", "sha256", "page_count", "options", "files")).alias("manifest"))


def relative_to(path: Column, root: str) -> Column:
    """A path below ``root``, slashes forward; null for one that leaves it."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = F.startswith(plain, F.lit(root.rstrip("/") + "/"))
    rest = F.substr(plain, F.lit(len(root.rstrip("/")) + 2))
    return F.when(inside & ~F.rlike(rest, F.lit(r"(^|/)\.\.(/|$)")), rest)
