"""Constraints over final artifacts; each yields issue rows (doc, rule, severity, subject), none means valid.

Rules of one row are tables of names and column predicates, checked in one pass over its entity; rules on order
compare what markers in a document's text say with the arrays that its metadata gives; rules between
entities are anti joins on (doc, id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION, LEAST_OVERLAP = 3, 0.35
PAGE, MERGED = r"<!-- page:(\d+) -->", r"<!-- pages:(\d+)-(\d+) merged-into:([^ ]+) -->"
TABLE, TABLE_END = r"<!-- table:([^ ]+) page:(\d+) -->", r"<!-- /table:([^ ]+) page:(\d+) -->"
IMAGE, IMAGE_END = r"<!-- image:([^ ]+) page:(\d+) -->", r"<!-- /image:([^ ]+) page:(\d+) -->"
LINK = r"!\[[^\]]*\]\((assets/images/[^)]+)\)"
PLACEHOLDER = "<!-- image -->"
# Closed domains of actions.
UNMATCHED = ("replaced_text_fragments", "inserted_missing_table")
ACTIONS = ("replaced_layout_table", "merged_from_layout_tables", "inserted_without_layout_table")
READABLE = ("exact", "approximate")
LAYOUT_DIR, CHART_DIR = "assets/layout-tables/", "assets/chart-tables/"
ISSUE = ("doc", "rule", "severity", "subject")
Rules = dict[str, tuple[str, Column]]


def broken(rows: DataFrame, rules: Rules, subject: Column) -> DataFrame:
    """Issue rows of every rule (name -> (severity, whether it is broken)) that a row breaks."""
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("severity"))) for name, (kind, bad) in rules.items())))
    return rows.select("doc", F.explode(found).alias("x"), subject.cast("string").alias("subject")).select("doc", "x.rule", "x.severity", "subject")


def issue(rows: DataFrame, rule: str, severity: str, subject: str | Column) -> DataFrame:
    s = F.col(subject) if isinstance(subject, str) else subject
    return rows.select("doc", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), s.cast("string").alias("subject"))


def pairs_in(text: Column, pattern: str) -> Column:
    """"id page" of each marker of a text, in order."""
    ids, pages = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(ids.alias("id"), pages.alias("page")), lambda x: F.concat_ws(" ", x["id"], x["page"]))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def covered_pages(text: Column) -> Column:
    """Pages that a document's markers cover, in order; a merged marker covers its whole range."""
    every = F.regexp_extract_all(text, F.lit(r"(<!-- page:\d+ -->|<!-- pages:\d+-\d+ merged-into:[^ ]+ -->)"), F.lit(1))
    number = lambda m, p, i: F.regexp_extract(m, p, i).cast("int")
    runs = F.transform(every, lambda m: F.when(F.startswith(m, F.lit("<!-- pages")), F.when(number(m, MERGED, 1) <= number(m, MERGED, 2), F.sequence(number(m, MERGED, 1), number(m, MERGED, 2))).otherwise(F.array().cast("array<int>"))).otherwise(F.array(number(m, PAGE, 1))))
    return F.flatten(runs)


def _ordered(rows: DataFrame, order: list[str], **lists: Column) -> DataFrame:
    """doc and, by name, a column of its rows in ``order`` as an array."""
    item = F.struct(*order, *(c.alias(n) for n, c in lists.items()))
    out = rows.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("x"))
    return out.select("doc", *(F.col(f"x.{n}").alias(n) for n in lists))


def _with_lists(docs: DataFrame, *lists: DataFrame) -> DataFrame:
    for other in lists:
        names = [c for c in other.columns if c != "doc"]
        kinds = {f.name: f.dataType.simpleString() for f in other.schema.fields}
        docs = docs.join(other, "doc", "left").select(*docs.columns, *(F.coalesce(n, F.array().cast(kinds[n])).alias(n) for n in names))
    return docs


def document_issues(docs: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Rules on a document's text against its metadata: version, pages, markers, links, placeholders.

    ``docs``: doc, version, page_count, selected, markdown; ``tables``: doc, id, page, top, page_table_index, pages;
    ``images``: doc, id, page, pos, image, included."""
    said = lambda page: F.concat_ws(" ", "id", page.cast("string"))
    tabs = _ordered(tables, ["page", "top", "page_table_index"], opens=said(F.col("page")), ends=said(F.array_max("pages")))
    pics = _ordered(images.where("included"), ["pos"], pictures=said(F.col("page")), links=F.col("image"))
    d = _with_lists(docs, tabs, pics)
    text = F.coalesce("markdown", F.lit(""))
    pages = F.coalesce("selected", F.sequence(F.lit(1), F.col("page_count")))
    rules: Rules = {
        "version": ("error", ~F.coalesce(F.col("version") == VERSION, F.lit(False))),
        "selected_sorted": ("error", sorted_set(pages) != pages),
        "selected_in_range": ("error", F.exists(pages, lambda p: (p < 1) | (p > F.col("page_count")))),
        "page_markers": ("error", covered_pages(text) != pages),
        "table_markers": ("error", pairs_in(text, TABLE) != F.col("opens")),
        "table_end_markers": ("error", pairs_in(text, TABLE_END) != F.col("ends")),
        "image_links": ("error", F.regexp_extract_all(text, F.lit(LINK), F.lit(1)) != F.col("links")),
        "image_markers": ("error", pairs_in(text, IMAGE) != F.col("pictures")),
        "image_end_markers": ("error", pairs_in(text, IMAGE_END) != F.col("pictures")),
        "placeholder": ("error", F.contains(text, F.lit(PLACEHOLDER))),
        "not_empty": ("error", F.rlike(text, F.lit(r"^\s*$"))),
    }
    merged = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(MERGED), F.lit(i)).alias(n) for i, n in ((1, "low"), (2, "high"), (3, "id"))))
    marks = d.select("doc", F.explode(merged).alias("m")).select("doc", F.col("m.low").cast("int").alias("low"), F.col("m.high").cast("int").alias("high"), F.col("m.id").alias("id"))
    goes_on = tables.select("doc", F.col("id").cast("string").alias("id"), F.slice("pages", F.lit(2), F.greatest(F.size("pages") - 1, F.lit(0))).alias("rest"))
    run = F.when(F.col("low") <= F.col("high"), F.sequence("low", "high")).otherwise(F.array().cast("array<int>"))
    wrong = marks.join(goes_on, ["doc", "id"], "left").where(F.col("rest").isNull() | (run != F.col("rest")))
    return broken(d, rules, F.col("doc")).unionByName(issue(wrong, "merged_range", "error", F.format_string("%d-%d", "low", "high")))


def table_issues(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Rules on table records: pages, files, leaked fields, matches and lineage inside of the record.

    ``tables``: doc, id, page, pages, csv, extra_csvs, leaked (names of work-only fields), matched, overlap, action,
    lineage_action, layout_ids, relation_ids; ``files``: doc, path."""
    ids = F.coalesce("layout_ids", F.array().cast("array<string>"))
    inserted = F.col("lineage_action") == ACTIONS[2]
    rules: Rules = {
        "source_pages": ("error", (sorted_set(F.col("pages")) != F.col("pages")) | ~F.array_contains("pages", F.col("page"))),
        "csv_outside": ("error", ~F.coalesce(F.startswith("csv", F.lit("assets/")), F.lit(False))),
        "leaked_fields": ("error", F.size("leaked") > 0),
        "match_overlap": ("error", F.col("matched").isNotNull() & (F.coalesce("overlap", F.lit(0.0)) < LEAST_OVERLAP)),
        "unmatched_action": ("error", F.col("matched").isNull() & ~F.coalesce(F.col("action").isin(*UNMATCHED), F.lit(False))),
        "lineage_action": ("warning", ~F.coalesce(F.col("lineage_action").isin(*ACTIONS), F.lit(False))),
        "lineage_relations": ("warning", ids != F.coalesce("relation_ids", F.array().cast("array<string>"))),
        "lineage_twice": ("warning", F.size(F.array_distinct(ids)) < F.size(ids)),
        "inserted_with_ids": ("warning", F.coalesce(inserted, F.lit(False)) & (F.size(ids) > 0)),
        "mapped_without_ids": ("warning", ~F.coalesce(inserted, F.lit(False)) & (F.size(ids) == 0)),
    }
    own = tables.select("doc", F.col("csv").alias("path"), "id", F.lit("csv_missing").alias("rule"))
    more = tables.select("doc", F.explode("extra_csvs").alias("path"), "id").withColumn("rule", F.lit("extra_csv_missing"))
    lost = own.unionByName(more).join(files, ["doc", "path"], "left_anti")
    twice = tables.where("matched is not null").groupBy("doc", "matched").agg(F.count("*").alias("n")).where("n > 1")
    return (
        broken(tables, rules, F.col("id")).unionByName(lost.select("doc", "rule", F.lit("error").alias("severity"), F.col("id").cast("string").alias("subject")))
        .unionByName(issue(twice, "block_matched_twice", "error", "matched"))
    )


def lineage_issues(tables: DataFrame, layout: DataFrame) -> DataFrame:
    """Rules between agent tables and layout tables: unknown references, one-sided lineage, repeated and unsure ones.

    ``tables``: doc, id, layout_ids; ``layout``: doc, layout_id, status, replacements, candidates (table ids)."""
    to = tables.select("doc", F.col("id").cast("string").alias("id"), F.explode(F.array_distinct("layout_ids")).alias("layout_id"))
    texts = "array<string>"
    replaced = F.coalesce(F.col("replacements").cast(texts), F.array().cast(texts))
    back = layout.select("doc", "layout_id", F.explode(F.array_distinct(replaced)).alias("id"))
    named = layout.select("doc", "layout_id", F.explode(F.array_union(replaced, F.coalesce(F.col("candidates").cast(texts), F.array().cast(texts)))).alias("id"))
    known, there = tables.select("doc", F.col("id").cast("string").alias("id")), layout.select("doc", "layout_id")
    pair = F.concat_ws(" ", "id", "layout_id")
    twice = layout.groupBy("doc", "layout_id").agg(F.count("*").alias("n")).where("n > 1")
    one_way = lambda a, b: a.join(b, ["doc", "id", "layout_id"], "left_anti").join(known, ["doc", "id"], "left_semi").join(there, ["doc", "layout_id"], "left_semi")
    return (
        issue(to.join(there, ["doc", "layout_id"], "left_anti"), "unknown_layout_table", "warning", pair)
        .unionByName(issue(named.join(known, ["doc", "id"], "left_anti"), "unknown_table", "warning", pair))
        .unionByName(issue(one_way(to, back), "lineage_one_sided", "warning", pair)).unionByName(issue(one_way(back, to), "lineage_one_sided_back", "warning", pair))
        .unionByName(issue(twice, "layout_id_twice", "warning", "layout_id")).unionByName(issue(layout.where("status = 'ambiguous_continuation'"), "ambiguous_continuation", "warning", "layout_id"))
    )


def retention_issues(docs: DataFrame, layout: DataFrame, files: DataFrame) -> DataFrame:
    """Rules on exported layout tables.  ``docs``: doc, retain; ``layout``: doc, layout_id, retained, markdown."""
    kept = F.coalesce("retained", F.lit(False))
    placed = F.coalesce(F.startswith("markdown", F.lit(LAYOUT_DIR)), F.lit(False))
    rules: Rules = {"retained_path": ("error", kept & ~placed), "path_not_retained": ("error", ~kept & F.col("markdown").isNotNull())}
    lost = layout.where(kept & placed).join(files.withColumnRenamed("path", "markdown"), ["doc", "markdown"], "left_anti")
    folder = files.where(F.startswith("path", F.lit(LAYOUT_DIR))).select("doc", F.lit(True).alias("folder")).distinct()
    counts = layout.groupBy("doc").agg(F.count("*").alias("n"), F.count_if(kept).alias("n_kept"))
    d = docs.select("doc", "retain").join(counts, "doc", "left").join(folder, "doc", "left").na.fill(0, ["n", "n_kept"]).na.fill(False, ["folder", "retain"])
    whole: Rules = {
        "not_all_retained": ("error", F.col("retain") & (F.col("n_kept") != F.col("n"))),
        "retained_folder_missing": ("error", F.col("retain") & (F.col("n") > 0) & ~F.col("folder")),
        "retained_while_off": ("error", ~F.col("retain") & (F.col("n_kept") > 0)),
        "stale_folder": ("error", ~F.col("retain") & F.col("folder")),
    }
    return broken(layout, rules, F.col("layout_id")).unionByName(issue(lost, "retained_file_missing", "error", "markdown")).unionByName(broken(d, whole, F.col("doc")))


def image_issues(images: DataFrame, files: DataFrame) -> DataFrame:
    """Rules on image records.  ``images``: doc, id, image, analysis_status, chart_status, chart_csv; ``files``: doc, path."""
    readable = F.coalesce(F.col("chart_status").isin(*READABLE), F.lit(False))
    has, placed = F.col("chart_csv").isNotNull(), F.coalesce(F.startswith("chart_csv", F.lit(CHART_DIR)), F.lit(False))
    rules: Rules = {
        "analysis_failed": ("warning", F.coalesce(F.col("analysis_status") == "failed", F.lit(False))),
        "chart_status": ("error", has & ~readable), "chart_outside": ("error", has & ~placed), "chart_without_csv": ("error", ~has & readable),
    }
    lost = lambda column, rule, keep: issue(images.where(keep).join(files.withColumnRenamed("path", column), ["doc", column], "left_anti"), rule, "error", "id")
    return broken(images, rules, F.col("id")).unionByName(lost("image", "image_missing", F.lit(True))).unionByName(lost("chart_csv", "chart_missing", has & placed))


def issues(docs: DataFrame, tables: DataFrame, layout: DataFrame, images: DataFrame, files: DataFrame) -> DataFrame:
    """All issues of documents."""
    parts: list[Callable[[], DataFrame]] = [
        lambda: document_issues(docs, tables, images), lambda: table_issues(tables, files), lambda: lineage_issues(tables, layout),
        lambda: retention_issues(docs, layout, files), lambda: image_issues(images, files),
    ]
    out = parts[0]()
    for part in parts[1:]:
        out = out.unionByName(part())
    return out


def report(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc, status, errors, warnings: a document fails with its first error."""
    counts = found.groupBy("doc").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = docs.select("doc").join(counts, "doc", "left").na.fill(0, ["errors", "warnings"])
    return out.select("doc", F.when(F.col("errors") > 0, "failed").otherwise("passed").alias("status"), "errors", "warnings")


def page_differences(expected: DataFrame, prepared: DataFrame) -> DataFrame:
    """doc, page, side: pages that only one of two sets has, "missing" or "unexpected"."""
    e, p = expected.select("doc", "page").distinct(), prepared.select("doc", "page").distinct()
    return e.join(p, ["doc", "page"], "left_anti").withColumn("side", F.lit("missing")).unionByName(p.join(e, ["doc", "page"], "left_anti").withColumn("side", F.lit("unexpected")))
