"""Review overlay: cell differences, effective rows, states, publishing, audits of shared content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grid, text

# Older names of review decisions.
LEGACY = {"accepted_ai": "approved", "accepted_docling": "approved", "edited": "approved", "needs_review": "unreviewed", "skipped": "ignored"}
STATUSES = ("unreviewed", "approved", "ignored")
ROWS = "array<array<string>>"


def review_status(status: Column) -> Column:
    """Today's name of a decision; none is unreviewed."""
    names = F.create_map(*(F.lit(x) for pair in LEGACY.items() for x in pair))
    return F.coalesce(F.try_element_at(names, status), F.nullif(status, F.lit("")), F.lit("unreviewed"))


def draft_problem(status: Column, rows: Column, marked: Column) -> Column:
    """Why a draft cannot be saved; null if it can."""
    return (
        F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status").when(rows.isNotNull() & F.exists(rows, lambda r: r.isNull() | F.exists(r, lambda v: v.isNull())), "rows")
        .when(marked.isNull(), "marked")
    )


def versions(key: tuple[str, ...], **grids: DataFrame) -> DataFrame:
    """key, r, c and a column for each version of a grid: its value there, or null.  A cell has one value in a version.

    Versions are put together and grouped, so that those dealt by grid already are not dealt again."""
    at = [*key, "r", "c"]
    names = list(grids)
    cells = [d.select(*at, *(F.col("value").alias(n) if n == name else F.lit(None).cast("string").alias(n) for n in names), *((F.lit(n == name)).alias(f"in_{n}") for n in names)) for name, d in grids.items()]
    every = reduce(DataFrame.unionByName, cells)
    return every.groupBy(*at).agg(*(F.max(n).alias(n) for n in names), *(F.max(f"in_{n}").alias(f"in_{n}") for n in names))


def differs(a: str, b: str) -> Column:
    return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))


def cell_diff(left: DataFrame, right: DataFrame, key: tuple[str, ...] = ("doc", "tab")) -> DataFrame:
    """key, changed: positions where two versions of a grid differ; a missing cell counts as empty."""
    return versions(key, left=left, right=right).groupBy(*key).agg(F.count_if(differs("left", "right")).alias("changed"))


def csv_profile(cells: DataFrame, most: int = 10) -> DataFrame:
    """doc, tab, n_rows, width, header, sample, last, empty, repeated, ragged_rows, empty_cells, repeated_rows: shape of
    a grid, its first row, the three after it and its last one; rows shorter than the widest, empty cells and later
    rows equal to the first, the first ``most`` of each."""
    rows = cells.groupBy("doc", "tab", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "value"))), lambda x: x["value"]), chr(1)).alias("row"), F.count("*").alias("w"), F.sort_array(F.collect_list(F.when(F.col("value") == "", F.col("c")))).alias("blank"))
    grids = rows.groupBy("doc", "tab").agg(F.sort_array(F.collect_list(F.struct("r", "w", "blank", "row"))).alias("x"))
    first = F.get("x", F.lit(0))
    width = F.array_max(F.transform("x", lambda r: r["w"]))
    numbers = lambda keep: F.transform(F.filter("x", keep), lambda r: r["r"])
    again = numbers(lambda r: (r["row"] == first["row"]) & (r["r"] > first["r"]))
    blank = F.flatten(F.transform("x", lambda r: F.transform(r["blank"], lambda c: F.struct(r["r"].alias("r"), c.alias("c")))))
    cells = lambda r: F.split(r["row"], chr(1))
    return grids.select(
        "doc", "tab", F.size("x").cast("long").alias("n_rows"), width.alias("width"), cells(first).alias("header"), F.transform(F.slice("x", 2, 3), cells).alias("sample"), cells(F.element_at("x", -1)).alias("last"), F.size(blank).cast("long").alias("empty"), F.size(again).cast("long").alias("repeated"),
        F.slice(numbers(lambda r: r["w"] < width), 1, most).alias("ragged_rows"), F.slice(blank, 1, most).alias("empty_cells"), F.slice(again, 1, most).alias("repeated_rows"),
    )


def latest_drafts(drafts: DataFrame) -> DataFrame:
    """Latest row of each (doc, tab) by (saved, version)."""
    order = Window.partitionBy("doc", "tab").orderBy(F.desc("saved"), F.desc("version"))
    return drafts.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def snapshot(held: DataFrame, now: DataFrame) -> DataFrame:
    """Source records as first seen: what ``held`` (doc, id, ..) has stays; records new to it are added."""
    return held.unionByName(now.join(held.select("doc", "id"), ["doc", "id"], "left_anti"), allowMissingColumns=True)


def review_summary(decisions: DataFrame) -> DataFrame:
    """doc, n, reviewed, modified, noted, marked: decisions of a document.

    ``decisions``: doc, status, changed (cells that differ from the source), note, marked."""
    done = F.col("status").isin("approved", "ignored")
    noted = F.trim(F.coalesce("note", F.lit(""))) != ""
    return decisions.groupBy("doc").agg(
        F.count("*").alias("n"), F.count_if(done).alias("reviewed"), F.count_if(F.col("changed") > 0).alias("modified"), F.count_if(noted).alias("noted"), F.count_if("marked").alias("marked"),
    )


def application_state(ai: DataFrame, current: DataFrame, drafts: DataFrame) -> DataFrame:
    """doc, state: whether grids wait to be applied, differ from what was extracted, or neither.

    All three: doc, tab, r, c, value.  A grid without cells in ``current`` is the extracted one still, one without
    cells in ``drafts`` the current one."""
    cells = versions(("doc", "tab"), ai=ai, now=current, draft=drafts)
    count, there = (lambda a, b: F.count_if(differs(a, b))), (lambda n: F.max(f"in_{n}").alias(n))
    grids = cells.groupBy("doc", "tab").agg(
        there("ai"), there("now"), there("draft"), count("draft", "now").alias("draft_now"), count("draft", "ai").alias("draft_ai"), count("now", "ai").alias("now_ai"),
        F.count_if(F.coalesce("now", F.lit("")) != "").alias("filled"),
    )
    # drafts of grids that were never extracted are no versions; such a grid has cells now or none
    pending = F.when(~F.col("draft"), 0).when(~F.col("ai"), F.col("filled")).when(F.col("now"), F.col("draft_now")).otherwise(F.col("draft_ai"))
    applied = F.when(F.col("now"), F.col("now_ai")).otherwise(0)
    out = grids.groupBy("doc").agg(F.max("ai").alias("known"), F.max(pending > 0).alias("pending"), F.max(applied > 0).alias("applied")).where("known")
    return out.select("doc", F.when(F.col("pending"), "pending_apply").when(F.col("applied"), "applied").otherwise("no_apply_needed").alias("state"))


def catalog(sources: DataFrame) -> DataFrame:
    """sources, tables, reviewed, modified, marked, missing: totals of a project; sources whose files are missing
    (available false) are counted apart and add nothing."""
    there = F.col("available")
    return sources.agg(F.count_if(there).alias("sources"), *(F.sum(F.when(there, F.col(c)).otherwise(0)).alias(c) for c in ("tables", "reviewed", "modified", "marked")), F.count_if(~there).alias("missing"))


def matching_tables(tables: DataFrame, show: str = "all", words: str = "") -> DataFrame:
    """Tables that a reviewer's filter shows, of ``tables``: doc, id, name, pages, status, changed, marked, note, state."""
    noted = F.trim(F.coalesce("note", F.lit(""))) != ""
    filters = {
        "all": F.lit(True), "pending": F.col("status") == "unreviewed", "modified": F.col("changed") > 0, "marked": F.coalesce("marked", F.lit(False)), "noted": noted,
        "ignored": F.col("status") == "ignored", "no_apply": F.col("state") == "no_apply_needed", "applied": F.col("state") == "applied",
    }
    label = F.lower(F.concat_ws(" ", "name", "id", text.page_label(F.col("pages"))))
    return tables.where(filters[show] & F.contains(label, F.lit(words.strip().lower())))


def matching_sources(sources: DataFrame, tables: DataFrame, show: str = "all", words: str = "") -> DataFrame:
    """Sources (doc, path, name) whose path or name holds ``words`` and that have a table the filter shows."""
    label = F.lower(F.concat_ws(" ", "path", "name"))
    named = sources.where(F.contains(label, F.lit(words.strip().lower())))
    return named.join(matching_tables(tables, show).select("doc").distinct(), "doc", "left_semi")


def fragments(tables: DataFrame, layout: DataFrame) -> DataFrame:
    """doc, id, pos, layout_id, page, status, markdown, rows: the layout tables that a table's lineage names, in order;
    unknown ids are skipped.  ``tables``: doc, id, layout_ids; ``layout``: doc, layout_id, page, status, markdown."""
    each = tables.select("doc", "id", F.posexplode("layout_ids").alias("pos", "layout_id"))
    out = each.join(layout.select("doc", "layout_id", "page", "status", "markdown"), ["doc", "layout_id"])
    return out.select("doc", "id", "pos", "layout_id", "page", "status", "markdown", grid.first_table(F.col("markdown")).alias("rows"))


def regions(tables: DataFrame, layout: DataFrame) -> DataFrame:
    """doc, id, page, box: where a table stands on each page: its own boxes, its main one on its page, and those of
    its layout tables on pages that have none.  ``tables``: doc, id, page, box, boxes (map), layout_ids."""
    own = tables.select("doc", "id", F.explode("boxes").alias("page", "box"), F.lit(0).alias("rank"))
    main = tables.select("doc", "id", "page", "box", F.lit(1).alias("rank"))
    each = tables.select("doc", "id", F.posexplode("layout_ids").alias("pos", "layout_id"))
    other = each.join(layout.select("doc", "layout_id", "page", "box"), ["doc", "layout_id"]).select("doc", "id", "page", "box", (F.col("pos") + 2).alias("rank"))
    every = own.unionByName(main).unionByName(other).where("box is not null")
    return every.groupBy("doc", "id", "page").agg(F.min_by("box", "rank").alias("box"))


def combined(parts: DataFrame) -> DataFrame:
    """doc, id, rows: a table's fragments, one below the other, as one grid."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "rows"))), lambda x: x["rows"])
    return parts.groupBy("doc", "id").agg(listed.alias("x")).select("doc", "id", grid.stitched(F.col("x")).alias("rows"))


def detail(tables: DataFrame, drafts: DataFrame, parts: DataFrame) -> DataFrame:
    """doc, id, ai_rows, current_rows, rows, layout_rows, status, differences, manual_differences: one table as a
    reviewer sees it.  ``tables``: doc, id, ai_rows, current_rows; ``drafts``: doc, tab, rows, status."""
    d = drafts.select("doc", F.col("tab").alias("id"), F.col("rows").alias("drafted"), review_status(F.col("status")).alias("status"))
    lay = combined(parts).withColumnRenamed("rows", "layout_rows")
    out = tables.join(d, ["doc", "id"], "left").join(lay, ["doc", "id"], "left").withColumn("layout_rows", F.coalesce("layout_rows", F.array().cast(ROWS)))
    out = out.withColumn("rows", F.coalesce("drafted", "current_rows", "ai_rows"))
    count = lambda a, b: F.size(grid.changed_cells(F.col(a), F.col(b))).cast("long")
    return out.select(
        "doc", "id", "ai_rows", F.coalesce("current_rows", "ai_rows").alias("current_rows"), "rows", "layout_rows", F.coalesce("status", F.lit("unreviewed")).alias("status"),
        count("ai_rows", "layout_rows").alias("differences"), count("rows", "ai_rows").alias("manual_differences"),
    )


def _useful_cells(cells: DataFrame) -> DataFrame:
    """doc, tab, page, value, own: a grid's different useful cells, its first page and the number of those cells."""
    grid_ = Window.partitionBy("doc", "tab")
    each = cells.groupBy("doc", "tab", "value").agg(F.min("page").alias("page"))
    each = each.withColumn("page", F.min("page").over(grid_)).withColumn("own", F.count_if(text.useful(F.col("value"))).over(grid_))
    return each.where(text.useful(F.col("value")))


def content_overlap(a: DataFrame, b: DataFrame, shared: int = 3, recall: float = 0.45) -> DataFrame:
    """doc, tab, other, n_shared, recall: for each grid of ``a`` the grid of ``b`` that has most of its useful cells.

    Both: doc, tab, page, value (cell keys).  Grids meet on equal cells inside of a document; the best has the
    largest recall, then most shared cells, then the nearest page, then the smallest id.  Every step is by document,
    so that inputs dealt by document are dealt no more: a document's grids bound the lists of those that hold a cell."""
    one = F.struct("tab", "page", "own")
    left, right = (_useful_cells(d).select("doc", "value", *(F.when(F.lit(n == m), one).alias(m) for m in "ab")) for n, d in (("a", a), ("b", b)))
    held = left.unionByName(right).groupBy("doc", "value").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    pairs = held.select("doc", F.explode("a").alias("x"), "b").select("doc", "x", F.explode("b").alias("y"))
    pairs = pairs.select("doc", "x.tab", F.col("y.tab").alias("other"), "x.own", F.abs(F.col("x.page") - F.col("y.page")).alias("far")).where("tab <> other")
    good = pairs.groupBy("doc", "tab", "other", "own", "far").agg(F.count("*").alias("n_shared")).withColumn("recall", F.col("n_shared") / F.col("own"))
    good = good.where((F.col("n_shared") >= shared) & (F.col("recall") >= recall))
    order = Window.partitionBy("doc", "tab").orderBy(F.desc("recall"), F.desc("n_shared"), "far", "other")
    return good.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc", "tab", "other", "n_shared", "recall")


def number_match(lost: DataFrame, tables: DataFrame, reach: int = 5) -> DataFrame:
    """doc, tab, other: grids without an overlap whose text names the number of exactly one table near their page.

    ``lost``: doc, tab, page, text; ``tables``: doc, other, there (page), name."""
    left = lost.select("doc", "tab", "page", text.table_number(F.col("text")).alias("number"))
    right = tables.select("doc", "other", "there", text.table_number(F.coalesce("name", F.lit(""))).alias("number"))
    near = left.join(right, ["doc", "number"]).where(F.abs(F.col("page") - F.col("there")) <= reach)
    one = near.groupBy("doc", "tab").agg(F.count("*").alias("n"), F.min("other").alias("other"))
    return one.where("n = 1").select("doc", "tab", "other")


def transition_pages(tables: DataFrame, blocks: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc, id, page, others, markers, confidence: last pages of spanning tables that hold another table too.

    ``tables``: doc, id, pages, and a box on the last page; ``blocks``: doc, page, ord, kind, a box, markdown.  Another
    agent table below makes it sure; a section header or a table's title between the table's end and a lower
    layout table makes it a candidate."""
    spans = tables.where(F.size("pages") > 1).select("doc", F.col("id").alias("span"), F.element_at("pages", -1).alias("page"), F.col("top").alias("t_top"), F.col("bottom").alias("t_bottom"))
    others = tables.select("doc", "id", F.explode("pages").alias("page"), "x0", "top", "x1", "bottom")
    upper = G.Box(None, F.col("t_top"), None, F.col("t_bottom"))
    meet = spans.join(others, ["doc", "page"]).where((F.col("id") != F.col("span")) & G.is_below(upper, G.box(), tolerance))
    sure = meet.groupBy("doc", "span", "page").agg(F.sort_array(F.collect_set("id")).alias("others"))
    here = spans.join(blocks.select("doc", "page", "ord", "kind", "top", "bottom", "markdown"), ["doc", "page"])
    lower = here.where((F.col("kind") == "table") & (F.col("top") >= F.col("t_bottom") - tolerance) & (F.col("top") > F.col("t_top") + tolerance))
    lowest = lower.groupBy("doc", "span", "page").agg(F.max("top").alias("low"))
    titled = (F.col("kind") == "section_header") | F.rlike("markdown", F.lit(text.TABLE_NUMBER))
    between = here.where((F.col("kind") != "table") & titled & (F.col("top") >= F.col("t_bottom") - tolerance)).join(lowest, ["doc", "span", "page"]).where(F.col("bottom") <= F.col("low") + tolerance)
    marks = between.groupBy("doc", "span", "page").agg(F.sort_array(F.collect_set("ord")).alias("markers"))
    out = sure.join(marks, ["doc", "span", "page"], "full_outer")
    return out.select(
        "doc", F.col("span").alias("id"), "page", F.coalesce("others", F.array().cast("array<bigint>")).alias("others"), F.coalesce("markers", F.array().cast("array<int>")).alias("markers"),
        F.when(F.size("others") > 0, "high").otherwise("candidate").alias("confidence"),
    )


def effective_rows(tables: DataFrame, drafts: DataFrame) -> DataFrame:
    """``tables`` (doc, id, ai_rows, ..) with rows and status: a draft's rows, or ai_rows where it has none."""
    d = drafts.select("doc", F.col("tab").alias("id"), F.col("rows").alias("drafted"), review_status(F.col("status")).alias("status"))
    rows = F.when(F.size("drafted") > 0, F.col("drafted")).otherwise(F.col("ai_rows"))
    out = tables.join(d, ["doc", "id"], "left").withColumn("rows", rows).drop("drafted")
    return out.withColumn("status", F.coalesce("status", F.lit("unreviewed")))


def publish(outputs: DataFrame, tables: DataFrame) -> DataFrame:
    """doc, markdown, problem, published, ignored: outputs with every table's block rewritten from its rows.

    ``outputs``: doc, markdown; ``tables``: what effective_rows gives, with page, name, header_rows.  Each
    old block must stand in the output exactly once, as written or with line breaks in cells flattened,
    and the new rows must not be empty; else ``problem`` names the first such table and the document
    stays as it was.  All tables are published, whatever their status.  A document is folded in one row."""
    marker = F.format_string("<!-- table:%s page:%s -->\n\n", F.col("id").cast("string"), F.col("page").cast("string"))
    flat = F.transform("ai_rows", lambda r: F.transform(r, lambda v: F.regexp_replace(v, r"\s*[\r\n]+\s*", " ")))
    block = lambda rows: F.concat(marker, grid.markdown(rows, F.col("header_rows"), F.col("name")))
    part = F.struct(F.col("id").cast("string").alias("id"), block(F.col("ai_rows")).alias("old"), block(flat).alias("flat"), block(F.col("rows")).alias("new"), (F.size("rows") > 0).alias("filled"))
    parts = tables.groupBy("doc").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.count("*").alias("n"), F.count_if(F.col("status") == "ignored").alias("ignored"))
    pick = "if(contains(acc.text, t.old), t.old, t.flat)"
    fits = f"(t.filled and length(acc.text) - length(replace(acc.text, {pick}, '')) = length({pick}))"
    fold = F.expr(f"""
        aggregate(coalesce(parts, array()), named_struct('text', markdown, 'problem', cast(null as string)), (acc, t) ->
          named_struct('text', if({fits}, replace(acc.text, {pick}, t.new), acc.text),
                       'problem', coalesce(acc.problem, if({fits}, cast(null as string), t.id))))""")
    done = outputs.select("doc", "markdown").join(parts, "doc", "left").withColumn("done", fold)
    good = F.col("done.problem").isNull()
    count = lambda c: F.when(good, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return done.select("doc", F.when(good, F.col("done.text")).otherwise(F.col("markdown")).alias("markdown"), "done.problem", count("n").alias("published"), count("ignored").alias("ignored"))
