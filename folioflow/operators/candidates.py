"""Candidate pages, runs of pages and work queues; everything is keyed by document.

Windows are partitioned by document, whose pages bound them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc", "page"]
SPEC = r"^\s*[1-9][0-9]{0,17}(-[1-9][0-9]{0,17})?\s*$"


def page_selection(specs: DataFrame, most: int | Column = 100_000) -> DataFrame:
    """id, pages, problem of each page list ("1,3,8-12"): sorted and unique; null where the list is not valid.

    ``most`` bounds pages (a number or a column, as the document's page count): one beyond it is a problem, so no
    list is longer than its document."""
    bound = most if isinstance(most, Column) else F.lit(most)
    parts = F.split("spec", ",")
    low = lambda p: F.split_part(F.trim(p), F.lit("-"), F.lit(1)).try_cast("bigint")
    high = lambda p: F.coalesce(F.nullif(F.split_part(F.trim(p), F.lit("-"), F.lit(2)), F.lit("")).try_cast("bigint"), low(p))
    formed = F.coalesce(F.forall(parts, lambda p: F.rlike(p, F.lit(SPEC)) & (high(p) >= low(p))), F.lit(False))
    inside = F.forall(parts, lambda p: high(p) <= bound)
    problem = F.when(~formed, "not_a_page_list").when(~inside, "beyond_last_page")
    listed = F.sort_array(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p).cast("int"), high(p).cast("int"))))))
    return specs.select("id", F.when(problem.isNull(), listed).alias("pages"), problem.alias("problem"))


def effective_pages(docs: DataFrame) -> DataFrame:
    """doc, pages: the selected pages of a document, all of them if none are; ``docs``: doc, selected, page_count."""
    every = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    return docs.select("doc", F.coalesce("selected", every).alias("pages"))


def selected_only(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` (doc, page, ..) on selected pages; ``pages``: doc, pages."""
    return rows.join(pages.select("doc", F.explode("pages").alias("page")), KEY, "left_semi")


def covering_range(pages: DataFrame) -> DataFrame:
    """doc, first, last: the smallest range of pages that a parser must read."""
    return pages.select("doc", F.array_min("pages").alias("first"), F.array_max("pages").alias("last"))


def vision_pages(detections: DataFrame) -> DataFrame:
    """Detections that saw a table, however sure they are."""
    return detections.where("coalesce(has_table, false) or coalesce(estimate, 0) > 0")


def image_pages(detections: DataFrame, images: DataFrame) -> DataFrame:
    """doc, page: pages where an image was seen or is known from the layout."""
    seen = detections.where("coalesce(has_image, false) or coalesce(image_count_estimate, 0) > 0")
    return seen.select(*KEY).unionByName(images.select(*KEY)).distinct()


def candidate_union(layout: DataFrame, detections: DataFrame, least_lines: int = 20, least_tables: int = 1) -> DataFrame:
    """doc, page, sources: pages with a layout table, a detected table, a ruled grid or many ruling lines, and who says so."""
    heuristic = detections.where((F.col("tables_found") >= least_tables) | (F.col("lines_and_rects") >= least_lines))
    said = {"layout": layout.where("kind = 'table'"), "vision": vision_pages(detections), "heuristic": heuristic}
    union = None
    for name, rows in said.items():
        rows = rows.select(*KEY, F.lit(name).alias("src"))
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("sources"))


def page_chains(pages: DataFrame) -> DataFrame:
    """doc, page, lead: a page joins the chain of the page before if it may and that page is there too."""
    order = Window.partitionBy("doc").orderBy("page")
    joins = F.col("may_merge") & F.coalesce(F.lag("page").over(order) == F.col("page") - 1, F.lit(False))
    marked = pages.select(*KEY, F.when(~F.coalesce(joins, F.lit(False)), F.col("page")).alias("start"))
    return marked.select(*KEY, F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"))


def ready_groups(detected: DataFrame, candidates: DataFrame, selected: DataFrame, scheduled: DataFrame | None = None) -> DataFrame:
    """doc, lead, pages, ready: chains of candidate pages; ready once nothing unknown can lengthen them.

    The page after the chain must be detected, or not selected at all; so must the page before, if the
    lead may merge with it.  Chains with a page in ``scheduled`` (doc, page) are left out."""
    chains = page_chains(detected.join(candidates.select(*KEY), KEY, "left_semi").select(*KEY, "may_merge"))
    if scheduled is not None:
        begun = chains.join(scheduled.select(*KEY), KEY, "left_semi").select("doc", "lead").distinct()
        chains = chains.join(begun, ["doc", "lead"], "left_anti")
    groups = chains.groupBy("doc", "lead").agg(F.count("*").alias("pages"), F.max("page").alias("last"))
    unknown = selected.select(*KEY).join(detected.select(*KEY), KEY, "left_anti")
    after = unknown.select("doc", (F.col("page") - 1).alias("last"), F.lit(True).alias("open_after"))
    before = unknown.select("doc", (F.col("page") + 1).alias("lead"), F.lit(True).alias("open_before"))
    merges = detected.select("doc", F.col("page").alias("lead"), "may_merge")
    out = groups.join(merges, ["doc", "lead"]).join(after, ["doc", "last"], "left").join(before, ["doc", "lead"], "left")
    waits = F.coalesce("open_after", F.lit(False)) | (F.col("may_merge") & F.coalesce("open_before", F.lit(False)))
    return out.select("doc", "lead", "pages", (~waits).alias("ready"))


def accepted_chains(jobs: DataFrame) -> DataFrame:
    """doc, lead, page: chains of pages that were accepted as continuations, their leads included.

    An accepted page goes on with the chain of the page before if that page was accepted too, is
    adjacent and the merge was hinted; else it opens a chain led by the job before, adjacent or not.
    Without a job before it there is nothing to continue, so it gives no row."""
    order = Window.partitionBy("doc").orderBy("page")
    marked = jobs.select(
        "doc", "page", "accepted", F.lag("page").over(order).alias("prev"),
        (F.coalesce("hinted", F.lit(False)) & F.coalesce(F.lag("accepted").over(order), F.lit(False)) & (F.lag("page").over(order) == F.col("page") - 1)).alias("goes_on"),
    )
    opened = F.when(F.col("accepted") & ~F.coalesce("goes_on", F.lit(False)), F.col("prev"))
    led = marked.withColumn("lead", F.last(opened, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = led.where("accepted and lead is not null")
    return found.select("doc", "lead", "page").unionByName(found.select("doc", "lead", F.col("lead").alias("page")).distinct())


def planned_chains(groups: DataFrame, jobs: DataFrame) -> DataFrame:
    """doc, lead, page: planned groups of several pages where a document has any, else its accepted_chains().

    ``groups``: doc, pages."""
    long = groups.where(F.size("pages") > 1)
    planned = long.select("doc", F.element_at("pages", 1).alias("lead"), F.explode("pages").alias("page"))
    return planned.unionByName(accepted_chains(jobs.join(long.select("doc").distinct(), "doc", "left_anti")))


def group_results(groups: DataFrame, results: DataFrame) -> DataFrame:
    """doc, page, code, message: each page of a group gets its leader's outcome.

    ``groups``: doc, lead, pages; ``results``: doc, lead, code, echoed (pages that the reply names), timed_out.  A
    call that timed out has code 124; one that does not name all pages, in order, code 2."""
    out = groups.join(results, ["doc", "lead"], "left")
    code = F.when(F.col("timed_out"), 124).when((F.col("code") == 0) & ~F.coalesce(F.col("echoed") == F.col("pages"), F.lit(False)), 2).otherwise(F.coalesce("code", F.lit(1)))
    message = F.when(code == 124, "timed out").when(code == 2, "not all pages were processed").when(code != 0, "failed")
    return out.select("doc", F.explode("pages").alias("page"), code.cast("int").alias("code"), message.alias("message"))


def batches(pages: DataFrame, size: int = 8) -> DataFrame:
    """doc, batch, first, last, n, context: fixed-size batches of a document's pages in order, with the page
    before as context if it is selected and adjacent."""
    order = Window.partitionBy("doc").orderBy("page")
    numbered = pages.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int")).withColumn("prev", F.lag("page").over(order))
    out = numbered.groupBy("doc", "batch").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n"), F.min(F.struct("page", "prev")).alias("x"))
    return out.select("doc", "batch", "first", "last", "n", F.when(F.col("x.prev") == F.col("first") - 1, F.col("x.prev")).alias("context"))


def sheets(pages: DataFrame, size: int = 12) -> DataFrame:
    """doc, sheet, pages: contact sheets of a document's pages."""
    order = Window.partitionBy("doc").orderBy("page")
    numbered = pages.withColumn("sheet", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    return numbered.groupBy("doc", "sheet").agg(F.sort_array(F.collect_list("page")).alias("pages"))


def queue_priority(groups: DataFrame, confirmed: str = "ready") -> DataFrame:
    """doc, lead, category, place: confirmed groups of several pages first, then pairs, then the rest; longer groups
    first, then earlier ones; place is the order in the document's queue."""
    category = F.when(F.col(confirmed) & (F.col("pages") > 1), 0).when(F.col("pages") == 2, 1).otherwise(2)
    order = Window.partitionBy("doc").orderBy("category", F.desc("pages"), "lead")
    out = groups.withColumn("category", category)
    return out.select("doc", "lead", "category", F.row_number().over(order).alias("place"))


def headings_so_far(blocks: DataFrame, most: int = 6) -> DataFrame:
    """doc, page, headings: the last ``most`` headings up to and on each page of a document that has blocks.

    A page's own last headings are listed first, so that the running list never holds more than a page's."""
    shown = F.col("kind").isin("title", "section_header")
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc(F.when(shown, F.col("ord")))))
    own = blocks.withColumn("n", place).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.when(shown & (F.col("n") <= most), F.struct("ord", "markdown")))).alias("own"))
    titles = own.select("doc", "page", F.explode("own").alias("t"))
    # the ``most`` headings before a page are among those numbered just before its first
    number = F.row_number().over(Window.partitionBy("doc").orderBy("page", "t.ord"))
    titles = titles.withColumn("number", number)
    upto = own.join(titles.groupBy(*KEY).agg(F.max("number").alias("m")), KEY, "left")
    upto = upto.withColumn("upto", F.max("m").over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = upto.where("upto is not null").select(*KEY, F.explode(F.sequence(F.greatest(F.lit(1), F.col("upto") - (most - 1)), F.col("upto"))).alias("number"))
    listed = wanted.join(titles.select("doc", "number", F.col("t.markdown").alias("said")), ["doc", "number"])
    out = listed.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "said"))), lambda x: x["said"]).alias("headings"))
    return own.select(*KEY).join(out, KEY, "left").select(*KEY, F.coalesce("headings", F.array().cast("array<string>")).alias("headings"))


def text_context(blocks: DataFrame, captions: int = 20, nearby: int = 20, length: int = 600) -> DataFrame:
    """doc, page, captions, nearby: a page's first captions and first other texts, cut to ``length`` characters, in order."""
    kind = F.when(F.col("kind") == "caption", "captions").when(~F.col("kind").isin("picture", "table", "title", "section_header"), "nearby")
    rows = blocks.withColumn("list", kind).where("list is not null and trim(markdown) <> ''")
    turn = F.row_number().over(Window.partitionBy("doc", "page", "list").orderBy("ord"))
    first = rows.withColumn("n", turn).where(((F.col("list") == "captions") & (F.col("n") <= captions)) | ((F.col("list") == "nearby") & (F.col("n") <= nearby)))
    item = F.struct("n", F.substring("markdown", 1, length).alias("said"))
    texts = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("list") == name, item))), lambda x: x["said"]).alias(name)
    return first.groupBy(*KEY).agg(texts("captions"), texts("nearby"))


def picture_hints(pictures: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc, page, hints: pictures of a page in order, numbered, with boxes as fractions of the page (6 places).

    ``pictures``: doc, page, ord, picture and a box; ``sizes``: doc, page, width, height."""
    each = pictures.join(sizes, KEY)
    part = lambda c, of: F.bround(F.col(c) / F.col(of), 6).alias(c)
    item = F.struct("ord", "picture", part("x0", "width"), part("top", "height"), part("x1", "width"), part("bottom", "height"))
    listed = each.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return listed.select(*KEY, F.transform("x", lambda x, i: F.struct((i + 1).alias("n"), x["picture"].alias("picture"), x["x0"].alias("left"), x["top"].alias("top"), x["x1"].alias("right"), x["bottom"].alias("bottom"))).alias("hints"))


def limited(jobs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pending jobs (doc, path, state) by path, after those that need no work were left out."""
    return jobs.where("state = 'pending'").orderBy(F.lower("path"), "path").limit(n)


def in_number_order(scripts: DataFrame) -> DataFrame:
    """``scripts`` (doc, folder) with place: by the number that ends a folder's name; names without one come last."""
    number = F.coalesce(F.regexp_extract("folder", r"_(\d+)$", 1).try_cast("int"), F.lit(2**31 - 1))
    return scripts.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(number, "folder")))
