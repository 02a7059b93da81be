"""What agents are asked about pages, and what their replies make of images and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text
from . import agents, candidates, pages, regions
from . import replies as said

KEY = ["doc", "page"]
READABLE = ("exact", "approximate")


def page_jobs(wanted: DataFrame, sizes: DataFrame, fonts: DataFrame, budget: int = 30_000, pixels: int = 12) -> DataFrame:
    """doc, page, job, prompt, dpi, reduced, patches: one job for each candidate page, rendered so that its small text
    can be read and its image fits the patch budget.

    ``sizes``: doc, page, width, height in points; ``fonts``: doc, page, size of each character.  A page has few
    sizes of type, so they are counted before they are listed; the 20th percentile is that of all characters."""
    counts = fonts.where("size > 0").groupBy(*KEY, "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*KEY).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("n").over(order)).withColumn("place", F.bround((F.sum("n").over(Window.partitionBy(*KEY)) - 1) * 0.2))
    small = run.where(F.col("upto") > F.col("place")).groupBy(*KEY).agg(F.min("size").alias("small"))
    out = wanted.select(*KEY).join(sizes, KEY).join(small, KEY, "left").withColumn("pages", F.col("page").cast("string"))
    target = text.text_dpi(F.array(F.coalesce("small", F.lit(8.0))), pixels)
    out = out.withColumn("target", target).withColumn("dpi", text.render_dpi(F.col("width"), F.col("height"), F.col("target"), budget))
    size = lambda c: F.ceil(F.col(c) * F.col("dpi") / 72.0)
    return out.select(*KEY, F.format_string("page-%04d", "page").alias("job"), agents.prompt("extraction").alias("prompt"), "dpi", (F.col("dpi") < F.col("target")).alias("reduced"), text.patch_count(size("width"), size("height")).alias("patches"))


def image_jobs(wanted: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc, page, job, prompt: one job for each page with images: its pictures as fractions of the page, numbered, and
    the last headings up to it.  ``blocks``: doc, page, ord, id, kind, a box, markdown."""
    pictures = blocks.where("kind = 'picture' and x0 is not null").withColumn("picture", F.col("id"))
    hints = candidates.picture_hints(pictures, sizes)
    heads = candidates.headings_so_far(blocks)
    out = wanted.select(*KEY).join(hints, KEY, "left").join(heads, KEY, "left")
    out = out.withColumn("hints", F.coalesce(F.to_json("hints"), F.lit("[]"))).withColumn("headings", F.coalesce(F.to_json("headings"), F.lit("[]")))
    return out.select(*KEY, F.format_string("page-%04d", "page").alias("job"), agents.prompt("image").alias("prompt"))


def detection_jobs(selected: DataFrame, size: int = 8) -> DataFrame:
    """doc, batch, pages, job, prompt: batches of pages that one call looks at, with the page before as context."""
    order = Window.partitionBy("doc").orderBy("page")
    batch = candidates.batches(selected, size).select("doc", "batch", F.col("context").alias("before"))
    numbered = selected.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    out = numbered.groupBy("doc", "batch").agg(F.sort_array(F.collect_list("page")).alias("wanted")).join(batch, ["doc", "batch"])
    context = F.when(F.col("before").isNotNull(), F.concat(F.lit(" The first image, page "), F.col("before").cast("string"), F.lit(", is only there to compare.")))
    out = out.withColumn("pages", agents.listed(F.col("wanted"))).withColumn("context", context)
    return out.select("doc", "batch", "wanted", F.format_string("batch-%04d", "batch").alias("job"), agents.prompt("detection").alias("prompt")).withColumnRenamed("wanted", "pages")


def plans(chains: DataFrame, agent: agents.Agent, least: int = 3, **options) -> DataFrame:
    """doc, lead, groups, problem: how an agent groups the pages of chains of at least ``least`` pages; a plan that
    breaks a rule is a problem, with no groups.  ``chains``: doc, lead, pages, images."""
    long = chains.where(F.size("pages") >= least).withColumn("job", F.format_string("plan-%04d", "lead"))
    asked = long.withColumn("listed", agents.listed(F.col("pages"))).drop("pages").withColumnRenamed("listed", "pages").withColumn("prompt", agents.prompt("merge_plan"))
    found = agents.replies(asked.select("doc", "job", "prompt", "images"), agent, **options).select("doc", "job", F.col("reply").alias("text"), "message")
    read = said.merge_groups(long.select("doc", "lead", "pages", "job").join(found, ["doc", "job"], "left"))
    problem = F.when(F.col("groups").isNull(), F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit("plan breaks a rule")))
    return read.select("doc", "lead", "groups", problem.alias("problem"))


def seen_images(reply_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc, page, image, ids, a box in points, and what was said of it, for each image of good replies.

    ``reply_rows``: doc, page, reply (JSON text of a reply that image_issues() finds nothing in)."""
    shape = (
        f"images array<struct<bbox:struct<left:double,top:double,right:double,bottom:double>,{said.NAMED_PICTURES}:array<string>,classification:string,alt_text:string,description:string,"
        "confidence:double,include_in_markdown:boolean,needs_table_review:boolean,chart:struct<status:string,columns:array<string>,rows:array<array<string>>,unit:string,notes:array<string>>>>"
    )
    read = reply_rows.select(*KEY, F.posexplode(F.from_json(said.json_object(F.col("reply"), "images"), shape)["images"]).alias("pos", "i")).join(sizes, KEY)
    b = regions.from_fractions(*(F.col(f"i.bbox.{n}") for n in ("left", "top", "right", "bottom")), F.col("width"), F.col("height"))
    return read.select(
        *KEY, (F.col("pos") + 1).alias("image"), F.coalesce(F.col(f"i.{said.NAMED_PICTURES}"), F.array().cast("array<string>")).alias("ids"), *(c.alias(n) for n, c in zip(G.Box._fields, b)),
        F.coalesce("i.include_in_markdown", F.lit(True)).alias("included"), F.coalesce("i.needs_table_review", F.lit(False)).alias("needs_table_review"),
        F.struct("i.classification", "i.alt_text", "i.description", "i.confidence").alias("analysis"), F.col("i.chart").alias("chart"),
    )


def analysed(known: DataFrame, seen: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, page, id, block, ord, source, status, included, needs_table_review, analysis, chart_csv of all images.

    ``known``: doc, page, id, block (of the layout's picture), ord, a box; ``seen``: see seen_images(); ``asked``: doc,
    page, ok of the pages that were looked at.  Known images of pages whose job failed are "failed", those that no
    reply names "not_returned", those that became part of a new one "merged" and hidden; images that fit none are
    new, numbered after the known ones and placed after what stands above them."""
    matched = pages.match_images(seen.select(*KEY, "image", "ids", *G.Box._fields), known.select(*KEY, F.col("block").alias("picture"), "ord", *G.Box._fields))
    facts = matched.join(seen.drop("ids"), [*KEY, "image"])
    status = F.when(F.col("action") == "merged", "merged").when(F.col("action") == "matched", "completed")
    hit = facts.where("action <> 'new'").select(*KEY, F.col("picture").alias("block"), status.alias("status"), (F.col("included") & (F.col("action") == "matched")).alias("shown"), "needs_table_review", "analysis", "chart")
    old = known.join(asked, KEY, "left").join(hit, [*KEY, "block"], "left")
    state = F.coalesce("status", F.when(~F.coalesce("ok", F.lit(True)), "failed"), F.lit("not_returned"))
    one = old.select(*KEY, "id", "block", F.col("ord").cast("double").alias("ord"), F.when(F.col("status") == "completed", "layout+vision").otherwise("layout").alias("source"), state.alias("status"), F.coalesce("shown", F.lit(True)).alias("included"), F.coalesce("needs_table_review", F.lit(False)).alias("needs_table_review"), "analysis", "chart")
    fresh = facts.where("action = 'new'").join(pages.next_image_index(known), "doc", "left")
    turn = F.row_number().over(Window.partitionBy("doc").orderBy("page", "image")) - 1
    fresh = fresh.withColumn("id", F.format_string("image-%04d", turn + F.coalesce("next", F.lit(1))))
    two = fresh.join(pages.image_slots(fresh, blocks), [*KEY, "id"]).select(*KEY, "id", F.lit(None).cast(known.schema["block"].dataType).alias("block"), F.col("slot").alias("ord"), F.lit("vision").alias("source"), F.lit("completed").alias("status"), "included", "needs_table_review", "analysis", "chart")
    path = F.when(F.col("chart.status").isin(*READABLE), F.concat(F.lit("assets/chart-tables/"), "id", F.lit(".csv")))
    return one.unionByName(two).select("doc", "page", "id", "block", "ord", "source", "status", "included", "needs_table_review", "analysis", path.alias("chart_csv"))
