"""Which layout tables became part of which agent tables, in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .pages import BOX, KEY, LEAST_OVERLAP, box_of, hidden_before, let, none_of

LEAD = 0.05
#: Relations by which a table goes on on a later page.
CONTINUED = ("continuation_source_page", "continuation_horizontal_overlap")
PUBLIC = ("id", "name", "page", "source_pages", "page_table_index", "bbox", "page_bboxes", "csv", "extra_csvs", "header_rows", "merge", "lineage")


def page_box(boxes: Column | None, page: Column, own: G.Box) -> G.Box:
    """A table's box on ``page``: the one of a map by page, else its main one."""
    if boxes is None:
        return own
    there = F.try_element_at(boxes, page)
    return G.Box(*(F.coalesce(there[n].cast("double"), o) for n, o in zip(BOX, own)))


def reached(tables: DataFrame) -> DataFrame:
    """doc, page, reach: tables (id and a box) that begin on another page and reach this one."""
    boxes = F.col("page_boxes") if "page_boxes" in tables.columns else None
    reach = tables.select("doc", "id", F.col("page").alias("anchor"), *BOX, *(["page_boxes"] if boxes is not None else []), F.explode("pages").alias("page")).where("page <> anchor")
    own = page_box(boxes, F.col("page"), G.box())
    return reach.select(*KEY, F.struct("id", *(c.alias(n) for n, c in zip(BOX, own))).alias("t")).groupBy(*KEY).agg(F.collect_list("t").alias("reach"))


def scores(reach: Column, box: G.Box) -> Column:
    """(score, id) of tables that reach a block's page, by falling overlap, then falling id."""
    return F.sort_array(F.transform(reach, lambda t: F.struct(G.horizontal_overlap(box_of(t), box).alias("score"), t["id"].cast("long").alias("id"))), asc=False)


def continues(c: Column, least: float, lead: float) -> Column:
    """By which relation a free block continues the first of its scores(); null if it has none."""
    top, second = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    return (
        F.when(F.size(c) < 1, None).when((F.size(c) == 1) & (top["score"] >= least), CONTINUED[0])
        .when((F.size(c) > 1) & (top["score"] >= least) & (top["score"] - second["score"] > lead), CONTINUED[1]).when(F.size(c) > 0, "ambiguous_continuation")
    )


def outcomes(tables: DataFrame, blocks: DataFrame, direct: DataFrame, least: float = LEAST_OVERLAP, lead: float = LEAD) -> DataFrame:
    """doc, page, ord, id, method, overlap, turn, n, candidates: every layout table and the one relation it has, if any.

    ``tables``: doc, id, page (anchor), pages (all of its pages), a box, and page_boxes (map by page) if they
    differ; ``direct``: what direct_relations() gives.  A block that a table claimed has turn 0.  A free one is held
    against tables that reach its page (turn 1).  One candidate is taken from ``least`` horizontal overlap on; of
    several the best, if it leads by more than ``lead``; otherwise the method is ambiguous_continuation and id is
    null.  Candidates stand by falling overlap, then falling id.  Claims and candidates of a page come as lists, so
    that blocks stay where they are and claims are worked out once."""
    more = [F.col(c) if c in direct.columns else F.lit(None).cast(k).alias(c) for c, k in (("id", "long"), ("method", "string"), ("overlap", "double"), ("n", "int"))]
    claims = direct.select(*KEY, F.struct(F.col("ord").cast("int").alias("ord"), *more).alias("x")).groupBy(*KEY).agg(F.collect_list("x").alias("claims"))
    here = blocks.where("kind = 'table'").select(*KEY, "ord", *(F.col(c).cast("double").alias(c) for c in BOX)).join(claims, KEY, "left").join(reached(tables), KEY, "left")
    claim = F.get(F.filter("claims", lambda x: x["ord"] == F.col("ord")), F.lit(0))
    here = here.select(*KEY, "ord", *BOX, "reach", claim.alias("claim"))
    here = here.select(*KEY, "ord", "claim", F.when(F.col("claim").isNull() & F.col("x0").isNotNull(), scores(F.col("reach"), G.box())).alias("c"))
    top = F.get("c", F.lit(0))
    here = here.withColumn("method", continues(F.col("c"), least, lead))
    claimed, taken, unsure = F.col("claim").isNotNull(), F.col("method").isin(*CONTINUED), F.col("method") == "ambiguous_continuation"
    return here.select(
        *KEY, "ord", F.when(claimed, F.col("claim.id").cast("long")).when(taken, top["id"]).alias("id"), F.coalesce("claim.method", "method").alias("method"),
        F.when(claimed, F.col("claim.overlap")).when(taken, F.bround(top["score"], 4)).alias("overlap"), F.when(claimed, 0).when(F.col("method").isNotNull(), 1).alias("turn"),
        F.when(claimed, F.col("claim.n").cast("int")).otherwise(F.col("ord").cast("int")).alias("n"), F.when(unsure, F.transform("c", lambda x: x["id"])).otherwise(none_of("array<bigint>")).alias("candidates"),
    )


def continuations(tables: DataFrame, blocks: DataFrame, direct: DataFrame, least: float = LEAST_OVERLAP, lead: float = LEAD) -> DataFrame:
    """doc, page, ord, status, id, overlap, candidates: free layout tables that agent tables reach, from outcomes();
    of ``direct`` doc, page and ord are enough."""
    return continued(outcomes(tables, blocks, direct, least, lead))


def continued(found: DataFrame) -> DataFrame:
    return found.where("turn = 1").select(*KEY, "ord", F.col("method").alias("status"), "id", "overlap", "candidates")


def numbered(found: DataFrame) -> DataFrame:
    """outcomes() with layout_id, as layout_ids() gives it."""
    order = Window.partitionBy("doc").orderBy("page", "ord")
    return found.withColumn("layout_id", F.format_string("layout-table-%04d", F.row_number().over(order)))


def layout_ids(blocks: DataFrame) -> DataFrame:
    """doc, page, ord, layout_id: layout tables of a document numbered in reading order."""
    order = Window.partitionBy("doc").orderBy("page", "ord")
    numbered = blocks.where("kind = 'table'").withColumn("n", F.row_number().over(order))
    return numbered.select(*KEY, "ord", F.format_string("layout-table-%04d", "n").alias("layout_id"))


def edges(direct: DataFrame, continued: DataFrame) -> DataFrame:
    """doc, id, page, ord, method, overlap, turn: all relations; a table's direct ones come before its continuations."""
    first = direct.select("doc", F.col("id").cast("long"), "page", "ord", "method", "overlap", F.lit(0).alias("turn"), F.col("n").cast("int").alias("n"))
    later = continued.where("id is not null").select("doc", F.col("id").cast("long"), "page", "ord", F.col("status").alias("method"), "overlap", F.lit(1).alias("turn"), F.col("ord").cast("int").alias("n"))
    return first.unionByName(later)


def by_table(tables: DataFrame, relations: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, id, action, layout_ids, relations: the lineage of each agent table, from edges() and layout_ids()."""
    return by_table_of(tables, relations.join(ids, [*KEY, "ord"]))


def by_table_of(tables: DataFrame, relations: DataFrame) -> DataFrame:
    """by_table() of relations that have their layout_id."""
    item = F.struct("turn", "page", "n", F.struct("layout_id", "page", "ord", "method", "overlap").alias("r"))
    listed = relations.where("id is not null").groupBy("doc", "id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["r"]).alias("relations"))
    out = tables.select("doc", F.col("id").cast("long").alias("id"), F.size("pages").alias("n_pages")).join(listed, ["doc", "id"], "left")
    found = F.coalesce(F.size("relations"), F.lit(0))
    found = F.when(F.col("relations").isNull(), 0).otherwise(found)
    action = F.when(found == 0, "inserted_without_layout_table").when((found > 1) | (F.col("n_pages") > 1), "merged_from_layout_tables").otherwise("replaced_layout_table")
    listed = F.coalesce("relations", none_of(out.schema["relations"].dataType.simpleString()))
    return out.select("doc", "id", action.alias("action"), F.transform(listed, lambda r: r["layout_id"]).alias("layout_ids"), listed.alias("relations"))


def by_layout_table(ids: DataFrame, relations: DataFrame, continued: DataFrame) -> DataFrame:
    """doc, layout_id, page, ord, status, replacements, candidates: what became of each layout table."""
    took = relations.groupBy(*KEY, "ord").agg(F.sort_array(F.collect_list("id")).alias("replacements"), F.bool_or(F.col("method").startswith("continuation_")).alias("absorbed"))
    unsure = continued.where("id is null").select(*KEY, "ord", "candidates")
    out = ids.join(took, [*KEY, "ord"], "left").join(unsure, [*KEY, "ord"], "left")
    status = F.when(F.col("absorbed"), "absorbed_into_merged_table").when(F.col("replacements").isNotNull(), "replaced").when(F.size("candidates") > 0, "ambiguous_continuation").otherwise("unmatched")
    empty = none_of("array<bigint>")
    return out.select("doc", "layout_id", "page", "ord", status.alias("status"), F.coalesce("replacements", empty).alias("replacements"), F.coalesce("candidates", empty).alias("candidates"))


def layout_status(found: DataFrame) -> DataFrame:
    """doc, page, ord, status, id, candidates: what became of each layout table, straight from outcomes()."""
    named = {"bbox_overlap": "replaced", "bbox_contains_center": "replaced", **dict.fromkeys(CONTINUED, "absorbed_into_merged_table"), "ambiguous_continuation": "ambiguous_continuation"}
    status = F.coalesce(*(F.when(F.col("method") == k, v) for k, v in named.items()), F.lit("unmatched"))
    return found.select(*KEY, "ord", status.alias("status"), "id", "candidates")


def retained(records: DataFrame, blocks: DataFrame, keep: bool) -> DataFrame:
    """``records`` of by_layout_table() with retained, markdown (the path of their export) and text (what it holds)."""
    own = blocks.select(*KEY, "ord", F.concat(F.rtrim("markdown"), F.lit("\n")).alias("text"))
    path = F.concat(F.lit("assets/layout-tables/"), "layout_id", F.lit(".md"))
    out = records.join(own, [*KEY, "ord"], "left")
    return out.select(*records.columns, F.lit(keep).alias("retained"), F.when(F.lit(keep), path).alias("markdown"), F.when(F.lit(keep), F.col("text")).alias("text"))


def public_tables(tables: DataFrame) -> DataFrame:
    """Only those fields of table records that final metadata may show."""
    return tables.select("doc", *(c for c in PUBLIC if c in tables.columns))


def numbered_headings(contained: DataFrame, blocks: DataFrame, relations: DataFrame, numbered) -> DataFrame:
    """doc, page, ord, heading: numbered captions inside of directly replaced layout tables; the last of several."""
    said = blocks.where("kind = 'caption'").where(numbered(F.col("markdown"))).select(*KEY, "ord", F.trim("markdown").alias("heading"))
    direct = relations.where("turn = 0").select(*KEY, F.col("ord").alias("other")).distinct()
    hit = contained.where("kind = 'table'").join(said, [*KEY, "ord"]).join(direct, [*KEY, "other"])
    last = hit.groupBy(*KEY, "other").agg(F.max(F.struct("ord", "heading")).alias("x"))
    return last.select(*KEY, F.col("other").alias("ord"), "x.heading")


def titled(frame: DataFrame, numbered) -> DataFrame:
    """``frame`` of held_captions() with headings (ord, heading), as numbered_headings() gives them for its pages."""

    def heading(x: Column, ord_: Column) -> Column:
        said = F.filter(x["contained"], lambda c: (c["other"] == ord_) & (c["kind"] == "table") & numbered(c["markdown"]))
        return F.array_max(F.transform(said, lambda c: F.struct(c["ord"].alias("ord"), F.trim(c["markdown"]).alias("heading"))))["heading"]

    each = lambda x: F.transform(x["claimed"], lambda o: F.struct(o.alias("ord"), heading(x, o).alias("heading")))
    return frame.withColumn("headings", F.filter(let(F.struct("claimed", "contained"), each), lambda h: h["heading"].isNotNull()))


def hidden(frame: DataFrame, least: float = LEAST_OVERLAP, lead: float = LEAD) -> DataFrame:
    """``frame`` of held_captions(), which has images and reach, with before: places of blocks that are gone before tables claim."""

    def goes_on(x: Column, b: Column) -> Column:
        free = (b["kind"] == "table") & b["x0"].isNotNull() & ~F.array_contains(x["claimed"], b["ord"])
        return F.when(free & (F.size(x["reach"]) > 0), let(scores(x["reach"], box_of(b)), lambda c: continues(c, least, lead)).isin(*CONTINUED)).otherwise(False)

    def page(x: Column) -> Column:
        continued = F.transform(F.filter(x["blocks"], lambda b: goes_on(x, b)), lambda b: b["ord"])
        return hidden_before(x["contained"], x["images"], continued)

    return frame.withColumn("before", let(F.struct("claimed", "contained", "blocks", "images", "reach"), page))
