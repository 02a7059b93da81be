"""Boxes and pages of one table: roles, accumulation over pages, units, crops, row bounds, chains' endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def consecutive(pages: Column) -> Column:
    """Whether pages are a run without gaps; false for none."""
    steps = F.transform(pages, lambda p, i: p - i)
    return (F.size(pages) > 0) & F.forall(steps, lambda x: x == F.get(pages, F.lit(0)))


def expected_roles(pages: Column) -> Column:
    """Roles that a table over ``pages`` has boxes for."""
    n = F.size(pages)
    return F.when(n == 1, F.array(F.lit("first"))).when(n == 2, F.array(F.lit("first"), F.lit("last"))).otherwise(F.array(F.lit("first"), F.lit("last"), F.lit("middle")))


def expanded_boxes(tables: DataFrame) -> DataFrame:
    """``tables`` (pages, roles: map of role to box) with problem and boxes (map of page to box).

    The first and the last page have boxes of their own, all between share the middle one."""
    pages = F.col("pages")
    problem = (
        F.when(~F.coalesce(consecutive(pages), F.lit(False)), "pages_not_consecutive")
        .when(F.array_sort(F.map_keys("roles")) != expected_roles(pages), "wrong_roles")
    )
    role = lambda i: F.when(i == 0, "first").when(i == F.size(pages) - 1, "last").otherwise("middle")
    boxes = F.map_from_entries(F.transform(pages, lambda p, i: F.struct(p, F.try_element_at("roles", role(i)))))
    return tables.withColumn("problem", problem).withColumn("boxes", F.when(problem.isNull(), boxes))


def box_problem(b: G.Box, width: Column, height: Column) -> Column:
    """What is wrong with a box on a page of this size; null if nothing."""
    return F.when((b.x0 >= b.x1) | (b.top >= b.bottom), "empty").when(~G.inside_page(b, width, height), "outside")


def accumulated(writes: DataFrame) -> DataFrame:
    """doc, id, page, pages, box, boxes: all boxes written for a table; of one page the last write counts.

    ``writes``: doc, id, seq, page, box.  The smallest page anchors the table."""
    last = writes.groupBy("doc", "id", "page").agg(F.max_by("box", "seq").alias("box"))
    listed = F.sort_array(F.collect_list(F.struct("page", "box")))
    out = last.groupBy("doc", "id").agg(listed.alias("x"))
    return out.select("doc", "id", F.col("x")[0]["page"].alias("page"), F.col("x.page").alias("pages"), F.col("x")[0]["box"].alias("box"), F.map_from_entries("x").alias("boxes"))


def from_fractions(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> G.Box:
    return G.Box(left * width, top * height, right * width, bottom * height)


def to_fractions(b: G.Box, width: Column, height: Column, places: int = 6) -> G.Box:
    return G.Box(*(F.bround(v / s, places) for v, s in zip(b, (width, height, width, height))))


def region(top: Column, bottom: Column, width: Column, height: Column) -> G.Box:
    """A detected band of a page, in fractions of its height, over its whole width."""
    return G.Box(F.lit(0.0), top * height, width.cast("double"), bottom * height)


def flipped(b: G.Box, height: Column) -> G.Box:
    """A box with its origin at the bottom as one with its origin at the top, and the other way round."""
    return G.Box(b.x0, height - b.bottom, b.x1, height - b.top)


def crop_window(b: G.Box, width: Column, height: Column) -> G.Box:
    """Pixels to cut for a box in fractions: a margin of 0.8 % of the short side, 4 at least, inside the image."""
    margin = F.greatest(F.lit(4), F.bround(F.least(width, height) * 0.008))
    at = lambda v, s: F.bround(v * s)
    return G.Box(
        F.greatest(F.lit(0), at(b.x0, width) - margin), F.greatest(F.lit(0), at(b.top, height) - margin),
        F.least(width, at(b.x1, width) + margin), F.least(height, at(b.bottom, height) + margin),
    )


def row_bounds(weights: DataFrame) -> DataFrame:
    """doc, id, page, low, high: rows of a grid that each of its pages shows, by weight; halves go up.

    ``weights``: doc, id, page, weight, rows (of the whole grid).  The last page ends with the grid."""
    order = Window.partitionBy("doc", "id").orderBy("page")
    run = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("weight").over(Window.partitionBy("doc", "id"))
    last = F.lead("page").over(order).isNull()
    high = F.when(last, F.col("rows")).otherwise(F.floor(run / whole * F.col("rows") + 0.5)).cast("int")
    out = weights.select("doc", "id", "page", high.alias("high"))
    return out.select("doc", "id", "page", F.coalesce(F.lag("high").over(order), F.lit(0)).alias("low"), "high")


def endpoints(items: Column) -> Column:
    """The first, second and last item, each once."""
    return F.array_distinct(F.array_compact(F.array(F.get(items, F.lit(0)), F.get(items, F.lit(1)), F.try_element_at(items, F.lit(-1)))))


def endpoint_overlap(groups: DataFrame) -> DataFrame:
    """doc, page, n: pages at which planned groups meet (in two groups), or break the rule (in more)."""
    each = groups.select("doc", F.explode(F.array_distinct("pages")).alias("page"))
    return each.groupBy("doc", "page").agg(F.count("*").alias("n")).where("n > 1")


def redactions(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc, page, id, x0, top, x1, bottom, rerun: boxes to blank on a page where two planned groups meet.

    ``runs``: doc, turn, pages, of planned groups in order.  What a group of several pages took on its last page
    is blanked before that page is used again: by the next group if it starts there, else by a run of the
    page alone (rerun)."""
    order = Window.partitionBy("doc").orderBy("turn")
    ended = runs.select("doc", F.size("pages").alias("size"), F.try_element_at("pages", F.lit(-1)).alias("page"), F.get(F.lead("pages").over(order), F.lit(0)).alias("next"))
    met = ended.where((F.col("size") > 1) & F.col("next").isNotNull())
    rerun = F.col("next") != F.col("page")
    return met.select("doc", "page", rerun.alias("rerun")).join(boxes, ["doc", "page"]).select("doc", "page", "id", *G.Box._fields, "rerun")


def attachment_scale(width: Column, height: Column, budget: int, side: int = 32) -> Column:
    """The factor by which an image shrinks to about ``budget`` patches; 1 where it fits already."""
    fits = F.ceil(width / side) * F.ceil(height / side) <= budget
    return F.when(fits, 1.0).otherwise(F.sqrt(F.lit(float(budget * side * side)) / (width.cast("double") * height)))


def attachment_size(width: Column, height: Column, budget: int, side: int = 32) -> Column:
    """(width, height) after shrinking until the patches fit the budget."""
    scale = attachment_scale(width, height, budget, side)
    w, h = F.greatest(F.lit(1), F.floor(width * scale)), F.greatest(F.lit(1), F.floor(height * scale))
    # what partly filled patches add goes from the longer side
    fit = lambda a, b: F.greatest(F.lit(1), F.least(a, F.floor(F.lit(budget) / F.ceil(b / side)) * side))
    w2, h2 = F.when(w >= h, fit(w, h)).otherwise(w), F.when(w < h, fit(h, w)).otherwise(h)
    return F.struct(w2.cast("long").alias("width"), h2.cast("long").alias("height"))
