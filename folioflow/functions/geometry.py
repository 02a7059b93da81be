"""Box geometry as column expressions; a box is four columns of one prefix (top-left origin, points)."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = namedtuple("Box", "x0 top x1 bottom")


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + n).cast("double") for n in Box._fields))


def width(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x1 - b.x0)


def height(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.bottom - b.top)


def area(b: Box) -> Column:
    return width(b) * height(b)


def intersection(a: Box, b: Box) -> Column:
    return width(Box(F.greatest(a.x0, b.x0), a.top, F.least(a.x1, b.x1), a.bottom)) * height(Box(a.x0, F.greatest(a.top, b.top), a.x1, F.least(a.bottom, b.bottom)))


def overlap(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 where one has none."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def horizontal_overlap(a: Box, b: Box) -> Column:
    """Common width over the smaller width; 0 where one has none."""
    least = F.least(width(a), width(b))
    common = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    return F.when(least > 0, common / least).otherwise(0.0)


def contains_center(a: Box, b: Box, margin: float = 0.0) -> Column:
    """Whether b's centre is inside a, borders and ``margin`` included."""
    x, y = (b.x0 + b.x1) / 2, (b.top + b.bottom) / 2
    return x.between(a.x0 - margin, a.x1 + margin) & y.between(a.top - margin, a.bottom + margin)


def rotated(b: Box, degrees: Column, page_width: Column, page_height: Column) -> Box:
    """The box on a page turned clockwise by 0, 90, 180 or 270 degrees."""
    turns = {90: Box(page_height - b.bottom, b.x0, page_height - b.top, b.x1), 180: Box(page_width - b.x1, page_height - b.bottom, page_width - b.x0, page_height - b.top), 270: Box(b.top, page_width - b.x1, b.bottom, page_width - b.x0)}
    out = b
    for turn, t in turns.items():
        out = Box(*(F.when(degrees == turn, n).otherwise(o) for n, o in zip(t, out)))
    return out


def inside_page(b: Box, page_width: Column, page_height: Column) -> Column:
    """Whether a box is not empty and lies on its page."""
    return (b.x0 < b.x1) & (b.top < b.bottom) & (b.x0 >= 0) & (b.top >= 0) & (b.x1 <= page_width) & (b.bottom <= page_height)


def header_logo(kind: Column, page: Column, b: Box) -> Column:
    """Whether a picture is a small one at the top of a page after the first, as repeated logos are."""
    return (kind == "picture") & (page > 1) & (b.top < 70) & (height(b) < 60) & (width(b) < 160)


def is_below(upper: Box, lower: Box, tolerance: float = 3.0) -> Column:
    return lower.top >= upper.bottom - tolerance
