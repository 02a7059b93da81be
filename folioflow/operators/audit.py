"""Audits of grids: repeated cells, fragments between matched pages, cells against a page's characters."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bare
from .pages import let


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def component_turns(grids: pa.Array) -> pa.Array:
    """For each cell (r, c, value) of each grid the turn, in scan order from 0, of its component of equal neighbours
    (left, right, up, down); null for components of one cell.  Grids of a batch are worked out at once: neighbours by
    sorting, components by passing on smallest places and halving paths, so the work is that of sorting the cells."""
    cells = grids.flatten()
    n = len(cells)
    sizes = pc.fill_null(pc.list_value_length(grids), 0).to_numpy(zero_copy_only=False)
    grid = np.repeat(np.arange(len(grids)), sizes)
    r, c = (cells.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    value = cells.field(2).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    scan = np.lexsort((c, r, grid))  # places in scan order
    grid, r, c, value = grid[scan], r[scan], c[scan], value[scan]

    def linked(order: np.ndarray, line: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = order[:-1], order[1:]
        like = (grid[a] == grid[b]) & (value[a] == value[b]) & (line[a] == line[b]) & (along[b] - along[a] <= 1)
        return a[like], b[like]

    across, down = linked(np.lexsort((c, r, value, grid)), r, c), linked(np.lexsort((r, c, value, grid)), c, r)
    a, b = (np.concatenate(x) for x in zip(across, down))
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    many = np.bincount(root, minlength=n) > 1
    first = (root == np.arange(n)) & many  # the first cell of each component, in scan order
    count = np.cumsum(first)
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]  # where each grid begins
    turn = count[root] - 1 - np.concatenate(([0], count))[before[grid]] if n else root
    out, known = np.empty(n, np.int32), np.empty(n, bool)
    out[scan], known[scan] = turn, many[root]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(out, pa.int32(), mask=~known))


def repeated_cells(cells: DataFrame, tones: int = 4) -> DataFrame:
    """doc, tab, r, c, tone: cells in components of equal, non-blank, trimmed neighbours (left, right, up, down).

    Components of one cell give no row; tones count components in scan order.  One grid is one row."""
    shown = cells.select("doc", "tab", "r", "c", F.trim("value").alias("value")).where("value <> '' and r is not null and c is not null")
    grids = shown.groupBy("doc", "tab").agg(F.collect_list(F.struct("r", "c", "value")).alias("x"))
    turns = grids.select("doc", "tab", "x", component_turns("x").alias("turns"))
    each = turns.select("doc", "tab", F.explode_outer(F.arrays_zip(F.col("x.r").alias("r"), F.col("x.c").alias("c"), F.col("turns").alias("turn"))).alias("cell"))
    return each.where("cell.turn is not null").select("doc", "tab", "cell.r", "cell.c", F.pmod("cell.turn", F.lit(tones)).cast("int").alias("tone"))


def chain_closure(selected: DataFrame, fragments: DataFrame, least: float = 0.75) -> DataFrame:
    """doc, id, page, target: unmatched fragments that continue a selected one up to its target's page.

    ``selected``: doc, id, target, target_page; ``fragments``: doc, id, page, x0, x1 (null: no box).  From
    each selected fragment on, in order of page, the next one that is at most a page further and overlaps
    the last of the chain by ``least`` of the smaller width joins.  A fragment goes to the first chain that
    takes it.  Chains depend on what others took, so a document is one row, folded over its selected
    fragments and, inside, over the document's fragments in order."""
    boxed = fragments.where("x0 is not null and x1 is not null")
    item = F.struct(*(F.col(c).cast(k).alias(c) for c, k in (("page", "long"), ("id", "long"), ("x0", "double"), ("x1", "double"))))
    parts = boxed.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("parts"))
    pick = F.struct(*(F.col(c).cast("long").alias(c) for c in ("id", "target", "target_page")))
    docs = selected.groupBy("doc").agg(F.sort_array(F.collect_list(pick)).alias("picks")).join(parts, "doc")
    found = "array<struct<id:bigint,page:bigint,target:bigint>>"

    def follows(last: Column, x: Column) -> Column:
        width = F.least(last["x1"] - last["x0"], x["x1"] - x["x0"])
        shared = F.least(last["x1"], x["x1"]) - F.greatest(last["x0"], x["x0"])
        return (x["page"] <= last["page"] + 1) & F.when(width > 0, shared / width >= least).otherwise(False)

    def chain(acc: Column, p: Column) -> Column:
        begin = F.get(F.filter("parts", lambda x: x["id"] == p["id"]), F.lit(0))
        between = lambda x: x["page"].between(F.least(begin["page"], p["target_page"]), F.greatest(begin["page"], p["target_page"]))
        free = F.filter("parts", lambda x: between(x) & ~F.array_contains(acc["taken"], x["id"]))

        def join(a: Column, x: Column) -> Column:
            row = F.struct(x["id"].alias("id"), x["page"].alias("page"), p["target"].alias("target"))
            return F.when(follows(a["last"], x), F.struct(x.alias("last"), F.array_append(a["out"], row).alias("out"))).otherwise(a)

        walked = F.aggregate(free, F.struct(begin.alias("last"), F.array().cast(found).alias("out")), join)["out"]
        return let(F.coalesce(walked, F.array().cast(found)), lambda w: F.struct(F.concat(acc["taken"], F.transform(w, lambda r: r["id"])).alias("taken"), F.concat(acc["out"], w).alias("out")))

    start = F.struct(F.transform("picks", lambda p: p["id"]).alias("taken"), F.array().cast(found).alias("out"))
    return docs.select(F.col("doc").cast("long"), F.inline(F.aggregate("picks", start, chain)["out"]))


def lines_of(chars: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``chars`` (cell, top, x0, text) with line: the top that a character's line began with.

    In order of top a character stays in the current line while it is within ``tolerance`` of the line's first
    top; as tops only rise, no earlier line can be nearer.  A cell's characters are one row, folded once."""
    listed = chars.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("top", "x0", "text"))).alias("x"))
    kind = "array<struct<line:double,x0:double,text:string>>"

    def step(acc: Column, ch: Column) -> Column:
        line = F.when(ch["top"] - acc["line"] <= tolerance, acc["line"]).otherwise(ch["top"])
        return let(line, lambda at: F.struct(at.alias("line"), F.array_append(acc["out"], F.struct(at.alias("line"), ch["x0"].alias("x0"), ch["text"].alias("text"))).alias("out")))

    start = F.struct(F.lit(float("-inf")).alias("line"), F.array().cast(kind).alias("out"))
    return listed.select("cell", F.inline(F.aggregate("x", start, step)["out"]))


def spatial_text(chars: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """cell, spatial: what the characters of a cell say, line by line from left to right; blank lines are left out."""
    line = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), ""))
    lines = lines_of(chars, tolerance).groupBy("cell", "line").agg(line.alias("said"))
    return lines.where("said <> ''").groupBy("cell").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n").alias("spatial"))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matched share of two texts by longest common blocks, which no built-in expression gives."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")




def difference(a: Column, b: Column) -> Column:
    """How a grid's text differs from a page's: "missing", "unsupported", "from_neighbour", "cut" or "different"."""
    holds = F.struct((F.contains(a, b) & (a != b)).alias("more"), (F.contains(b, a) & (a != b)).alias("less"))
    one_empty = F.when(a == "", "missing").when(b == "", "unsupported")
    return F.coalesce(one_empty, F.when(holds["more"], "from_neighbour").when(holds["less"], "cut"), F.lit("different"))


def cell_guard(cells: DataFrame, chars: DataFrame, tolerance: float = 1.0, short: int = 10) -> DataFrame:
    """page, r, c, value, spatial, similarity, reason: checked cells that differ from the characters in their box.

    ``cells``: page, r, c, value and a box (null: skipped); ``chars``: page, text, upright and a box.  A
    character is in the cell that holds its centre, edges left and above included.  Cells with turned
    characters are skipped.  White space tells nothing apart; from 80 % likeness on (90 % from ``short``
    characters on) texts count as equal.  The join has the page as equi-key and sees one page's cells at a time."""
    mid = chars.select("page", "text", "upright", "x0", "top", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("top") + F.col("bottom")) / 2).alias("cy"))
    checked = cells.where("x0 is not null").withColumn("cell", F.struct("page", "r", "c"))
    k, ch = checked.alias("k"), mid.alias("ch")
    inside = (F.col("k.page") == F.col("ch.page")) & (F.col("cx") >= F.col("k.x0")) & (F.col("cx") < F.col("k.x1")) & (F.col("cy") >= F.col("k.top")) & (F.col("cy") < F.col("k.bottom"))
    held = k.join(ch, inside).select("k.cell", F.col("ch.top").cast("double").alias("top"), F.col("ch.x0").cast("double").alias("x0"), "ch.text", "ch.upright")
    turned = held.where("not coalesce(upright, true)").select("cell").distinct()
    said = checked.join(turned, "cell", "left_anti").join(spatial_text(held, tolerance), "cell", "left")
    said = said.select("cell", "value", F.coalesce("spatial", F.lit("")).alias("spatial"))
    a, b = bare(F.col("value")), bare(F.col("spatial"))
    said = said.withColumn("a", a).withColumn("b", b).where("a <> b").withColumn("similarity", likeness("a", "b"))
    enough = F.when(F.least(F.length("a"), F.length("b")) < short, 0.8).otherwise(0.9)
    suspect = said.where(F.col("similarity") < enough)
    return suspect.select("cell.page", "cell.r", "cell.c", "value", "spatial", "similarity", difference(F.col("a"), F.col("b")).alias("reason"))
