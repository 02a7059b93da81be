"""Grids of strings: arrays of rows, each an array of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, composed_key, nfkc, useful


def padded(rows: Column) -> Column:
    """Rows filled up with empty cells to the longest one."""
    w = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r))))


def csv_text(rows: Column, end: str = "\n") -> Column:
    """CSV lines; cells are quoted only where they must be."""
    cell = lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.concat_ws("", F.transform(rows, lambda r: F.concat(F.array_join(F.transform(r, cell), ","), F.lit(end))))


def markdown(rows: Column, header_rows: Column | None = None, title: Column | None = None) -> Column:
    """A pipe table; with no header row a blank one is put in front."""
    cell = lambda v: F.replace(F.regexp_replace(v, "\r\n|\r|\n", "<br>"), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    grid = padded(rows)
    blank = F.transform(F.element_at(grid, 1), lambda v: F.lit(""))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(blank, lambda v: F.lit("---")), " | "), F.lit(" |"))
    headed = (header_rows if header_rows is not None else F.lit(1)) > 0
    head = F.when(headed, line(F.element_at(grid, 1))).otherwise(line(blank))
    body = F.transform(F.when(headed, F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))).otherwise(grid), line)
    text = F.array_join(F.concat(F.array(head, rule), body), "\n")
    if title is not None:
        text = F.when(F.length(title) > 0, F.concat(F.lit("**"), title, F.lit("**\n\n"), text)).otherwise(text)
    return F.when(F.size(rows) > 0, F.rtrim(text)).otherwise("")


def split_row(line: Column) -> Column:
    """Cells of a pipe-table row: unescaped pipes cut, escapes and line breaks restored."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda v: F.replace(F.replace(F.trim(v), F.lit("\\|"), F.lit("|")), F.lit("<br>"), F.lit("\n")))


def stitched(fragments: Column) -> Column:
    """Fragments one below the other; a first row equal to the first header is dropped."""
    key = lambda r: F.transform(r, lambda v: casefold(F.trim(v)))
    def add(rows: Column, f: Column) -> Column:
        same = (F.size(rows) > 0) & (F.size(f) > 0) & (key(F.element_at(rows, 1)) == key(F.element_at(f, 1)))
        return F.concat(rows, F.when(same, F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0)))).otherwise(f))
    return padded(F.aggregate(fragments, F.array().cast("array<array<string>>"), add))


def first_table(markdown: Column) -> Column:
    """Rows of the first pipe table of a text: a header, a rule of as many cells, then all lines with a pipe; rows
    are filled up or cut to the header's width.  No rows if there is none."""
    lines = F.split(F.coalesce(markdown, F.lit("")), r"\r\n|\r|\n")
    cells = F.transform(lines, lambda x: F.when(F.contains(x, F.lit("|")), split_row(x)))
    rule = lambda r: F.forall(r, lambda v: F.rlike(F.replace(v, F.lit(" "), F.lit("")), F.lit("^:?-{3,}:?$")))
    heads = lambda r, i: r.isNotNull() & F.get(cells, i + 1).isNotNull() & (F.size(r) == F.size(F.get(cells, i + 1))) & rule(F.get(cells, i + 1))
    at = F.array_min(F.filter(F.transform(cells, lambda r, i: F.when(heads(r, i), i)), lambda i: i.isNotNull()))
    rest = F.slice(cells, at + 3, F.greatest(F.size(cells) - at - 2, F.lit(0)))
    end = F.coalesce(F.array_min(F.filter(F.transform(rest, lambda r, i: F.when(r.isNull(), i)), lambda i: i.isNotNull())), F.size(rest))
    head = F.get(cells, at)
    wide = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(head) - F.size(r), F.lit(0)))), 1, F.size(head))
    rows = F.concat(F.array(head), F.transform(F.slice(rest, 1, end), wide))
    return F.when(at.isNotNull(), rows).otherwise(F.array().cast("array<array<string>>"))


def shape(rows: Column) -> Column:
    """(rows, columns) of a grid."""
    return F.struct(F.size(rows).alias("rows"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).alias("columns"))


def same_shape(rows: Column, others: Column) -> Column:
    """The only one of several grids that has the shape of ``rows``; null if none or more do."""
    alike = F.filter(others, lambda o: shape(o) == shape(rows))
    return F.when(F.size(alike) == 1, F.get(alike, F.lit(0)))


def cell_set(rows: Column) -> Column:
    """Distinct keys of a grid's useful cells, in order.  Composition runs once over all cells of a grid."""
    cells = F.split(nfkc(F.array_join(F.flatten(rows), "\x1f")), "\x1f")
    return F.array_sort(F.array_distinct(F.filter(F.transform(cells, composed_key), useful)))


def with_cell(rows: Column, r: Column, c: Column, value: Column) -> Column:
    """The grid with one cell set; places outside of it change nothing."""
    return F.transform(rows, lambda row, i: F.when(i == r, F.transform(row, lambda v, j: F.when(j == c, value).otherwise(v))).otherwise(row))


def with_row(rows: Column, r: Column) -> Column:
    """The grid with an empty row at place ``r``."""
    blank = F.array_repeat(F.lit(""), shape(rows)["columns"])
    return F.concat(F.slice(rows, F.lit(1), r), F.array(blank), F.slice(rows, r + 1, F.greatest(F.size(rows) - r, F.lit(0))))


def without_row(rows: Column, r: Column) -> Column:
    """The grid without a row; one row always stays."""
    return F.when(F.size(rows) > 1, F.filter(rows, lambda x, i: i != r)).otherwise(rows)


def with_column(rows: Column, c: Column) -> Column:
    return F.transform(padded(rows), lambda row: F.concat(F.slice(row, F.lit(1), c), F.array(F.lit("")), F.slice(row, c + 1, F.greatest(F.size(row) - c, F.lit(0)))))


def without_column(rows: Column, c: Column) -> Column:
    """The grid without a column; one column always stays."""
    return F.when(shape(rows)["columns"] > 1, F.transform(padded(rows), lambda row: F.filter(row, lambda v, i: i != c))).otherwise(rows)


def changed_cells(rows: Column, others: Column) -> Column:
    """(r, c) of cells that differ, row by row; a missing cell counts as empty."""
    high = F.greatest(F.size(rows), F.size(others))
    wide = F.greatest(shape(rows)["columns"], shape(others)["columns"])
    cell = lambda g, r, c: F.coalesce(F.get(F.get(g, r), c), F.lit(""))
    places = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    every = F.flatten(F.transform(places(high), lambda r: F.transform(places(wide), lambda c: F.struct(r.alias("r"), c.alias("c")))))
    return F.filter(every, lambda p: cell(rows, p["r"], p["c"]) != cell(others, p["r"], p["c"]))


def csv_quoted(rows: Column) -> Column:
    """CSV as spreadsheets read it: a byte-order mark and line ends of two characters."""
    return F.concat(F.lit("\ufeff"), csv_text(rows, "\r\n"))
