"""Text, number and identifier expressions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as text functions of scripting languages see it: Unicode's, and four control characters.
SPACES = r"(?U)[\s\x1c-\x1f]+"
# Words that tell a table without a header row, cells that say nothing.
HEADERLESS = ("abkürz", "abbreviation", "glossar", "glossary")
PLAIN_CELLS = ("ja", "nein", "kw", "km", "mw", "mva", "euro", "mio €")
TABLE_NUMBER = r"(?i)\b(?:tabelle|table)\s*[:.]?\s*(\d+)\b"
NUMBERED_TITLE = r"^\d+(?:\.\d+)+\s+\S"


@lru_cache(maxsize=1)
def _folds() -> dict[str, str]:
    """Lower-case characters whose case folding is another one: those of one character first, then the longer ones."""
    folds = {c: c.casefold() for c in map(chr, range(0x110000)) if c.lower() == c != c.casefold()}
    return dict(sorted(folds.items(), key=lambda x: len(x[1]) > 1))


def casefold(text: Column) -> Column:
    """Full case folding: lower case, then other foldings by a lookup for each character.  A lookup cannot put two
    characters for one, so it drops these, and texts that get shorter go by parts; the usual ß is replaced before."""
    folds = _folds()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    folded = F.translate(low, "".join(folds), "".join(f for f in folds.values() if len(f) == 1))
    table = F.from_json(F.lit("{" + ",".join(f'"{c}":"{f}"' for c, f in folds.items()) + "}"), "map<string,string>")
    parts = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(F.length(folded) == F.length(low), folded).otherwise(parts)


def compact(text: Column) -> Column:
    """White space collapsed, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def bare(text: Column) -> Column:
    """Without any white space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def normalised(text: Column) -> Column:
    """Without emphasis and heading marks, white space collapsed, case folded."""
    return casefold(compact(F.translate(text, "*#", "")))


def preview(text: Column, limit: int = 180) -> Column:
    """White space collapsed; cut to ``limit`` characters, the last one an ellipsis."""
    t = compact(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def slug(text: Column, default: str = "item") -> Column:
    """Letters, digits, dots, dashes and underscores; anything else becomes one dash."""
    cut = F.btrim(F.regexp_replace(text, r"[^\w.-]+", "-"), F.lit("-._"))  # a pattern would try each run of marks; \w is A-Za-z0-9_, by one lookup
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def table_number(text: Column) -> Column:
    """The number in the first 300 characters' first "Table N", as text; null if none."""
    return F.nullif(F.regexp_extract(F.substring(text, 1, 300), TABLE_NUMBER, 1), F.lit(""))


def numbered_title(text: Column) -> Column:
    """Whether a text is a section title with a number of two parts or more, marks aside."""
    return F.rlike(F.trim(F.ltrim(text, F.lit("#* "))), F.lit(NUMBERED_TITLE))


def header_rows(name: Column) -> Column:
    """0 for lists of abbreviations and glossaries, by name; else 1."""
    folded = casefold(F.coalesce(name, F.lit("")))
    return F.when(F.rlike(folded, F.lit("|".join(HEADERLESS))), 0).otherwise(1)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in expression offers."""
    return texts.str.normalize("NFKC")


def composed_key(text: Column) -> Column:
    """A composed cell for comparison: lower case, no tags, only letters, digits and the euro sign."""
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit("<br>"), F.lit(" ")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9äöüß€]+", " "))


def cell_key(text: Column) -> Column:
    return composed_key(nfkc(text))


def useful(key: Column) -> Column:
    """Whether a cell's key tells something."""
    return (F.length(key) >= 2) & ~key.isin(*PLAIN_CELLS)


def alt_text(alt: Column, caption: Column, page: Column) -> Column:
    """What an image is called: its alternative text, else its caption, else its page; no brackets."""
    fallback = F.concat(F.lit("PDF image on page "), page.cast("string"))
    said = F.coalesce(F.nullif(alt, F.lit("")), F.nullif(caption, F.lit("")), fallback)
    return compact(F.translate(said, "[]", ""))


def image_block(id_: Column, page: Column, path: Column, alt: Column, caption: Column, description: Column, chart: Column | None = None) -> Column:
    """An image's Markdown between its markers; the description goes if it and the caption say the same."""
    said, words = F.trim(F.coalesce(description, F.lit(""))), F.trim(F.coalesce(caption, F.lit("")))
    alike = F.contains(normalised(words), normalised(said)) | F.contains(normalised(said), normalised(words))
    shown = F.when((said != "") & ((words == "") | ~alike), said)
    link = F.concat(F.lit("!["), alt_text(alt, caption, page), F.lit("]("), path, F.lit(")"))
    marker = lambda sign: F.format_string(f"<!-- {sign}image:%s page:%s -->", id_.cast("string"), page.cast("string"))
    table = F.nullif(F.trim(chart), F.lit("")) if chart is not None else F.lit(None).cast("string")
    return F.concat_ws("\n\n", marker(""), link, shown, table, marker("/"))


def pages_of(markdown: Column) -> Column:
    """(page, content) of a document's page markers in order of first appearance: comments removed, parts of one
    page joined by a line break; page 1 for a text without markers."""
    parts = F.split(markdown, r"(?=<!--\s*page:\d+\s*-->)")
    marked = F.filter(parts, lambda p: F.rlike(p, F.lit(r"^<!--\s*page:\d+\s*-->")))
    page = lambda p: F.regexp_extract(p, r"^<!--\s*page:(\d+)", 1).cast("int")
    content = lambda p: F.trim(F.regexp_replace(p, r"(?s)<!--.*?-->", ""), F.lit(" \n\r\t"))
    each = F.transform(marked, lambda p: F.struct(page(p).alias("page"), content(p).alias("content")))
    numbers = F.array_distinct(F.transform(each, lambda x: x["page"]))
    joined = lambda n: F.array_join(F.filter(F.transform(F.filter(each, lambda x: x["page"] == n), lambda x: x["content"]), lambda c: c != ""), "\n")
    found = F.transform(numbers, lambda n: F.struct(n.alias("page"), joined(n).alias("content")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(1).alias("page"), markdown.alias("content"))))


def page_label(pages: Column) -> Column:
    first, last = (F.try_element_at(pages, F.lit(i)).cast("string") for i in (1, -1))
    return F.when(F.size(pages) > 1, F.concat(F.lit("P"), first, F.lit("–"), last)).otherwise(F.concat(F.lit("P"), first))


def display_units(text: Column) -> Column:
    """Width of a text in units: characters beyond Latin-1 count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[^\x{0}-\x{ff}]"))


def column_width(cells: Column, most_units: int, low: float, high: float) -> Column:
    """Width of a column in pixels from its longest line, between two bounds."""
    lines = F.flatten(F.transform(cells, lambda c: F.split(F.coalesce(c, F.lit("")), "\n")))
    longest = F.coalesce(F.array_max(F.transform(lines, display_units)), F.lit(0))
    return F.least(F.lit(high), F.greatest(F.lit(low), 22 + F.least(longest, F.lit(most_units)) * 5.7))


def patch_count(width: Column, height: Column, side: int = 32) -> Column:
    return F.ceil(width / float(side)).cast("long") * F.ceil(height / float(side)).cast("long")


def render_dpi(width_pt: Column, height_pt: Column, target: Column | int, budget: int) -> Column:
    """The highest whole resolution up to ``target`` whose page fits the patch budget, 1 at least."""
    steps = F.sequence(F.lit(1), target if isinstance(target, Column) else F.lit(target))
    fits = F.filter(steps, lambda d: patch_count(F.ceil(width_pt * d / 72.0), F.ceil(height_pt * d / 72.0)) <= budget)
    return F.coalesce(F.array_max(fits), F.lit(1))


def text_dpi(font_sizes: Column, pixels: int = 12) -> Column:
    """The resolution, from 72 to 600, at which small text (the 20th percentile of sizes; 8 if none) has so many pixels."""
    size = F.when(F.size(font_sizes) > 0, nearest_rank(font_sizes, 0.2)).otherwise(8.0)
    return F.greatest(F.lit(72), F.least(F.lit(600), F.bround(72.0 * pixels / size).cast("int")))


def nearest_rank(values: Column, q: float) -> Column:
    """Sorted values at zero-based index (n - 1) * q, rounded half to even."""
    return F.element_at(F.sort_array(values), F.bround((F.size(values) - 1) * F.lit(q)).cast("int") + 1)


def item_markdown(kind: Column, text: Column, level: Column) -> Column:
    """A block's Markdown by its kind; section levels stay in 2..6."""
    marks = F.repeat(F.lit("#"), F.greatest(F.lit(2), F.least(F.lit(6), level)).cast("int"))
    return (
        F.when(kind == "title", F.concat(F.lit("# "), text)).when(kind == "section_header", F.concat(marks, F.lit(" "), text))
        .when(kind == "list_item", F.concat(F.lit("- "), text)).when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "formula", F.concat(F.lit("$$"), text, F.lit("$$"))).otherwise(text)
    )


def column_label(index: Column) -> Column:
    """Spreadsheet label of a column from 0: A..Z, AA.. as far as whole numbers go; empty below 0."""
    levels = [index.cast("long")]
    while len(levels) < 14:  # 26 ** 14 is more than any long
        levels.append(F.call_function("div", levels[-1], F.lit(26)) - 1)
    letter = lambda n: F.char(65 + F.pmod(n, F.lit(26)))
    # the level above a number below 0 would be -1 again, so each asks for all below it
    return F.concat(*(F.when(n >= 0, letter(n)).otherwise("") for n in reversed(levels[1:])), F.when(levels[0] < 0, "").otherwise(letter(levels[0])))


def source_ids(sources, sha: str = "sha256"):
    """``sources`` (position, sha256) with source_id: the first 12 digits of the hash, numbered where they repeat."""
    from pyspark.sql import Window

    short = F.substring(sha, 1, 12)
    turn = F.row_number().over(Window.partitionBy(short).orderBy("position"))
    return sources.withColumn("source_id", F.when(turn == 1, short).otherwise(F.concat(short, F.lit("-"), turn.cast("string"))))


def scrubbed(text: Column, roots: dict[str, str]) -> Column:
    """Host paths replaced by what stands for them, the longest root first."""
    for root in sorted(roots, key=len, reverse=True):
        text = F.replace(text, F.lit(root), F.lit(roots[root]))
    return text


def utc_text(at: Column) -> Column:
    """A timestamp as ISO text in UTC, to the microsecond."""
    zone = F.current_timezone()
    return F.date_format(F.convert_timezone(zone, F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, 3 places; never below 0."""
    return F.greatest(F.lit(0.0), F.bround((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 3))
