"""Larger inputs: labels of any length, and plans that deal their rows once and work a page out once."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import audit, lineage, pages, review
from folioflow.plans import catalogue
from folioflow.plans import pages as page_plans

SF = "/root/testdata/sf0.001"


def test_labels_of_any_length(spark):
    def label(n):
        out = ""
        while n >= 0:
            n, out = n // 26 - 1, chr(65 + n % 26) + out
        return out

    first = [sum(26**i for i in range(1, k)) for k in range(1, 14)]  # the first label of each length
    numbers = sorted({n for f in first for n in (f - 1, f, f + 27)} | {-1, 475_253, 475_254, 1_199_999, 2**53 + 1, 2**63 - 1})
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", text.column_label(F.col("n"))).collect()
    assert {n: x for n, x in rows} == {n: label(n) for n in numbers}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("content_overlap", 2), ("application_state", 5), ("grid_markdown", 1), ("repeated_cells", 1), ("cell_diff", 2), ("csv_profile", 1)])
def test_cells_are_dealt_once(spark, name, most):
    assert exchanges(catalogue.QUERIES[name](spark, SF)) <= most


def test_states_of_grids_known_or_not(spark):
    """Every mix of a grid's versions, against the rule read cell by cell."""
    texts = [None, "", "a", "b"]
    rows = {"ai": [], "now": [], "draft": []}
    want = {}
    for doc, (a, n, d) in enumerate((a, n, d) for a in texts for n in texts for d in texts):
        for name, value in zip(rows, (a, n, d)):
            if value is not None:
                rows[name].append((doc, 1, 0, 0, value))
        now = n if n is not None else a
        wanted = d if d is not None and a is not None else now if d is None else None
        if a is not None:
            want[doc] = "pending_apply" if (wanted or "") != (now or "") else "applied" if (now or "") != a else "no_apply_needed"
        # a second grid of the document that was extracted in every second case only, and has a draft
        if doc % 2:
            rows["now"].append((doc, 2, 0, 0, "x"))
            rows["draft"].append((doc, 2, 0, 0, "x"))
            if a is not None:
                want[doc] = "pending_apply"  # the draft of an unknown grid is no version, its cells go
    frames = [spark.createDataFrame(r, "doc int, tab int, r int, c int, value string") for r in rows.values()]
    assert {r.doc: r.state for r in review.application_state(*frames).collect()} == want


@pytest.mark.parametrize("name", ["slot_normalize", "insertion_slot", "layout_status", "lineage_actions", "continuation_lineage"])
def test_a_page_is_folded_once(spark, name):
    """No filter below a generator asks for the fold's size, and no list is sorted again for each table."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\baggregate\(", plan)) == 1


def test_boxes_turned_inside_out_still_have_a_centre(spark):
    box = "x0 double, top double, x1 double, bottom double"
    tables = spark.createDataFrame([(1, 1, 1, 5, 6.0, 0.0, 9.0, 50.0)], f"doc int, page int, k int, id long, {box}")
    blocks = spark.createDataFrame([(1, 1, 1, "table", 20.0, 10.0, -5.0, 12.0), (1, 1, 2, "table", None, None, None, None), (1, 1, 3, "table", 12.0, 10.0, 14.0, 20.0)], f"doc int, page int, ord int, kind string, {box}")
    got = pages.direct_relations(pages.page_frame(tables, blocks)).collect()
    assert [(r.ord, r.method) for r in got] == [(1, "bbox_contains_center")]


@pytest.mark.parametrize("name, most", [("page_assembly", 3), ("document_assembly", 4), ("image_absorption", 3), ("numbered_headings", 2)])
def test_assembly_reads_and_deals_blocks_once(spark, name, most):
    df = catalogue.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1 and exchanges(df) <= most


def test_one_row_tells_what_joins_tell(spark):
    """Images, hidden blocks and headings of a page's row against those by joins, boxes that are null included."""
    tables, blocks = (df.where("doc < 3") for df in page_plans.both(spark, SF))
    bare = (F.col("doc") * 7 + F.col("page") + F.col("ord")) % 11 == 0
    blocks = blocks.where("page % 13 <> 5").select("doc", "page", "ord", "kind", *(F.when(~bare, F.col(c)).alias(c) for c in pages.BOX), F.when(F.col("ord") % 17 != 0, F.col("markdown")).alias("markdown"))
    tables, blocks = tables.where("page % 13 <> 6").cache(), blocks.cache()
    normal, numbered = page_plans.text.normalised, page_plans.text.numbered_title
    frame = pages.page_frame(tables, blocks.withColumn("said", normal(F.col("markdown"))), None, "markdown", "said", reach=lineage.reached(tables))
    frame = lineage.titled(pages.held_captions(frame), numbered)
    frame = frame.withColumn("images", pages.let(F.struct("blocks", "tables"), lambda x: page_plans.seen(x["blocks"], x["tables"])))
    row = lineage.hidden(frame).cache()

    own = blocks.where("kind = 'picture'").join(pages.captions(blocks), ["doc", "page", "ord"])
    want = {(r.doc, r.page, f"i{r.ord}", r.caption) for r in own.collect()}
    lone = tables.where("id % 5 = 0").withColumn("id", F.concat(F.lit("s"), "id")).withColumn("top", F.col("top") + 10)
    slots = {tuple(r) for r in pages.image_slots(lone, blocks).collect()}
    images = pages.rows_of(row, "images").cache()
    assert {(r.doc, r.page, r.id, r.caption) for r in images.where("block is not null").collect()} == want and want
    assert {(r.doc, r.page, r.id, r.slot) for r in images.where("block is null").collect()} == slots and slots

    found = lineage.outcomes(tables, blocks, pages.direct_relations(pages.page_frame(tables, blocks, how="left")))
    contained = pages.contained_captions(blocks, normal)
    gone = {tuple(r) for r in pages.hidden_before_tables(blocks, images, lineage.continued(found).where("id is not null"), normal).collect()}
    assert {(r.doc, r.page, o) for r in row.collect() for o in r.before} == gone and gone
    titles = {tuple(r) for r in lineage.numbered_headings(contained, blocks, found, numbered).collect()}
    assert {tuple(r) for r in pages.rows_of(row, "headings").collect()} == titles and titles


def components(cells):
    """{(r, c): turn} of one grid, by a search from each cell."""
    out, turn = {}, 0
    for start in sorted(cells):
        todo, found = [start], {start}
        while start not in out and todo:
            r, c = todo.pop()
            now = {p for p in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)) if cells.get(p) == cells[start]} - found
            found |= now
            todo += now
        if len(found) > 1:
            out |= dict.fromkeys(found, turn)
            turn += 1
    return out


def test_components_of_grids_of_any_size(spark):
    """A winding component, gaps, negative places, and a grid of 40,000 cells, which pairs of cells would not finish."""
    rng = random.Random(5)
    winding = {(r, c): "#" for r in range(31) for c in range(31) if r % 2 == 0 or c == (30 if r % 4 == 1 else 0)}
    grids = [winding, {(0, 0): "a"}, {(r, c): rng.choice("abé") for r in range(-9, 9) for c in range(-9, 9) if rng.random() < 0.8}, {(r, c): rng.choice("ab") for r in range(200) for c in range(200)}]
    rows = [(1, t, r, c, f" {v} ") for t, g in enumerate(grids) for (r, c), v in g.items()] + [(1, 1, 5, None, "a"), (1, 1, 7, 7, " ")]
    rng.shuffle(rows)
    cells = spark.createDataFrame(rows, "doc int, tab int, r int, c int, value string")
    began = time.time()
    got = {(x.tab, x.r, x.c): x.tone for x in audit.repeated_cells(cells, tones=7).collect()}
    assert got == {(t, r, c): turn % 7 for t, g in enumerate(grids) for (r, c), turn in components(g).items()} and time.time() - began < 60


def test_foldings_of_all_characters_and_final_sigma(spark):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (chr(i).casefold() != chr(i) or chr(i).lower() != chr(i))]
    texts = chars + [f"A{c}b ß" for c in chars[::7]] + ["ΟΔΟΣ ΣΑΣ", "Straße ẞ", "ﬁn ŉ İ", "", None]
    old = {c for c in chars if c.lower() != c.casefold()}  # other characters are left to the engine's table of lower case
    rows = spark.createDataFrame([(x,) for x in texts if x is None or len(x) != 1 or x in old], "x string").select("x", text.casefold(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in rows if r.y != (r.x if r.x is None else r.x.casefold()) and not set(r.x or "") & (set(chars) - old - set(chars[:2000]))] == []


def test_slugs_of_long_runs_of_marks(spark):
    run = "-._" * 100_000
    began = time.time()
    got = spark.createDataFrame([(f"a{run}b",), (f" {run}x{run} ",), ("...",), ("\n",)], "x string").select(text.slug(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"a{run}b", "x", "item", "item"] and time.time() - began < 20
