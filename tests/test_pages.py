"""Claims, lineage, placement and assembly of pages against a sequential version, and small cases."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import lineage, pages, regions

BOX = "x0 double, top double, x1 double, bottom double"


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def overlap(a, b):
    least = min(area(a), area(b))
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1])) / least if least else 0.0


def across(a, b):
    least = min(a[2] - a[0], b[2] - b[0])
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) / least if least else 0.0


def holds(a, b):
    x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return a[0] - 2 <= x <= a[2] + 2 and a[1] - 2 <= y <= a[3] + 2


def best(box, blocks, used):
    found = [(overlap(box, b["box"]), -b["ord"]) for b in blocks if b["kind"] == "table" and b["box"] and b["ord"] not in used and overlap(box, b["box"]) > 0]
    score, ord_ = max(found, default=(0.0, 0))
    return (-ord_ if score >= 0.35 else None), score


def direct(tables, blocks):
    used, out = set(), []
    for t in tables:
        won, _ = best(t["box"], blocks, used)
        mine = [(won, "bbox_overlap")] if won is not None else []
        used |= {w for w, _ in mine}
        mine += [(b["ord"], "bbox_contains_center") for b in blocks if b["kind"] == "table" and b["box"] and b["ord"] not in used and holds(t["box"], b["box"])]
        used |= {w for w, _ in mine}
        out += [(t["id"], o, m) for o, m in mine]
    return out


def merged(tables, blocks, gone):
    used, gone, out = set(), set(gone), []
    for t in tables:
        won, _ = best(t["box"], blocks, used)
        taken = [b for b in blocks if b["box"] and b["kind"] not in pages.PROTECTED and b["ord"] not in used | gone and holds(t["box"], b["box"])]
        above = [b for b in blocks if b["box"] and b["box"][3] <= t["box"][1] + 2 and across(t["box"], b["box"]) >= 0.15]
        if won is not None:
            slot = float(won)
        elif taken:
            slot = float(taken[0]["ord"])
        elif above:
            slot = min(above, key=lambda b: t["box"][1] - b["box"][3])["ord"] + 0.5
        else:
            slot = min((b["ord"] for b in blocks), default=0) - 0.5
        out.append([t["id"], won, [b["ord"] for b in taken], slot])
        used |= {b["ord"] for b in taken if b["kind"] == "table"} | ({won} - {None})
        gone |= {b["ord"] for b in taken} | ({won} - {None})
    for row, slot in zip(out, sorted(r[3] for r in out)):
        row.append(slot)
    return out, gone


def made(seed):
    """(doc, page) -> (tables, blocks); two documents share page numbers, some pages lack either, some blocks a box."""
    rng = random.Random(seed)
    box = lambda w, h: (x := rng.randrange(0, 300), y := rng.randrange(0, 400), x + rng.randrange(5, w), y + rng.randrange(5, h))
    out = {}
    for doc in (1, 2):
        for page in range(1, 30):
            tables = sorted(({"id": doc * 1000 + page * 10 + i, "box": tuple(map(float, box(260, 260)))} for i in range(rng.randrange(0, 5))), key=lambda t: (t["box"][1], t["id"]))
            kinds = ("table", "table", "text", "list_item", "picture", "caption", "section_header")
            blocks = [{"ord": i + 3, "kind": rng.choice(kinds), "box": tuple(map(float, box(150, 90))) if rng.random() < 0.95 else None} for i in range(rng.randrange(0, 12))]
            out[doc, page] = tables, blocks
    return out


@pytest.fixture(scope="module")
def world(spark):
    data = made(7)
    t = [(d, p, k, x["id"], *x["box"]) for (d, p), (ts, _) in data.items() for k, x in enumerate(ts, 1)]
    b = [(d, p, x["ord"], x["kind"], f"{x['kind']} {x['ord']}", *(x["box"] or (None,) * 4)) for (d, p), (_, bs) in data.items() for x in bs]
    tables = spark.createDataFrame(t, f"doc int, page int, k int, id long, {BOX}").cache()
    blocks = spark.createDataFrame(b, f"doc int, page int, ord int, kind string, markdown string, {BOX}").cache()
    return data, tables, blocks


def test_direct_relations_take_turns(world):
    data, tables, blocks = world
    got = {}
    for r in pages.direct_relations(pages.page_frame(tables, blocks)).orderBy("doc", "page", "n").collect():
        got.setdefault((r.doc, r.page), []).append((r.id, r.ord, r.method))
    assert got == {k: v for k, (ts, bs) in data.items() if (v := direct(ts, bs))}


def test_merges_take_turns(spark, world):
    data, tables, blocks = world
    before = {(d, p, o) for (d, p), (_, bs) in data.items() for o in (b["ord"] for b in bs) if (d + p + o) % 9 == 0}
    gone = spark.createDataFrame(sorted(before), "doc int, page int, ord int")
    for r in pages.merges(pages.page_frame(tables, blocks), gone).collect():
        ts, bs = data[r.doc, r.page]
        want, left = merged(ts, bs, {o for d, p, o in before if (d, p) == (r.doc, r.page)})
        assert [[m.id, m.matched, m.absorbed, m.source_slot, m.slot] for m in r.merges] == want and set(r.gone) == left


def test_continuations_and_lineage(world):
    data, tables, blocks = world
    tables = tables.withColumn("pages", F.sequence("page", F.col("page") + F.col("id").cast("int") % 3))
    direct_ = pages.direct_relations(pages.page_frame(tables, blocks))
    cont = lineage.continuations(tables, blocks, direct_)
    taken = {(d, p, o) for (d, p), (ts, bs) in data.items() for _, o, _ in direct(ts, bs)}
    want = {}
    for (d, p), (_, bs) in data.items():
        for b in bs:
            if b["kind"] != "table" or not b["box"] or (d, p, b["ord"]) in taken:
                continue
            found = sorted(((across(t["box"], b["box"]), t["id"]) for (d2, p2), (ts, _) in data.items() for t in ts if d2 == d and p2 < p <= p2 + t["id"] % 3), reverse=True)
            if found:
                sure = found[0][0] >= 0.35 and (len(found) == 1 or found[0][0] - found[1][0] > 0.05)
                want[d, p, b["ord"]] = (found[0][1], []) if sure else (None, [i for _, i in found])
    assert {(r.doc, r.page, r.ord): (r.id, r.candidates) for r in cont.collect()} == want
    edges, ids = lineage.edges(direct_, cont), lineage.layout_ids(blocks)
    both = {(r.doc, r.id, x) for r in lineage.by_table(tables, edges, ids).collect() for x in r.layout_ids}
    back = {(r.doc, t, r.layout_id) for r in lineage.by_layout_table(ids, edges, cont).collect() for t in r.replacements}
    assert both == back and len(both) == len(taken) + sum(1 for i, _ in want.values() if i)
    assert {r.action for r in lineage.by_table(tables, edges, ids).collect()} == {"inserted_without_layout_table", "merged_from_layout_tables", "replaced_layout_table"}


def test_page_specific_boxes_and_ambiguity(spark):
    tables = spark.createDataFrame(
        [(1, 1, 10, [1, 2], 0.0, 0.0, 100.0, 50.0, {2: (300.0, 0.0, 400.0, 50.0)}), (1, 1, 11, [1, 2], 0.0, 60.0, 100.0, 90.0, None)],
        f"doc int, page int, id long, pages array<int>, {BOX}, page_boxes map<int,struct<{BOX.replace(' double', ':double')}>>",
    )
    blocks = spark.createDataFrame([(1, 2, 1, "table", 300.0, 0.0, 400.0, 20.0), (1, 2, 2, "table", 0.0, 0.0, 100.0, 20.0), (1, 2, 3, "table", 150.0, 0.0, 250.0, 9.0)], f"doc int, page int, ord int, kind string, {BOX}")
    none = spark.createDataFrame([], "doc int, page int, ord int")
    got = {r.ord: (r.status, r.id, r.candidates) for r in lineage.continuations(tables, blocks, none).collect()}
    assert got == {1: ("continuation_horizontal_overlap", 10, []), 2: ("continuation_horizontal_overlap", 11, []), 3: ("ambiguous_continuation", None, [11, 10])}


def test_page_without_blocks_starts_before_zero(spark):
    tables = spark.createDataFrame([(1, 1, 1, 5, 0.0, 0.0, 9.0, 9.0)], f"doc int, page int, k int, id long, {BOX}")
    blocks = spark.createDataFrame([], f"doc int, page int, ord int, kind string, {BOX}")
    (m,) = pages.merges(pages.page_frame(tables, blocks)).first().merges
    assert (m.slot, m.action, m.matched) == (-0.5, "inserted_missing_table", None)


def test_images_absorb_text_once_and_hidden_ones_nothing(spark):
    none = spark.createDataFrame([], f"doc int, page int, k int, id long, {BOX}")
    rows = [(1, 1, 1, "picture", "P", 0.0, 0.0, 50.0, 50.0), (1, 1, 2, "text", "inside", 10.0, 10.0, 20.0, 20.0), (1, 1, 3, "section_header", "H", 10.0, 10.0, 20.0, 20.0), (1, 1, 4, "text", "out", 90.0, 90.0, 99.0, 99.0)]
    blocks = spark.createDataFrame(rows, f"doc int, page int, ord int, kind string, markdown string, {BOX}")
    shape = f"doc int, page int, pos int, id string, block int, caption int, included boolean, slot double, text string, {BOX}"
    seen = [(1, 1, 1, "image-0001", 1, None, True, None, "![a](x)", 0.0, 0.0, 50.0, 50.0), (1, 1, 2, "image-0002", None, None, True, 3.5, "![b](y)", 0.0, 0.0, 50.0, 50.0), (1, 1, 3, "image-0003", None, None, False, 0.0, "no", 80.0, 80.0, 99.0, 99.0)]
    frame = pages.page_frame(none, blocks, spark.createDataFrame(seen, shape), "markdown")
    out = pages.with_images(pages.merges(frame))
    (row,) = out.collect()
    assert [(m.image, m.absorbed) for m in row.image_merges] == [("image-0001", [2])] and row.gone == [2]
    texts = spark.createDataFrame([], "doc int, page int, id long, markdown string, last_page int")
    page = pages.page_markdown(out, texts)
    assert page.first().markdown == "<!-- page:1 -->\n\n![a](x)\n\nH\n\n![b](y)\n\nout"
    assert pages.documents(page).first().markdown.endswith("out\n")


def test_image_matching_by_name_and_merging(spark):
    seen = spark.createDataFrame([(1, 1, 1, ["a"], 0.0, 0.0, 1.0, 1.0), (1, 1, 2, ["b", "c"], 0.0, 0.0, 1.0, 1.0), (1, 1, 3, [], 200.0, 0.0, 210.0, 10.0), (1, 1, 4, None, 500.0, 0.0, 510.0, 10.0)], f"doc int, page int, image int, ids array<string>, {BOX}")
    pics = spark.createDataFrame([(1, 1, i, n, 100.0 * i, 0.0, 100.0 * i + 10, 10.0) for i, n in enumerate("abd")] + [(1, 1, 9, "c", 900.0, 0.0, 910.0, 10.0)], f"doc int, page int, ord int, picture string, {BOX}")
    got = [(r.image, r.action, r.picture) for r in pages.match_images(seen, pics).collect()]
    assert got == [(1, "matched", "a"), (2, "merged", "b"), (2, "merged", "c"), (2, "new", None), (3, "matched", "d"), (4, "new", None)]
    ids = spark.createDataFrame([(1, "image-0007"), (1, "other"), (2, "x")], "doc int, id string")
    assert {r.doc: r.next for r in pages.next_image_index(ids).collect()} == {1: 8, 2: 1}


def test_image_blocks(spark):
    shape = "alt string, caption string, description string, chart string"
    rows = [("A [x]  b", "Fig. 1", "Something else", "| a |"), (None, "Fig. 1", "*fig.* 1", " "), ("", None, None, None)]
    df = spark.createDataFrame(rows, shape)
    got = [r[0] for r in df.select(text.image_block(F.lit("image-0001"), F.lit(2), F.lit("p.png"), F.col("alt"), F.col("caption"), F.col("description"), F.col("chart"))).collect()]
    o, c = "<!-- image:image-0001 page:2 -->", "<!-- /image:image-0001 page:2 -->"
    assert got == [f"{o}\n\n![A x b](p.png)\n\nSomething else\n\n| a |\n\n{c}", f"{o}\n\n![Fig. 1](p.png)\n\n{c}", f"{o}\n\n![PDF image on page 2](p.png)\n\n{c}"]


def test_regions(spark):
    roles = "map<string,array<double>>"
    df = spark.createDataFrame([(1, [3, 4, 5], {"first": [1.0], "middle": [2.0], "last": [3.0]}), (2, [3, 5], {"first": [1.0], "last": [2.0]}), (3, [7], {"first": [1.0], "last": [2.0]})], f"id int, pages array<int>, roles {roles}")
    got = {r.id: (r.problem, r.boxes) for r in regions.expanded_boxes(df).collect()}
    assert got == {1: (None, {3: [1.0], 4: [2.0], 5: [3.0]}), 2: ("pages_not_consecutive", None), 3: ("wrong_roles", None)}
    writes = spark.createDataFrame([(1, "t", 1, 5, "a"), (1, "t", 2, 4, "b"), (1, "t", 3, 5, "c")], "doc int, id string, seq int, page int, box string")
    assert tuple(regions.accumulated(writes).first()) == (1, "t", 4, [4, 5], "b", {4: "b", 5: "c"})
    row = spark.range(1).select(regions.endpoints(F.lit([1, 2, 3, 4])), regions.endpoints(F.lit([9])), regions.attachment_size(F.lit(4000), F.lit(3000), 10_000)).first()
    assert row[0] == [1, 2, 4] and row[1] == [9] and -(-row[2].width // 32) * -(-row[2].height // 32) <= 10_000
    crop = spark.range(1).select(*regions.crop_window(regions.G.Box(*(F.lit(v) for v in (0.0, 0.5, 1.0, 1.0))), F.lit(1000), F.lit(500))).first()
    assert tuple(crop) == (0, 246, 1000, 500)
    runs = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [2, 3]), (1, 3, [4])], "doc int, turn int, pages array<int>")
    boxes = spark.createDataFrame([(1, 2, "t", 0.0, 0.0, 1.0, 1.0), (1, 3, "u", 0.0, 0.0, 1.0, 1.0)], f"doc int, page int, id string, {BOX}")
    assert {(r.page, r.id, r.rerun) for r in regions.redactions(runs, boxes).collect()} == {(2, "t", False), (3, "u", True)}
    assert {(r.page, r.n) for r in regions.endpoint_overlap(runs).collect()} == {(2, 2)}
