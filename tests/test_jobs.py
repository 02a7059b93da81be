"""Jobs for agents and what their replies make of images and plans."""

import json

from folioflow.operators import jobs

BOX = "x0 double, top double, x1 double, bottom double"


def test_page_and_detection_jobs(spark):
    wanted = spark.createDataFrame([(1, 3), (1, 4)], "doc int, page int")
    sizes = spark.createDataFrame([(1, 3, 595.0, 842.0), (1, 4, 5950.0, 8420.0)], "doc int, page int, width double, height double")
    fonts = spark.createDataFrame([(1, 3, s) for s in [6.0] * 3 + [10.0] * 10 + [0.0]], "doc int, page int, size double")
    got = {r.page: r for r in jobs.page_jobs(wanted, sizes, fonts, budget=10_000).collect()}
    assert (got[3].dpi, got[3].reduced, got[3].job) == (144, False, "page-0003") and got[4].reduced and got[4].patches <= 10_000 and "page 3" in got[3].prompt
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 5)], "doc int, page int")
    d = {r.batch: (r.pages, r.prompt) for r in jobs.detection_jobs(pages, 2).collect()}
    assert d[0][0] == [1, 2] and "compare" not in d[0][1] and d[1][0] == [3, 5] and "page 2, is only there" in d[1][1]


def test_plans_and_image_jobs(spark):
    chains = spark.createDataFrame([(1, 1, [1, 2, 3], None), (1, 7, [7, 8, 9], None), (2, 1, [1, 2], None)], "doc long, lead int, pages array<int>, images array<binary>")
    agent = lambda prompt, images: (json.dumps({"groups": [[1, 2], [3]]}), {})
    got = {r.lead: (r.groups, r.problem) for r in jobs.plans(chains, agent).collect()}
    assert got == {1: ([[1, 2], [3]], None), 7: (None, "plan breaks a rule")}
    blocks = spark.createDataFrame([(1, 2, 1, "b1", "title", None, None, None, None, "Top"), (1, 2, 2, "b2", "picture", 0.0, 0.0, 50.0, 100.0, "")], f"doc int, page int, ord int, id string, kind string, {BOX}, markdown string")
    sizes = spark.createDataFrame([(1, 2, 100.0, 200.0)], "doc int, page int, width double, height double")
    prompt = jobs.image_jobs(blocks.select("doc", "page").distinct(), blocks, sizes).first().prompt
    assert '"picture":"b2"' in prompt and '"bottom":0.5' in prompt and '["Top"]' in prompt


def test_replies_become_images(spark):
    sizes = spark.createDataFrame([(1, 1, 100.0, 100.0), (1, 2, 100.0, 100.0)], "doc int, page int, width double, height double")
    image = lambda left, right, ids=(), **more: {"bbox": {"left": left, "top": 0.0, "right": right, "bottom": 0.5}, "matched_docling_picture_ids": list(ids), "classification": "photo", "alt_text": "a", "chart": {"status": "exact", "columns": ["c"], "rows": [["1"]]}} | more
    reply = {"images": [image(0.0, 0.1, ["p2"]), image(0.5, 0.6, ["p3", "p4"], include_in_markdown=False), image(0.9, 1.0)]}
    rows = spark.createDataFrame([(1, 1, json.dumps(reply))], "doc int, page int, reply string")
    seen = jobs.seen_images(rows, sizes)
    assert [(r.image, r.x0, r.bottom) for r in seen.orderBy("image").collect()] == [(1, 0.0, 50.0), (2, 50.0, 50.0), (3, 90.0, 50.0)]
    known = [(1, 1, f"image-000{i}", f"p{i}", i, 10.0 * i, 60.0, 10.0 * i + 5, 70.0) for i in range(1, 5)] + [(1, 2, "image-0005", "p5", 1, 0.0, 0.0, 1.0, 1.0)]
    known = spark.createDataFrame(known, f"doc int, page int, id string, block string, ord int, {BOX}")
    asked = spark.createDataFrame([(1, 1, True), (1, 2, False)], "doc int, page int, ok boolean")
    blocks = spark.createDataFrame([(1, 1, 4, 0.0, -9.0, 9.0, 1.0)], f"doc int, page int, ord int, {BOX}")
    got = {r.id: (r.status, r.included, r.source, r.ord, r.chart_csv is not None) for r in jobs.analysed(known, seen, asked, blocks).collect()}
    assert got == {
        "image-0001": ("not_returned", True, "layout", 1.0, False), "image-0002": ("completed", True, "layout+vision", 2.0, True), "image-0003": ("merged", False, "layout", 3.0, True), "image-0004": ("merged", False, "layout", 4.0, True),
        "image-0005": ("failed", True, "layout", 1.0, False), "image-0006": ("completed", False, "vision", 4.5, True), "image-0007": ("completed", True, "vision", 4.5, True),
    }
