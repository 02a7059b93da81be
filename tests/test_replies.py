"""Replies, image matching and audits on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import audit, pages, replies

NUMBERS = "array<int>"


def test_objects(spark):
    texts = ['{"pages":[1]}', 'x ```json\n{"pages": [2]}\n``` {"pages": 3}', 'so {"pages":[4]} ok', '{"pages":1}', '{"pages":[1]} {"pages":[2]}', "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r.x for r in df.select("id", replies.json_object(F.col("t"), "pages").alias("x")).orderBy("id").collect()]
    assert got == ['{"pages":[1]}', '{"pages":[2]}', '{"pages":[4]}', None, None, None, None]


def test_merge_decisions(spark):
    texts = ['{"merge_with_previous": true}', '```{"merge_with_previous": false}```', 'it says "merge_with_previous": TRUE', '{"merge_with_previous": "yes"}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r.x for r in df.select("id", replies.merge_decision(F.col("t")).alias("x")).orderBy("id").collect()] == [True, False, True, None, None]


@pytest.mark.parametrize("groups, pages, good", [
    ([[1, 2], [3]], [1, 2, 3], True), ([[1, 2], [2, 3]], [1, 2, 3], True), ([[1, 2], [2], [2, 3]], [1, 2, 3], False), ([[1, 3]], [1, 3], False),
    ([[1]], [1, 2], False), ([[2], [1]], [1, 2], False), ([], [1], False), ([[]], [1], False), ([["1"]], [1], False), ([[1.5]], [1], False),
])
def test_merge_groups(spark, groups, pages, good):
    df = spark.createDataFrame([(json.dumps({"groups": groups}), pages)], f"text string, pages {NUMBERS}")
    assert replies.merge_groups(df).first().groups == (groups if good else None)


def test_processed_pages(spark):
    df = spark.createDataFrame([('{"processed_pages": [1, 2]}', [1, 2]), ('{"processed_pages": [2, 1]}', [1, 2]), ("no", [1])], f"t string, p {NUMBERS}")
    assert [r[0] for r in df.select(replies.processed_pages(F.col("t"), F.col("p"))).collect()] == [True, False, False]


def test_detection_defaults(spark):
    t = '{"pages":[{"page":3,"has_table":true,"image_count_estimate":2,"image_confidence":1.5},{"page":4,"image_count_estimate":-1}]}'
    got = [r.asDict() for r in replies.detections(spark.createDataFrame([(t,)], "text string")).collect()]
    assert [(g["page"], g["has_table"], g["has_image"], g["image_count_estimate"], g["image_confidence"], g["image_kinds"], g["image_reason"]) for g in got] == [
        (3, True, True, 2, 1.0, [], ""), (4, None, False, 0, 0.0, [], ""),
    ]


def image(**changes):
    box = {"left": 0.1, "top": 0.1, "right": 0.5, "bottom": 0.5}
    return {"page_image_index": 1, "bbox": box, "classification": "photo", "chart": {"status": "not_applicable"}, "alt_text": "a"} | changes


@pytest.mark.parametrize("reply, rules", [
    ({"page": 1, "images": [image()]}, []), ({"page": 2, "images": []}, [(0, "page")]), ({"page": 1}, [(0, "object")]), ({"page": 1, "images": [3]}, [(1, "image_object")]),
    ({"page": 1, "images": [image(page_image_index=2, alt_text=" ")]}, [(1, "alt_text"), (1, "index")]), ({"page": 1, "images": [image(bbox={"left": 0})]}, [(1, "bbox")]),
    ({"page": 1, "images": [image(classification="chart", chart={"status": "exact", "columns": ["a"], "rows": [["1", "2"]]})]}, [(1, "readable_width")]),
    ({"page": 1, "images": [image(classification="table_image")]}, [(1, "table_image_flags")]), ({"page": 1, "images": [image(classification="x", confidence=2)]}, [(1, "classification"), (1, "confidence")]),
    ({"page": 1, "images": [image(chart={"status": "not_applicable", "columns": ["a"]})]}, [(1, "unreadable_data")]), ({"page": 1, "images": [image(chart=None)]}, [(1, "chart_object"), (1, "chart_status"), (1, "status_of_other")]),
    ({"page": 1, "images": [image(matched_docling_picture_ids=["p"]), image(page_image_index=2, matched_docling_picture_ids=["p"])]}, [(2, "ids_again")]),
])
def test_image_rules(spark, reply, rules):
    df = spark.createDataFrame([(1, json.dumps(reply))], "page int, text string")
    assert sorted((r.image, r.rule) for r in replies.image_issues(df).collect()) == rules


def test_image_matching(spark):
    box = "x0 double, top double, x1 double, bottom double"
    seen = [(1, 1, 0.0, 0.0, 10.0, 10.0, ["b"]), (1, 2, 0.0, 0.0, 10.0, 10.0, []), (1, 3, 50.0, 0.0, 60.0, 10.0, ["c", "d"]), (1, 4, 0.0, 0.0, 10.0, 10.0, None), (2, 1, 0.0, 0.0, 1.0, 1.0, ["z"])]
    pictures = [(1, p, i, x, 0.0, x + 10, 10.0) for i, (p, x) in enumerate([("a", 0.0), ("b", 100.0), ("c", 50.0), ("d", 55.0)])]
    seen = spark.createDataFrame(seen, f"page int, image int, {box}, ids array<string>").withColumn("doc", F.lit(1))
    got = pages.match_images(seen, spark.createDataFrame(pictures, f"page int, picture string, ord int, {box}").withColumn("doc", F.lit(1)))
    assert sorted((r.page, r.image, r.action, r.picture or "", r.score) for r in got.collect()) == [
        (1, 1, "matched", "b", 0.0), (1, 2, "matched", "a", 1.0), (1, 3, "merged", "c", 1.0), (1, 3, "merged", "d", 0.5), (1, 3, "new", "", 0.0), (1, 4, "new", "", 0.0), (2, 1, "new", "", 0.0),
    ]


def test_chain_closure(spark):
    rows = [(1, 10, 3, 0.0, 100.0), (1, 11, 4, 0.0, 90.0), (1, 12, 5, 80.0, 100.0), (1, 13, 5, 5.0, 95.0), (1, 14, 7, 0.0, 100.0), (1, 15, 4, None, None)]
    fragments = spark.createDataFrame(rows, "doc int, id int, page int, x0 double, x1 double")
    selected = spark.createDataFrame([(1, 10, 99, 8)], "doc int, id int, target int, target_page int")
    assert sorted(map(tuple, audit.chain_closure(selected, fragments).collect())) == [(1, 11, 4, 99), (1, 13, 5, 99)]


def test_cell_guard(spark):
    box = "x0 double, top double, x1 double, bottom double"
    cells = [(1, 0, 0, "ab", 0.0, 0.0, 10.0, 10.0), (1, 0, 1, "zz", 10.0, 0.0, 20.0, 10.0), (1, 1, 0, "", 0.0, 10.0, 10.0, 20.0), (1, 1, 1, "t", 10.0, 10.0, 20.0, 20.0), (1, 2, 0, "none", 0.0, 20.0, 10.0, 30.0), (1, 2, 1, "x", None, None, None, None)]
    chars = [(1, "b", True, 4.0, 1.0, 6.0, 3.0), (1, "a", True, 1.0, 1.5, 3.0, 3.5), (1, "q", True, 11.0, 1.0, 13.0, 3.0), (1, "m", True, 1.0, 11.0, 3.0, 13.0), (1, "t", False, 11.0, 11.0, 13.0, 13.0)]
    got = audit.cell_guard(spark.createDataFrame(cells, f"page int, r int, c int, value string, {box}"), spark.createDataFrame(chars, f"page int, text string, upright boolean, {box}"))
    assert sorted((r.r, r.c, r.spatial, r.reason) for r in got.collect()) == [(0, 1, "q", "different"), (1, 0, "m", "missing"), (2, 0, "", "unsupported")]


def test_repeated_cells(spark):
    grid = ["aab", "cab", "c  "]
    cells = spark.createDataFrame([(1, 1, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "doc int, tab int, r int, c int, value string")
    got = {(x.r, x.c): x.tone for x in audit.repeated_cells(cells).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 1): 0, (0, 2): 1, (1, 2): 1, (1, 0): 2, (2, 0): 2}
