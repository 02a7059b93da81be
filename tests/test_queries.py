"""Every catalogued query against its SQL in DuckDB, and small cases of the functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import grid, text
from folioflow.operators import candidates
from folioflow.plans import catalogue
from folioflow.sources import readers
from folioflow.streaming import usage

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, found.fetchall()))


def test_greedy_match_is_one_to_one(spark):
    got = catalogue.QUERIES["best_match"](spark, SF).where("ord is not null")
    assert got.count() == got.select("doc", "page", "ord").distinct().count()


def test_box_overlap_and_centre(spark):
    row = spark.sql("select 0 x0, 0 top, 10 x1, 10 bottom, 5 b_x0, 5 b_top, 15 b_x1, 15 b_bottom")
    a, b = G.box(), G.box("b_")
    assert tuple(row.select(G.intersection(a, b), G.overlap(a, b), G.contains_center(a, b)).first()) == (25.0, 0.25, True)


def test_page_lists(spark):
    specs = ["1,3,8-12", "3,1,3", "", "0", "5-3", "a", "1-2-3", "2,,3", " 4 "]
    df = spark.createDataFrame(list(enumerate(specs)), "id int, spec string")
    got = [r.pages for r in candidates.page_selection(df).orderBy("id").collect()]
    assert got == [[1, 3, 8, 9, 10, 11, 12], [1, 3], None, None, None, None, None, None, [4]]
    far = spark.createDataFrame([(1, "1-2000000000"), (2, "9")], "id int, spec string")
    assert {r.id: (r.pages, r.problem) for r in candidates.page_selection(far, 10).collect()} == {1: (None, "beyond_last_page"), 2: ([9], None)}


def test_grids(spark):
    df = spark.sql("select array(array('a','b|c'), array('x\ny')) as g, array(array(array('H','I'), array('1','2')), array(array(' h','i'), array('3'))) as f")
    row = df.select(grid.markdown(F.col("g")), grid.csv_text(F.col("g")), grid.stitched(F.col("f")), grid.split_row(F.lit("| a | b\\|c<br>d |"))).first()
    assert row[0] == "| a | b\\|c |\n| --- | --- |\n| x<br>y |  |"
    assert row[1] == 'a,b|c\n"x\ny"\n'
    assert row[2] == [["H", "I"], ["1", "2"], ["3", ""]]
    assert row[3] == ["a", "b|c\nd"]


def test_text(spark):
    row = spark.range(1).select(text.slug(F.lit("--A b/c..")), text.table_number(F.lit("See Table  12.")), text.item_markdown(F.lit("section_header"), F.lit("T"), F.lit(9)), text.column_label(F.lit(27))).first()
    assert tuple(row) == ("A-b-c", "12", "###### T", "AB")


def test_csv_reader_keeps_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿a,b\n"x\ny"\n'.encode())
    assert readers.csv_grids(spark, str(tmp_path), pad=False).first().rows == [["a", "b"], ["x\ny"]]
    assert readers.csv_grids(spark, str(tmp_path)).first().rows == [["a", "b"], ["x\ny", ""]]


def test_event_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type":"message_end","message":{"role":"assistant","usage":{"input":100,"cacheRead":40,"output":20,"cost":{"total":0.5}}}}\nnot json\n{"type":"start"}\n')
    assert tuple(readers.event_log(spark, str(tmp_path)).first())[1:] == (100, 40, 0, 20, 0.5)


def test_streaming_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("stage"), "ts", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    usage.drain(usage.live_usage(stream), "live")
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, usage.live_usage(events).collect()))


def test_windows_and_turned_boxes(spark, tmp_path):
    events = spark.sql("select timestamp_ntz'2024-01-01 10:05:00' as ts, 'a' as stage, 2L as tokens union all select timestamp_ntz'2024-01-01 10:55:00', 'a', 3L union all select timestamp_ntz'2024-01-01 11:05:00', 'a', 4L")
    events.write.parquet(str(tmp_path / "e"))
    usage.drain(usage.windowed_usage(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))), "hours")
    assert sorted((r.start.hour, r.events, r.tokens) for r in spark.table("hours").collect()) == [(10, 2, 5), (11, 1, 4)]
    b = G.Box(*(F.lit(float(v)) for v in (10, 20, 30, 60)))
    turned = [tuple(spark.range(1).select(*G.rotated(b, F.lit(d), F.lit(100.0), F.lit(200.0))).first()) for d in (0, 90, 180, 270)]
    assert turned == [(10, 20, 30, 60), (140, 10, 180, 30), (70, 140, 90, 180), (20, 70, 60, 90)]
