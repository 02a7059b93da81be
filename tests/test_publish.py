"""Publishing of reviewed grids and release of page groups from a stream."""

from folioflow.operators import review
from folioflow.streaming import readiness, usage

ROWS = "array<array<string>>"
OLD = "<!-- table:{} page:1 -->\n\n| a |\n| --- |\n| {} |"


def test_publish(spark):
    tables = spark.createDataFrame(
        [(1, "t1", 1, None, 1, [["a"], ["x"]]), (1, "t2", 1, None, 1, [["a"], ["y\nz"]]), (2, "t1", 1, None, 1, [["a"], ["x"]]), (3, "t1", 1, None, 1, [["a"], ["x"]])],
        f"doc int, id string, page int, name string, header_rows int, ai_rows {ROWS}",
    )
    drafts = spark.createDataFrame([(1, "t1", [["a"], ["new"]], "approved"), (1, "t2", [], "skipped"), (2, "t1", [["a"], ["n"]], None)], f"doc int, tab string, rows {ROWS}, status string")
    x, flat = OLD.format("t1", "x"), OLD.format("t2", "y z")
    outputs = spark.createDataFrame([(1, f"A\n{x}\nB\n{flat}"), (2, x + x), (3, "none"), (4, "no tables")], "doc int, markdown string")
    got = {r.doc: tuple(r)[1:] for r in review.publish(outputs, review.effective_rows(tables, drafts)).collect()}
    assert got == {
        1: (f"A\n{OLD.format('t1', 'new')}\nB\n{OLD.format('t2', 'y<br>z')}", None, 2, 1), 2: (x + x, "t1", 0, 0), 3: ("none", "t1", 0, 0), 4: ("no tables", None, 0, 0),
    }


def test_settled_waits_for_unknown_pages():
    yes, lone, no = (True, True), (False, True), (False, False)
    assert readiness.settled({1: lone, 2: yes, 3: no}, {1, 2, 3, 4}) == [[1, 2]]
    assert readiness.settled({1: lone, 2: yes}, {1, 2, 3}) == []
    assert readiness.settled({2: yes, 3: no}, {1, 2, 3}) == []
    assert readiness.settled({2: yes}, {2}) == [[2]]
    assert readiness.settled({1: lone, 2: lone}, {1, 2}) == [[1], [2]]


def test_groups_are_released_once(spark, tmp_path):
    selected = list(range(1, 7))
    for n, rows in enumerate([[(2, True, True), (3, False, False)], [(1, False, True), (5, False, True)], [(4, False, False), (6, True, True)]]):
        df = spark.createDataFrame([(7, p, m, c, selected) for p, m, c in rows], "doc long, page int, may_merge boolean, candidate boolean, selected array<int>")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    usage.drain(readiness.release_groups(stream), "released", "append")
    assert sorted(map(tuple, spark.table("released").collect())) == [(7, 1, 2), (7, 5, 2)]
