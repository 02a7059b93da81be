"""Candidates, contexts, metrics, scheduling, review, files and tasks on small cases; two documents never mix."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import grid, text
from folioflow.operators import candidates, memo, review, usage
from folioflow.operators.memo import Runner, Task
from folioflow.sinks import writers
from folioflow.sources import readers

ROWS = "array<array<string>>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pages_of_documents(spark):
    docs = spark.createDataFrame([(1, [2, 4], 5), (2, None, 3), (3, None, 0)], "doc int, selected array<int>, page_count int")
    pages = candidates.effective_pages(docs)
    assert rows(pages) == [(1, [2, 4]), (2, [1, 2, 3]), (3, [])]
    blocks = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "doc int, page int")
    assert rows(candidates.selected_only(blocks, pages)) == [(1, 2), (2, 1)]
    assert rows(candidates.covering_range(pages.where("size(pages) > 0"))) == [(1, 2, 4), (2, 1, 3)]


def test_chains_do_not_cross_documents(spark):
    df = spark.createDataFrame([(1, 9, True), (1, 10, True), (2, 10, True), (2, 11, True), (2, 13, True)], "doc int, page int, may_merge boolean")
    assert rows(candidates.page_chains(df)) == [(1, 9, 9), (1, 10, 9), (2, 10, 10), (2, 11, 10), (2, 13, 13)] or rows(candidates.page_chains(df)) == sorted([(1, 9, 9), (1, 10, 9), (2, 10, 10), (2, 11, 10), (2, 13, 13)], key=repr)
    every = df.select("doc", "page")
    scheduled = spark.createDataFrame([(2, 11)], "doc int, page int")
    got = candidates.ready_groups(df, every, every, scheduled)
    assert rows(got) == [(1, 9, 2, True), (2, 13, 1, True)]


def test_planned_chains_win(spark):
    jobs = spark.createDataFrame([(d, p, p > 1, True) for d in (1, 2) for p in (1, 2, 3)], "doc int, page int, accepted boolean, hinted boolean")
    groups = spark.createDataFrame([(1, [2, 3]), (1, [1]), (2, [1])], "doc int, pages array<int>")
    assert rows(candidates.planned_chains(groups, jobs)) == [(1, 2, 2), (1, 2, 3), (2, 1, 1), (2, 1, 2), (2, 1, 3)]


def test_group_results(spark):
    groups = spark.createDataFrame([(1, 1, [1, 2]), (1, 3, [3]), (1, 5, [5]), (1, 6, [6])], "doc int, lead int, pages array<int>")
    said = spark.createDataFrame([(1, 1, 0, [1], False), (1, 3, 0, [3], False), (1, 5, 1, None, True)], "doc int, lead int, code int, echoed array<int>, timed_out boolean")
    assert rows(candidates.group_results(groups, said).select("page", "code")) == [(1, 2), (2, 2), (3, 0), (5, 124), (6, 1)]


def test_heading_carry_and_contexts(spark):
    blocks = [(1, p, o, "section_header", f"H{p}.{o}") for p in (1, 2) for o in range(1, 6)] + [(1, 3, 1, "text", "x"), (2, 3, 1, "title", "T"), (1, 3, 2, "caption", "c"), (1, 3, 3, "text", "y" * 700)]
    df = spark.createDataFrame(blocks, "doc int, page int, ord int, kind string, markdown string")
    got = {(r.doc, r.page): r.headings for r in candidates.headings_so_far(df, 6).collect()}
    assert got == {(1, 1): [f"H1.{o}" for o in range(1, 6)], (1, 2): ["H1.5"] + [f"H2.{o}" for o in range(1, 6)], (1, 3): ["H1.5"] + [f"H2.{o}" for o in range(1, 6)], (2, 3): ["T"]}
    ctx = {(r.doc, r.page): r for r in candidates.text_context(df).collect()}
    assert ctx[1, 3].captions == ["c"] and [len(x) for x in ctx[1, 3].nearby] == [1, 600]
    pics = spark.createDataFrame([(1, 1, 4, "b4", 10.0, 0.0, 50.0, 100.0)], "doc int, page int, ord int, picture string, x0 double, top double, x1 double, bottom double")
    sizes = spark.createDataFrame([(1, 1, 100.0, 300.0)], "doc int, page int, width double, height double")
    (hint,) = candidates.picture_hints(pics, sizes).first().hints
    assert tuple(hint) == (1, "b4", 0.1, 0.0, 0.5, 0.333333)


def test_queue_limits_and_scripts(spark):
    jobs = spark.createDataFrame([("b", "pending"), ("A", "pending"), ("c", "pending"), ("0", "skipped")], "path string, state string")
    assert [r.path for r in candidates.limited(jobs, 2).collect()] == ["A", "b"]
    scripts = spark.createDataFrame([(1, "table_10"), (1, "table_9"), (1, "other")], "doc int, folder string")
    assert [r.folder for r in candidates.in_number_order(scripts).orderBy("place").collect()] == ["table_9", "table_10", "other"]


def test_usage_metrics(spark):
    events = spark.createDataFrame([(1, "table", 100, 40, 20, 0.0123456), (1, "find", 0, 0, 0, None), (2, "table", None, None, 5, 1.0)], "doc int, stage string, noncached long, cached long, output long, cost double")
    got = {(r.doc, r.stage): (r.input, r.total, r.cost, r.ratio) for r in usage.usage_of(events, "doc", "stage").collect()}
    assert got[1, "table"] == (140, 160, 0.012346, 0.2857) and got[1, "find"] == (0, 0, 0.0, 0.0) and got[None, None][1] == 165
    states = spark.createDataFrame([(1, "a", "completed", 1.5), (1, "b", "failed", 9.0)], "doc int, task string, status string, elapsed double")
    jobs = spark.createDataFrame([(1, "table", 3, 2.0, [4, 3]), (1, "table", 3, 1.0, None), (1, "image", 5, 1.0, None)], "doc int, stage string, page int, elapsed double, pages array<int>")
    r = usage.metrics(states, jobs, events).where("doc = 1").first()
    assert r.wall_seconds == 1.5 and r.work == {"table": 3.0, "image": 1.0} and [(p.page, p.seconds, p.covered) for p in r.pages] == [(5, 1.0, []), (3, 3.0, [3, 4])] and r.total.total == 160
    again = spark.createDataFrame([(1, "x", 1, 1, 1, 0.0)], "doc int, stage string, noncached long, cached long, output long, cost double")
    after = usage.after_rerun(events, again)
    assert sorted((r.doc, r.stage, r.output) for r in after.collect()) == [(1, "find", 0), (1, "table", 1), (2, "table", 5)]


def test_logs_counters_and_outcomes(spark):
    log = [("j", 1, "start", None, None, 0), ("j", 2, "tool_execution_start", None, None, 0), ("j", 3, "message_end", "assistant", "a", 2), ("j", 4, "message_end", "assistant", "  ", 0), ("j", 5, "message_end", "user", "u", 0)]
    r = usage.log_profile(spark.createDataFrame(log, "job string, seq int, type string, role string, text string, tools int")).first()
    assert (r.n, r.tool_calls, r.types, r.text) == (5, 3, {"start": 1, "tool_execution_start": 1, "message_end": 3}, "a")
    content = spark.createDataFrame([('"hi\\n"',), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]',), ("7",)], "c string")
    assert [x[0] for x in content.select(usage.content_text(F.col("c"))).collect()] == ["hi\n", "a\nb", ""]
    a, b = (spark.createDataFrame([r], "doc int, done int, tokens long") for r in ((1, 5, 10), (1, 4, 12)))
    assert rows(usage.monotone(a, b)) == [(1, 5, 12)]
    done = spark.createDataFrame([("x", s) for s in ("succeeded", "failed", "pending")] + [("y", "succeeded"), ("z", "interrupted"), ("z", "failed")], "batch string, state string")
    assert {r.batch: r.status for r in usage.batch_outcome(done).collect()} == {"x": "failed", "y": "completed", "z": "interrupted"}


def test_dispatch_keeps_limits(spark):
    queue = spark.createDataFrame([(1, "table", 1), (1, "cross_table", 2), (1, "find", 3), (1, "image", 4), (1, "table", 5), (2, "image", 1)], "doc int, kind string, sequence int")
    busy = spark.createDataFrame([(1, "table")], "doc int, kind string")
    got = usage.dispatch(queue, busy, {"find": 5, "table": 2, "image": 3}, workers=4)
    assert rows(got) == [(1, "cross_table", 2), (1, "find", 3), (1, "image", 4), (2, "image", 1)]


def test_percentiles_and_levels_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(usage, "BLOCK", 7)
    values = [("a", v % 37) for v in range(200)] + [("b", 5), ("c", None)]
    got = dict(rows(usage.percentiles(spark.createDataFrame(values, "stage string, v int"))))
    ordered = sorted(v % 37 for v in range(200))
    assert got == {"a": ordered[round(199 * 0.2)], "b": 5}
    records = spark.createDataFrame([("k", i * 2, 5 + i % 9) for i in range(100)], "stage string, ts int, run int")
    peak = max(sum(1 for i in range(100) if i * 2 <= t < i * 2 + 5 + i % 9) for t in range(300))
    assert rows(usage.scheduler_summary(records)) == [("k", 100, peak)]


def test_review_states_filters_and_fragments(spark):
    tables = spark.createDataFrame([(1, "t1", "Sales", [1, 2], "unreviewed", 0, False, " ", "applied"), (1, "t2", "Costs", [3], "ignored", 2, True, "see", "no_apply_needed")], "doc int, id string, name string, pages array<int>, status string, changed int, marked boolean, note string, state string")
    ids = lambda show, words="": [r.id for r in review.matching_tables(tables, show, words).orderBy("id").collect()]
    assert ids("all") == ["t1", "t2"] and ids("pending") == ["t1"] and ids("modified") == ids("marked") == ids("noted") == ids("ignored") == ids("no_apply") == ["t2"] and ids("all", "p1–2") == ["t1"]
    sources = spark.createDataFrame([(1, "a/B.pdf", "b"), (2, "c.pdf", "c")], "doc int, path string, name string")
    assert [r.doc for r in review.matching_sources(sources, tables, "pending", " b ").collect()] == [1]
    layout = spark.createDataFrame([(1, "l1", 1, "replaced", "x\n\n| a | b |\n|---|:---:|\n| 1 |\n| 2 | 3 | 4 |\nend", "B1"), (1, "l2", 2, "absorbed", "| A | b |\n|---|---|\n| 5 | 6 |", "B2")], "doc int, layout_id string, page int, status string, markdown string, box string")
    owner = spark.createDataFrame([(1, "t1", ["l1", "gone", "l2"], 1, "M", {3: "X"}, [["a", "b"], ["1", ""]], None)], f"doc int, id string, layout_ids array<string>, page int, box string, boxes map<int,string>, ai_rows {ROWS}, current_rows {ROWS}")
    parts = review.fragments(owner, layout)
    assert [(r.layout_id, r.rows) for r in parts.orderBy("pos").collect()] == [("l1", [["a", "b"], ["1", ""], ["2", "3"]]), ("l2", [["A", "b"], ["5", "6"]])]
    assert rows(review.regions(owner, layout)) == [(1, "t1", 1, "M"), (1, "t1", 2, "B2"), (1, "t1", 3, "X")]
    drafts = spark.createDataFrame([(1, "t1", [["a", "b"], ["9", ""]], "edited")], f"doc int, tab string, rows {ROWS}, status string")
    d = review.detail(owner, drafts, parts).first()
    assert (d.status, d.rows, d.layout_rows, d.differences, d.manual_differences) == ("approved", [["a", "b"], ["9", ""]], [["a", "b"], ["1", ""], ["2", "3"], ["5", "6"]], 4, 1)
    held = spark.createDataFrame([(1, "t1", "old")], "doc int, id string, x string")
    assert rows(review.snapshot(held, spark.createDataFrame([(1, "t1", "new"), (1, "t2", "y")], "doc int, id string, x string"))) == [(1, "t1", "old"), (1, "t2", "y")]
    lost = spark.createDataFrame([(1, 7, 10, "Tabelle: 4 b"), (1, 8, 10, "none")], "doc int, tab int, page int, text string")
    named = spark.createDataFrame([(1, 1, 12, "Table 4"), (1, 2, 30, "Table 4")], "doc int, other int, there int, name string")
    assert rows(review.number_match(lost, named)) == [(1, 7, 1)]


def test_text_and_grid_expressions(spark):
    one = spark.range(1)
    got = one.select(
        text.normalised(F.lit("#  STRASSE ß\x1c ﬁ*")), text.preview(F.lit("a \n b" + "c" * 200)), text.table_number(F.lit("Table.3")), text.table_number(F.lit("Tabelle7")), text.numbered_title(F.lit("**1.2 Sum**")), text.numbered_title(F.lit("1. x")),
        text.header_rows(F.lit("ABKÜRZUNGEN")), text.cell_key(F.lit("Ｍio.<br>€ <b>x</b>")), text.page_label(F.lit([3, 5])), text.display_units(F.lit("aß漢")), text.text_dpi(F.lit([10.0, 6.0, 8.0])), text.scrubbed(F.lit("/a/b/c /a/x"), {"/a": "A", "/a/b": "B"}),
    ).first()
    assert tuple(got) == ("strasse ss fi", "a b" + "c" * 176 + "…", "3", "7", True, False, 0, "mio € x", "P3–5", 4, round(72 * 12 / 6.0), "B/c A/x")
    pages = one.select(text.pages_of(F.lit("x<!-- page:2 -->a<!-- t -->\n<!-- page:1 -->b<!-- page:2 -->c"))).first()[0]
    assert [tuple(p) for p in pages] == [(2, "a\nc"), (1, "b")]
    g = F.lit(json.dumps([["a", "b"], ["c"]]))
    rows_ = F.from_json(g, ROWS)
    got = one.select(grid.with_row(rows_, F.lit(1)), grid.without_row(rows_, F.lit(0)), grid.with_column(rows_, F.lit(1)), grid.without_column(rows_, F.lit(0)), grid.with_cell(rows_, F.lit(1), F.lit(0), F.lit("z")), grid.csv_quoted(rows_), grid.cell_set(rows_)).first()
    assert tuple(got)[:5] == ([["a", "b"], ["", ""], ["c"]], [["c"]], [["a", "", "b"], ["c", "", ""]], [["b"], [""]], [["a", "b"], ["z"]]) and got[5] == "﻿a,b\r\nc\r\n" and got[6] == []


def test_readers(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("name: 'A: b'\npage: 3\nsource_pages:\n- 3\n- 4\nbbox:\n  x0: 1.5\n  unit: pt\nnone: null\n")
    got = json.loads(readers.yaml_metadata(spark, str(tmp_path / "m.yaml")).first().metadata)
    assert got == {"name": "A: b", "page": 3, "source_pages": [3, 4], "bbox": {"x0": 1.5, "unit": "pt"}, "none": None}
    packed = gzip.compress(b'{"blocks":[]}')
    (tmp_path / "b.json.gz").write_bytes(packed)
    path = spark.read.format("binaryFile").load(str(tmp_path / "b.json.gz")).first().path
    good, bad = (spark.createDataFrame([(path, s)], "path string, sha256 string") for s in (hashlib.sha256(packed).hexdigest(), "0"))
    assert readers.restored_blocks(spark, str(tmp_path / "b.json.gz"), good).first().blocks == '{"blocks":[]}'
    with pytest.raises(Exception, match="does not have the hash"):
        readers.restored_blocks(spark, str(tmp_path / "b.json.gz"), bad).collect()
    (tmp_path / "jobs.json").write_text('[{"pdf":"x y.pdf"},{"pdf":"/abs/z.pdf","id":"k","page":2}]')
    jobs = readers.table_jobs(spark, str(tmp_path / "jobs.json")).orderBy("id").collect()
    assert [(j.id, j.pdf.endswith("/x y.pdf") or j.pdf) for j in jobs] == [("k", "/abs/z.pdf"), ("x-y", True)]
    for name in ("r1", "r2"):
        (tmp_path / "batch" / name / "assets").mkdir(parents=True)
        (tmp_path / "batch" / name / "assets" / "metadata.json").write_text("{}")
    found = readers.results(spark, [str(tmp_path / "batch" / "r2")], [str(tmp_path / "batch")]).orderBy("position").collect()
    assert [r.folder.rsplit("/", 1)[1] for r in found] == ["r2", "r1"]
    with pytest.raises(ValueError):
        readers.results(spark)
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    for f in ("one/a.PDF", "two/b.pdf", "two/c.pdf"):
        (tmp_path / f).write_bytes(b"%PDF")
    jobs, rejected = readers.discover(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in jobs.collect()] == ["a.PDF"] and [(r.folder.rsplit("/", 1)[1], r.n) for r in rejected.collect()] == [("two", 2)]


def test_layout_provider_retries_and_turns_boxes(spark):
    assert readers.layout_options({"images_scale": 3.0})["do_ocr"] is False
    for bad in ({"what": 1}, {"ocr": {"engine": "x"}}):
        with pytest.raises(ValueError):
            readers.layout_options(bad)

    def provider(content, options):
        if options["accelerator"].get("num_threads") != 1:
            raise RuntimeError("too much")
        return [{"page": None}, {"page": 2, "kind": "text", "markdown": "m", "box": (1.0, 10.0, 5.0, 30.0), "page_height": 100.0}, {"page": 1, "kind": "table", "markdown": "t"}]

    files = spark.createDataFrame([("p.pdf", bytearray(b"x"))], "path string, content binary")
    got = [(r.ord, r.page, r.kind, r.bbox and (r.bbox.top, r.bbox.bottom)) for r in readers.layout(spark, provider=provider, files=files).orderBy("ord").collect()]
    assert got == [(1, 2, "text", (70.0, 90.0)), (2, 1, "table", None)]
    counted = readers.page_geometry(files, lambda content: [{"page": 1, "tables_found": 2, "lines": 3, "rects": 4}])
    assert rows(counted) == [("p.pdf", 1, 2, 7)]


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([(1, 1, 0, "f1", ["notes.csv"]), (1, 1, 1, "f2", ["output_2.csv", "output_1.csv"])], "doc int, page int, page_table_index int, folder string, csvs array<string>")
    assert rows(writers.table_assets(records).select("id", "csv", "extra_csvs")) == [("table-0002", "output_1.csv", ["output_2.csv"])]
    pics = spark.createDataFrame([(1, 2, 1, True, True), (1, 2, 2, True, False), (1, 1, 5, True, False)], "doc int, page int, ord int, has_image boolean, header_logo boolean")
    assert rows(writers.image_assets(pics).select("id", "page", "ord")) == [("image-0001", 1, 5), ("image-0002", 2, 2)]
    charts = spark.createDataFrame([(1, "i", "exact", ["a", "b"], [["1", "x,y"]]), (1, "j", "not_convertible", [], [])], f"doc int, id string, status string, columns array<string>, rows {ROWS}")
    assert rows(writers.chart_files(charts)) == [(1, "i", "assets/chart-tables/i.csv", '﻿a,b\r\n1,"x,y"\r\n')]
    files = [(1, p, 10) for p in (*writers.NEEDED, "work/screens/a.png", "work/review/x", "assets/t.csv")] + [(2, "work/screens/a.png", 5)]
    kept = writers.retention(spark.createDataFrame(files, "doc int, path string, length long"), spark.createDataFrame([(1, "passed"), (2, "passed")], "doc int, status string"))
    assert {(r.doc, r.path) for r in kept.where("not keep").collect()} == {(1, "work/screens/a.png")}
    assert rows(writers.retention_sizes(kept)) == [(1, 70, 60), (2, 5, 5)]
    paths = spark.createDataFrame([("/r/a/b",), ("/r/../x",), ("/q",)], "p string")
    assert [r[0] for r in paths.select(writers.relative_to(F.col("p"), "/r/")).collect()] == ["a/b", None, None]
    docs = spark.createDataFrame([(1, "a.pdf", "s", 2, [1, 2], "text\n", "o")], "doc int, file string, sha256 string, page_count int, selected array<int>, markdown string, options string")
    tables = spark.createDataFrame([(1, "t1", 1, 0, "secret")], "doc int, id string, page int, page_table_index int, internal string")
    layout, images = (spark.createDataFrame([(1, "x1", 1)], f"doc int, {n} string, page int") for n in ("layout_id", "id"))
    whole = json.loads(writers.metadata(docs, tables, layout, images).first().metadata)
    assert whole["schema_version"] == 3 and whole["source"]["selected_pages"] == [1, 2] and whole["tables"] == [{"id": "t1", "page": 1, "page_table_index": 0}]
    made = spark.createDataFrame([(1, "b", "2"), (1, "a", "1")], "doc int, path string, sha256 string")
    assert json.loads(writers.manifest(docs, made).first().manifest)["files"] == {"a": "1", "b": "2"}
    writers.write_json(docs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_tasks_run_in_order_and_are_cached(spark, tmp_path):
    calls = []

    def step(name, fails=False):
        def run(frames):
            calls.append(name)
            if fails:
                raise RuntimeError("no")
            return spark.range(3)

        return run

    tasks = [Task("c", step("c"), ("b",)), Task("a", step("a")), Task("b", step("b"), ("a",))]
    assert [t.name for t in memo.ordered(tasks)] == ["a", "b", "c"] and [t.name for t in memo.ordered(tasks, ["b"])] == ["a", "b"]
    for bad in ([Task("x", step("x"), ("y",)), Task("y", step("y"), ("x",))], [Task("x", step("x"), ("z",))]):
        with pytest.raises(ValueError):
            memo.ordered(bad)
    runner = Runner(spark, str(tmp_path))
    runner.run(tasks, {})
    runner.run(tasks, {}, force=("c",))
    assert calls == ["a", "b", "c", "c"] and {n: s.status for n, s in runner.states.items()} == {"a": "cached", "b": "cached", "c": "completed"}
    with pytest.raises(RuntimeError):
        runner.run([Task("d", step("d", True))], {})
    assert runner.states["d"].status == "failed" and runner.states["d"].message == "no"
    Runner(spark, str(tmp_path), {"x": 1}).run(tasks[1:2], {})
    assert calls[-1] == "a"


def test_reruns(spark):
    results = spark.createDataFrame([(1, True, "h", "h"), (2, True, "h", "x"), (3, True, "h", "h"), (4, False, "h", "h")], "doc int, has_blocks boolean, stored string, actual string")
    drafts = spark.createDataFrame([(3,)], "doc int")
    assert rows(memo.rerun_refused(results, drafts)) == [(1, None), (2, "source changed"), (3, "has drafts"), (4, "blocks missing")]
    old, new = spark.createDataFrame([(1, "o"), (2, "o"), (3, "o")], "doc int, v string"), spark.createDataFrame([(1, "n"), (2, "n")], "doc int, v string")
    assert rows(memo.swapped(old, new, spark.createDataFrame([(2,)], "doc int"))) == [(1, "n"), (2, "o"), (3, "o")]
    outputs = spark.createDataFrame([(1, "t", "a.json", "{"), (1, "t", "b.json", "{}"), (1, "t", "c.md", ""), (1, "t", "d", None)], "doc int, task string, path string, content string")
    assert rows(memo.output_problems(outputs).select("path", "problem")) == [("a.json", "not_json"), ("c.md", "empty"), ("d", "missing")]


def test_grid_profile(spark):
    cells = [(1, 1, r, c, v) for r, row in enumerate([["h", "i"], ["a", ""], ["h", "i"], ["b"], ["z", "y"]]) for c, v in enumerate(row)]
    r = review.csv_profile(spark.createDataFrame(cells, "doc int, tab int, r int, c int, value string")).first()
    assert (r.n_rows, r.width, r.header, r.last, r.sample) == (5, 2, ["h", "i"], ["z", "y"], [["a", ""], ["h", "i"], ["b"]])
    assert (r.ragged_rows, [tuple(x) for x in r.empty_cells], r.repeated_rows) == ([3], [(1, 1)], [2])
