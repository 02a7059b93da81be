"""One sound document, and a change for each rule that breaks exactly what it says."""

import copy

import pytest

from folioflow.operators import validate

SHAPES = {
    "docs": "doc int, version int, page_count int, selected array<int>, markdown string, retain boolean",
    "tables": "doc int, id string, page int, top double, page_table_index int, pages array<int>, csv string, extra_csvs array<string>, leaked array<string>, matched string, overlap double, action string, lineage_action string, layout_ids array<string>, relation_ids array<string>",
    "layout": "doc int, layout_id string, status string, replacements array<string>, candidates array<string>, retained boolean, markdown string",
    "images": "doc int, id string, page int, pos int, image string, included boolean, analysis_status string, chart_status string, chart_csv string",
    "files": "doc int, path string",
}
MARKDOWN = (
    "<!-- page:1 -->\n\n<!-- table:t1 page:1 -->\n\n| a |\n\n<!-- /table:t1 page:2 -->\n\n<!-- pages:2-2 merged-into:t1 -->\n\n<!-- page:3 -->\n\n"
    "<!-- table:t2 page:3 -->\n\n| b |\n\n<!-- /table:t2 page:3 -->\n\n<!-- image:i1 page:3 -->\n\n![x](assets/images/i1.png)\n\n<!-- /image:i1 page:3 -->\n"
)
SOUND = {
    "docs": [dict(doc=1, version=3, page_count=3, selected=None, markdown=MARKDOWN, retain=True)],
    "tables": [
        dict(doc=1, id="t1", page=1, top=5.0, page_table_index=0, pages=[1, 2], csv="assets/tables/t1.csv", extra_csvs=["assets/tables/t1b.csv"], leaked=[], matched="b1", overlap=0.9, action="replaced_layout_table", lineage_action="merged_from_layout_tables", layout_ids=["l1", "l2"], relation_ids=["l1", "l2"]),
        dict(doc=1, id="t2", page=3, top=5.0, page_table_index=0, pages=[3], csv="assets/tables/t2.csv", extra_csvs=[], leaked=[], matched=None, overlap=0.0, action="inserted_missing_table", lineage_action="inserted_without_layout_table", layout_ids=[], relation_ids=[]),
    ],
    "layout": [
        dict(doc=1, layout_id="l1", status="replaced", replacements=["t1"], candidates=[], retained=True, markdown="assets/layout-tables/l1.md"),
        dict(doc=1, layout_id="l2", status="absorbed_into_merged_table", replacements=["t1"], candidates=[], retained=True, markdown="assets/layout-tables/l2.md"),
    ],
    "images": [dict(doc=1, id="i1", page=3, pos=1, image="assets/images/i1.png", included=True, analysis_status="completed", chart_status="exact", chart_csv="assets/chart-tables/i1.csv")],
    "files": [dict(doc=1, path=p) for p in ("assets/tables/t1.csv", "assets/tables/t1b.csv", "assets/tables/t2.csv", "assets/layout-tables/l1.md", "assets/layout-tables/l2.md", "assets/images/i1.png", "assets/chart-tables/i1.csv")],
}


def said(old, new):
    return lambda w: w["docs"][0].update(markdown=w["docs"][0]["markdown"].replace(old, new))


def put(entity, at, **values):
    return lambda w: w[entity][at].update(values)


def gone(path):
    return lambda w: w.update(files=[f for f in w["files"] if f["path"] != path])


def both(*changes):
    return lambda w: [c(w) for c in changes]


BREAKS = [
    (put("docs", 0, version=2), {"version"}), (put("docs", 0, selected=[3, 1, 2]), {"selected_sorted", "page_markers"}), (put("docs", 0, selected=[1, 2, 3, 4]), {"selected_in_range", "page_markers"}),
    (said("<!-- page:3 -->", ""), {"page_markers"}), (said("pages:2-2", "pages:2-3"), {"page_markers", "merged_range"}), (said("merged-into:t1", "merged-into:t9"), {"merged_range"}),
    (said("<!-- table:t2 page:3 -->", ""), {"table_markers"}), (said("<!-- /table:t1 page:2 -->", "<!-- /table:t1 page:1 -->"), {"table_end_markers"}),
    (said("(assets/images/i1.png)", "(x.png)"), {"image_links"}), (said("<!-- image:i1", "<!-- image:i2"), {"image_markers"}), (said("<!-- /image:i1", "<!-- /image:i2"), {"image_end_markers"}),
    (said("| b |", "<!-- image -->"), {"placeholder"}),
    (put("docs", 0, markdown=" \n"), {"not_empty", "page_markers", "table_markers", "table_end_markers", "image_links", "image_markers", "image_end_markers"}),
    (put("tables", 1, pages=[2]), {"source_pages", "table_end_markers"}), (gone("assets/tables/t2.csv"), {"csv_missing"}), (gone("assets/tables/t1b.csv"), {"extra_csv_missing"}),
    (put("tables", 1, csv="t2.csv"), {"csv_outside", "csv_missing"}), (put("tables", 0, leaked=["internal"]), {"leaked_fields"}), (put("tables", 0, overlap=0.34), {"match_overlap"}),
    (put("tables", 1, action=None), {"unmatched_action"}), (put("tables", 0, lineage_action="x"), {"lineage_action"}), (put("tables", 0, relation_ids=["l2", "l1"]), {"lineage_relations"}),
    (put("tables", 0, layout_ids=["l1", "l2", "l2"], relation_ids=["l1", "l2", "l2"]), {"lineage_twice"}), (put("tables", 0, lineage_action="inserted_without_layout_table"), {"inserted_with_ids"}),
    (put("tables", 1, lineage_action="replaced_layout_table"), {"mapped_without_ids"}), (put("tables", 0, layout_ids=["l1", "l9"], relation_ids=["l1", "l9"]), {"unknown_layout_table", "lineage_one_sided_back"}),
    (put("tables", 1, matched="b1", overlap=1.0), {"block_matched_twice"}), (put("layout", 0, replacements=[]), {"lineage_one_sided"}), (put("layout", 0, candidates=["t8"]), {"unknown_table"}),
    (put("layout", 0, status="ambiguous_continuation"), {"ambiguous_continuation"}), (lambda w: w["layout"].append(dict(w["layout"][0])), {"layout_id_twice"}),
    (put("layout", 0, markdown="x.md"), {"retained_path"}), (put("layout", 0, retained=False), {"path_not_retained", "not_all_retained"}), (gone("assets/layout-tables/l1.md"), {"retained_file_missing"}),
    (put("docs", 0, retain=False), {"retained_while_off", "stale_folder"}), (both(gone("assets/layout-tables/l1.md"), gone("assets/layout-tables/l2.md")), {"retained_file_missing", "retained_folder_missing"}),
    (gone("assets/images/i1.png"), {"image_missing"}), (put("images", 0, analysis_status="failed"), {"analysis_failed"}), (put("images", 0, chart_status="not_convertible"), {"chart_status"}),
    (put("images", 0, chart_csv="x.csv"), {"chart_outside"}), (gone("assets/chart-tables/i1.csv"), {"chart_missing"}), (put("images", 0, chart_csv=None), {"chart_without_csv"}),
]


def frames(spark, worlds):
    return {name: spark.createDataFrame([tuple(row[c.split()[0]] for c in shape.split(", ")) for w in worlds for row in w[name]], shape) for name, shape in SHAPES.items()}


@pytest.fixture(scope="module")
def found(spark):
    worlds = []
    for i, (change, _) in enumerate([(lambda w: None, set()), *BREAKS]):
        w = copy.deepcopy(SOUND)
        change(w)
        for rows in w.values():
            for row in rows:
                row["doc"] = i
        worlds.append(w)
    f = frames(spark, worlds)
    issues = validate.issues(f["docs"], f["tables"], f["layout"], f["images"], f["files"]).cache()
    return f, issues


def test_each_rule_is_broken_alone(found):
    _, issues = found
    got = {}
    for r in issues.collect():
        got.setdefault(r.doc, set()).add(r.rule)
    assert 0 not in got
    assert {i: got.get(i, set()) for i in range(1, len(BREAKS) + 1)} == {i: rules for i, (_, rules) in enumerate(BREAKS, 1)}


def test_report_fails_on_errors_only(found):
    f, issues = found
    status = {r.doc: r.status for r in validate.report(f["docs"], issues).collect()}
    warned = {i for i, (_, rules) in enumerate(BREAKS, 1) if rules <= {"ambiguous_continuation", "unknown_table", "analysis_failed", "layout_id_twice"}}
    assert status[0] == "passed" and all(status[i] == "passed" for i in warned) and status[1] == "failed"


def test_page_differences(spark):
    e, p = (spark.createDataFrame([(1, x) for x in pages], "doc int, page int") for pages in ([1, 2], [2, 3]))
    assert {(r.page, r.side) for r in validate.page_differences(e, p).collect()} == {(1, "missing"), (3, "unexpected")}
