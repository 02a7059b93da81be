"""A whole run over the adapter views, its cache and re-run; agents, prompts and page lists."""

import json
import time

import pytest
from pyspark.sql import functions as F

import folioflow
from folioflow.__main__ import main
from folioflow.operators import agents
from folioflow.plans import pages as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    tables, blocks = (d.where("doc < 2") for d in plans.both(spark, SF))
    last = F.lit(103)
    tables = tables.withColumn("pages", F.filter("pages", lambda p: p <= last)).withColumn("page_table_index", F.col("k")).withColumn("markdown", F.concat(F.lit("| T"), "id", F.lit(" |")))
    tables = tables.withColumn("csv", F.concat(F.lit("assets/tables/"), "id", F.lit(".csv"))).withColumn("extra_csvs", F.array().cast("array<string>"))
    path = F.concat(F.lit("assets/images/"), F.col("id"), F.lit(".png"))
    block = F.concat(F.lit("<!-- image:"), F.col("id"), F.lit(" page:"), F.col("page").cast("string"), F.lit(" -->\n\n![x]("), path, F.lit(")\n\n<!-- /image:"), F.col("id"), F.lit(" page:"), F.col("page").cast("string"), F.lit(" -->"))
    images = plans.images(spark, SF).where("doc < 2").withColumn("id", F.concat(F.lit("d"), "doc", F.lit("p"), "page", F.lit("-"), "id")).withColumn("image", path).withColumn("text", block)
    docs = spark.createDataFrame([(0, "a.pdf", "h0", 103, None), (1, "b.pdf", "h1", 103, [1, 2, 7])], "doc int, file string, sha256 string, page_count int, selected array<int>")
    return {"docs": docs, "blocks": blocks.cache(), "tables": tables.cache(), "images": images.cache()}


def test_run_cache_and_rerun(spark, tmp_path, inputs):
    engine = folioflow.Engine(spark, str(tmp_path), folioflow.Options(batch_id="one"))
    result = engine.convert(inputs)
    text = {r.doc: r.markdown for r in result.frames["output"].collect()}
    assert text[0].count("<!-- page:") == 103 and [x.split(" ")[0] for x in text[1].split("<!-- page:")[1:]] == ["1", "2", "7"] and text[1].endswith("\n")
    meta = {r.doc: json.loads(r.metadata) for r in result.frames["metadata"].collect()}
    assert len(meta[0]["tables"]) == inputs["tables"].where("doc = 0").count() and meta[0]["source"]["file"] == "a.pdf" and set(meta[0]["tables"][0]) <= set("id page source_pages page_table_index bbox csv extra_csvs merge lineage".split())
    rules = {r.rule for r in result.frames["issues"].where("doc = 0 and severity = 'error'").collect()}
    assert rules <= {"image_links", "image_markers", "image_end_markers"}  # these inputs order images by pages' pictures, not by place
    assert sum(r["tables"] for r in result.counts().collect()) == inputs["tables"].count()
    again = engine.convert(inputs)
    assert {s.status for s in again.states.values()} == {"cached"} and again.to_dict()["batch_id"] == "one"
    part = folioflow.Engine(spark, str(tmp_path), folioflow.Options(batch_id="two", pages="2-3")).convert(inputs, ["output"])
    assert {r.doc: r.markdown.count("<!-- page:") for r in part.frames["output"].collect()} == {0: 2, 1: 2} and "report" not in part.states
    one = inputs["tables"].where("doc = 1 and page = 2")
    changed = inputs["tables"].where("doc = 1").withColumn("markdown", F.lit("| NEW |"))
    none = inputs["docs"].limit(0).select("doc")
    tried = engine.rerun_tables(result, changed, none, inputs["docs"].selectExpr("doc", "sha256 as actual"))
    new = {r.doc: r.markdown for r in tried.frames["output"].collect()}
    assert new[0] == text[0] and one.count() and (("| NEW |" in new[1]) != (tried.frames["tables"].where("doc = 1").first().markdown != "| NEW |"))
    with pytest.raises(folioflow.ConfigurationError, match="has drafts"):
        engine.rerun_tables(result, changed, inputs["docs"].select("doc"), inputs["docs"].selectExpr("doc", "sha256 as actual"))


def test_preflight_and_failures(spark, tmp_path, inputs):
    engine = folioflow.Engine(spark, str(tmp_path), folioflow.Options(batch_id="x", pages="104"))
    with pytest.raises(folioflow.ConfigurationError) as e:
        engine.convert({"docs": inputs["docs"].drop("file")})
    assert e.value.batch_id == "x" and {"input blocks is missing", "docs lacks file"} <= set(e.value.problems)
    with pytest.raises(folioflow.ConfigurationError, match="beyond"):
        engine.convert(inputs)
    broken = inputs | {"blocks": inputs["blocks"].withColumn("x0", F.raise_error(F.lit("no box")).cast("int"))}
    with pytest.raises(folioflow.ExecutionError) as e:
        folioflow.Engine(spark, str(tmp_path), folioflow.Options(batch_id="y")).convert(broken)
    assert e.value.task == "claims" and e.value.batch_id == "y"


def test_command_line_converts(spark, tmp_path, inputs, capsys):
    for name, df in inputs.items():
        df.where("doc = 1").write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    assert main(["run-task", "output", str(tmp_path / "in"), str(tmp_path / "out"), "--pages", "1-2"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["tasks"]["output"]["status"] == "completed"
    assert main(["list-tasks"]) == 0 and "report" in capsys.readouterr().out
    (tmp_path / "g.csv").write_text("a,b\nc\n")
    assert main(["inspect", str(tmp_path / "g.csv")]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["width"] == 2


def test_agents_try_again_and_never_fail_the_job(spark):
    def agent(prompt, images):
        if "slow" in prompt:
            time.sleep(5)
        if "crash" in prompt:
            raise RuntimeError("gone")
        return ("fixed" if "problems" in prompt else prompt.split()[0]), {"input": 10, "output": len(images)}

    jobs = spark.createDataFrame([(1, "a", "fixed now", [b"x"]), (1, "b", "wrong", []), (1, "c", "crash", None), (2, "d", "slow", None), (2, "e", "wrong for good", None)], "doc long, job string, prompt string, images array<binary>")
    good = lambda reply: [] if reply == "fixed" else ["say fixed"]
    got = {r.job: r for r in agents.replies(jobs, agent, good, timeout=1.0).collect()}
    assert [(got[j].status, got[j].code, got[j].attempts, got[j].input) for j in "abc"] == [("completed", 0, 1, 10), ("completed", 0, 2, 20), ("failed", 1, 2, 0)]
    assert (got["d"].code, got["d"].attempts, got["c"].message) == (124, 1, "gone") and got["a"].output == 1
    once = agents.replies(jobs.where("job = 'b'"), agents.replayed({"wrong": "r"}), attempts=1)
    assert once.first().reply == "r" and agents.recorded(once, jobs) == {"wrong": "r"}
    assert agents.failed(agents.replies(jobs.where("job = 'c'"), agent)).count() == 1 and agents.usage_events(once, "table").first().stage == "table"


def test_prompts_logs_code_and_page_ranges(spark):
    df = spark.createDataFrame([([3, 4], None)], "pages array<int>, context string").withColumn("pages", agents.listed(F.col("pages")))
    assert agents.PROMPTS["detection"].split("{")[0] in df.select(agents.prompt("detection")).first()[0] and "pages 3, 4." in df.select(agents.prompt("detection")).first()[0]
    assert '{"merge_with_previous": true}' in spark.range(1).selectExpr("2 page", "1 previous").select(agents.prompt("continuation")).first()[0]
    lines = ['{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"hi"},{"type":"tool_use"}]}}', '{"type":"result","result":"done"}', "bad"]
    e = agents.translated_events(spark.createDataFrame([("j", i, x) for i, x in enumerate(lines)], "job string, seq int, line string")).orderBy("seq").collect()
    assert [(r.type, r.role, r.text, r.tools) for r in e] == [("message_end", "assistant", "hi", 1), ("message_end", "assistant", "done", 0)]
    code = "PAGES = [3, 4]\nother = [9]\nfor page in range(6, 8):\n    open('page_0011.pdf')\nsource_pages: list = (12,)\nfor x in range(20, 22): pass"
    assert agents.code_pages(code) == [3, 4, 6, 7, 11, 12] and agents.code_pages("def (") == []
    t = spark.createDataFrame([(3, [3], code), (50, [50], code)], "page int, pages array<int>, code string")
    assert [r.pages for r in agents.pages_with_code(t).orderBy("page").collect()] == [[3, 4, 6, 7, 11, 12], [50]]
    agents.register_page_range(spark)
    assert [r.page for r in spark.sql("select * from page_range('8-9,1')").collect()] == [1, 8, 9]
    with pytest.raises(Exception, match="not a page list"):
        spark.sql("select * from page_range('0')").collect()
