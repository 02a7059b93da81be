"""Queries on records of runs: assets, counts, plans, contexts and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text
from ..operators import candidates, lineage, regions, review, usage
from ..sinks import writers
from ..sources.adapters import sql_of, view
from .registry import query, read

_TEXTS = "array<string>"


def chosen(column, *values):
    """One of several values by a number from 0."""
    return F.element_at(F.array(*values), (column + 1).cast("int"))


@query("""
with r as (select o_orderkey // 10 as doc, (o_custkey % 5)::int as page, (o_orderkey % 3)::int as i, 'f' || o_orderkey as folder, o_custkey % 4 as c from orders),
n as (select *, 'table-' || lpad((row_number() over (partition by doc order by page, i, folder))::varchar, 4, '0') as id from r)
select doc, id, page, i as page_table_index, folder, 'output_1.csv' as csv, case when c = 2 then 'output_2.csv' else '' end as extra from n where c in (1, 2)""")
def table_assets(spark, sf):
    c, empty = F.col("o_custkey") % 4, F.array().cast(_TEXTS)
    names = chosen(c, empty, F.array(F.lit("output_1.csv")), F.array(F.lit("output_2.csv"), F.lit("output_1.csv")), F.array(F.lit("notes.csv")))
    rows = read(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 10).alias("doc"), (F.col("o_custkey") % 5).cast("int").alias("page"), (F.col("o_orderkey") % 3).cast("int").alias("page_table_index"), F.concat(F.lit("f"), "o_orderkey").alias("folder"), names.alias("csvs"))
    return writers.table_assets(rows).select("doc", "id", "page", "page_table_index", "folder", "csv", F.array_join("extra_csvs", ",").alias("extra"))


@query(sql_of("blocks") + """
select doc, page, ord, id, 'assets/images/' || id || '.png' as image from (select doc, page, ord, 'image-' || lpad((row_number() over (partition by doc order by page, ord))::varchar, 4, '0') as id
  from blocks where kind = 'picture' and x0 % 5 <> 0 and not (page > 1 and top < 70 and bottom - top < 60 and x1 - x0 < 160))""")
def image_assets(spark, sf):
    logo = G.header_logo(F.col("kind"), F.col("page"), G.box())
    pictures = view(spark, sf, "blocks").where("kind = 'picture'").withColumn("has_image", F.col("x0") % 5 != 0).withColumn("header_logo", logo)
    return writers.image_assets(pictures)


@query(sql_of("blocks", "agent_tables") + """,
l as (select doc, case x0 % 4 when 0 then 'replaced' when 1 then 'absorbed_into_merged_table' when 2 then 'ambiguous_continuation' else 'unmatched' end as status from blocks where kind = 'table')
select doc, t.n as tables, coalesce(i.n, 0) as images, coalesce(l.n, 0) as layout_tables, coalesce(a, 0) as replaced, coalesce(b, 0) as absorbed, coalesce(c, 0) as ambiguous, coalesce(d, 0) as unmatched
from (select doc, count(*) as n from agent_tables group by doc) t left join (select doc, count(*) as n from blocks where kind = 'picture' group by doc) i using (doc)
left join (select doc, count(*) as n, count(*) filter (status = 'replaced') as a, count(*) filter (status like 'abs%') as b, count(*) filter (status like 'amb%') as c, count(*) filter (status = 'unmatched') as d from l group by doc) l using (doc)""")
def result_counts(spark, sf):
    blocks = view(spark, sf, "blocks")
    status = chosen(F.col("x0") % 4, *map(F.lit, ("replaced", "absorbed_into_merged_table", "ambiguous_continuation", "unmatched")))
    return usage.result_counts(view(spark, sf, "agent_tables"), blocks.where("kind = 'table'").withColumn("status", status), blocks.where("kind = 'picture'"))


@query("""
with h as (select user_id as doc, event_id % 2 as half, count(*) as done, sum((json_extract_string(props, '$.k'))::bigint)::bigint as tokens from events group by 1, 2)
select doc, max(done) as done, max(tokens) as tokens from h group by doc""")
def status_counters(spark, sf):
    e = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    half = lambda n: e.where(F.col("event_id") % 2 == n).groupBy(F.col("user_id").alias("doc")).agg(F.count("*").alias("done"), F.sum("k").alias("tokens"))
    return usage.monotone(half(0), half(1))


@query(sql_of("detections") + """,
g as (select doc, page as lead, page + d as page from detections, range(0, 3) r(d) where page % 6 = 1 and doc % 2 = 0 and lines_and_rects < 30),
j as (select doc, page, may_merge as hinted, estimate = 1 as accepted from detections anti join (select distinct doc from g) x using (doc)),
l as (select *, lag(page) over w as prev, lag(accepted) over w as before from j window w as (partition by doc order by page)),
o as (select *, last_value(case when accepted and not coalesce(hinted and before and prev = page - 1, false) then prev end ignore nulls) over (partition by doc order by page rows between unbounded preceding and current row) as lead from l),
f as (select doc, lead, page from o where accepted and lead is not null)
select doc, lead, page from g union all select * from f union all select distinct doc, lead, lead from f""")
def planned_chains(spark, sf):
    d = view(spark, sf, "detections")
    groups = d.where("page % 6 = 1 and doc % 2 = 0").select("doc", F.when(F.col("lines_and_rects") < 30, F.sequence("page", F.col("page") + 2)).otherwise(F.array("page")).alias("pages"))
    return candidates.planned_chains(groups, d.select("doc", "page", F.col("may_merge").alias("hinted"), (F.col("estimate") == 1).alias("accepted")))


@query(sql_of("detections") + """,
g as (select doc, page as lead, shift from detections where page % 2 = 1),
c as (select *, case when shift = 8 then 1 when shift = 0 then 124 when shift = 1 then 3 when shift = 2 then 2 else 0 end as code from g)
select doc, (lead + d)::int as page, code::int as code, case code when 124 then 'timed out' when 2 then 'not all pages were processed' when 0 then null else 'failed' end as message from c, range(0, 2) r(d)""")
def group_results(spark, sf):
    g = view(spark, sf, "detections").where("page % 2 = 1").select("doc", F.col("page").alias("lead"), F.array("page", F.col("page") + 1).alias("pages"), "shift")
    echoed = F.when(F.col("shift") == 2, F.slice("pages", 1, 1)).otherwise(F.col("pages"))
    said = g.where("shift <> 8").select("doc", "lead", F.when(F.col("shift") == 1, 3).otherwise(0).alias("code"), echoed.alias("echoed"), (F.col("shift") == 0).alias("timed_out"))
    return candidates.group_results(g.drop("shift"), said)


@query(sql_of("agent_tables") + """,
runs as (select doc, t::int as turn, 2 * t + 1 as first, case when t % 3 = 0 then 2 * t + 2 else 2 * t + 3 end as last from (select distinct doc from agent_tables), range(0, 40) r(t)),
met as (select doc, last as page, lead(first) over (partition by doc order by turn) as next from runs)
select a.doc, a.page, a.id, m.next <> m.page as rerun from met m join agent_tables a on a.doc = m.doc and a.page = m.page where m.next is not null""")
def boundary_redactions(spark, sf):
    tables = view(spark, sf, "agent_tables")
    first = 2 * F.col("turn") + 1
    runs = tables.select("doc").distinct().select("doc", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("turn"))
    runs = runs.withColumn("pages", F.sequence(first, F.when(F.col("turn") % 3 == 0, first + 1).otherwise(first + 2)))
    return regions.redactions(runs, tables).select("doc", "page", "id", "rerun")


@query(sql_of("agent_tables") + """,
g as (select doc, (o // 2)::int as turn, page + d as page from (select doc, page, row_number() over (partition by doc order by page, id) - 1 as o from agent_tables), range(0, 2) r(d)),
u as (select distinct doc, turn, page from g)
select doc, page::int as page, count(*) as n from u group by doc, page having count(*) > 1""")
def planner_boundaries(spark, sf):
    from pyspark.sql import Window

    turn = F.floor((F.row_number().over(Window.partitionBy("doc").orderBy("page", "id")) - 1) / 2)
    rows = view(spark, sf, "agent_tables").select("doc", turn.alias("turn"), F.array("page", F.col("page") + 1).alias("p"))
    groups = rows.groupBy("doc", "turn").agg(F.flatten(F.collect_list("p")).alias("pages"))
    return regions.endpoint_overlap(groups)


@query(sql_of("blocks", "agent_tables") + """,
l as (select doc, page * 100 + ord as tab, page, (x0 % 60)::varchar as number from blocks where kind = 'table'), t as (select doc, id as other, page as there, (id % 60)::varchar as number from agent_tables)
select doc, tab, min(other) as other from l join t using (doc, number) where abs(page - there) <= 5 group by doc, tab having count(*) = 1""")
def number_match(spark, sf):
    said = F.concat(F.lit("See tabelle : "), (F.col("x0") % 60).cast("string"), F.lit(" below"))
    lost = view(spark, sf, "blocks").where("kind = 'table'").select("doc", (F.col("page") * 100 + F.col("ord")).alias("tab"), "page", said.alias("text"))
    named = view(spark, sf, "agent_tables").select("doc", F.col("id").alias("other"), F.col("page").alias("there"), F.concat(F.lit("Table."), (F.col("id") % 60).cast("string")).alias("name"))
    return review.number_match(lost, named)


@query("""
with t as (select doc_id // 10 as doc, doc_id as id, case when quality = 1 then 'approved' when toxic = 1 then 'ignored' else 'unreviewed' end as status, doc_id % 3 as changed from labels)
select doc, id, status from t where changed > 0 and contains('t' || id || 'x ' || id || ' p' || (id % 4), '1')""")
def review_filter(spark, sf):
    i = F.col("doc_id")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("toxic") == 1, "ignored").otherwise("unreviewed")
    tables = read(spark, sf, "labels").select(
        F.floor(i / 10).alias("doc"), i.alias("id"), F.concat(F.lit("T"), i, F.lit("x")).alias("name"), F.array((i % 4).cast("int")).alias("pages"), status.alias("status"),
        (i % 3).alias("changed"), F.lit(False).alias("marked"), F.lit(None).cast("string").alias("note"), F.lit("applied").alias("state"),
    )
    return review.matching_tables(tables, "modified", " 1 ").select("doc", "id", "status")


@query("""
with r as (select o_orderkey as id, (o_custkey % 7)::int as page, case when o_custkey % 3 = 0 then '' when o_custkey % 3 = 1 then 'See [' || o_custkey || ']  now' end as alt, case when o_custkey % 4 < 2 then 'Fig.  ' || (o_custkey % 5) end as caption,
  case when o_custkey % 5 = 0 then 'FIG. ' || (o_custkey % 25) when o_custkey % 5 = 1 then ' ' else 'Text ' || o_custkey end as description from orders),
c as (select *, coalesce(trim(caption), '') as cap, coalesce(trim(description), '') as d from r),
n as (select *, lower(trim(regexp_replace(cap, '\\s+', ' ', 'g'))) as nc, lower(trim(regexp_replace(d, '\\s+', ' ', 'g'))) as nd from c)
select id, '<!-- image:i' || id || ' page:' || page || ' -->' || chr(10) || chr(10) || '![' || trim(regexp_replace(translate(coalesce(nullif(alt, ''), nullif(caption, ''), 'PDF image on page ' || page), '[]', ''), '\\s+', ' ', 'g')) || '](p.png)' || chr(10) || chr(10) ||
  case when d <> '' and (cap = '' or not (contains(nc, nd) or contains(nd, nc))) then d || chr(10) || chr(10) else '' end || '<!-- /image:i' || id || ' page:' || page || ' -->' as markdown from n""")
def image_blocks(spark, sf):
    c = F.col("o_custkey")
    rows = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (c % 7).cast("int").alias("page"), F.when(c % 3 == 0, "").when(c % 3 == 1, F.concat(F.lit("See ["), c, F.lit("]  now"))).alias("alt"),
        F.when(c % 4 < 2, F.concat(F.lit("Fig.  "), c % 5)).alias("caption"), F.when(c % 5 == 0, F.concat(F.lit("FIG. "), c % 25)).when(c % 5 == 1, " ").otherwise(F.concat(F.lit("Text "), c)).alias("description"),
    )
    block = text.image_block(F.concat(F.lit("i"), "id"), F.col("page"), F.lit("p.png"), F.col("alt"), F.col("caption"), F.col("description"))
    return rows.select("id", block.alias("markdown"))


@query("""
with f as (select o_orderkey as doc, o_custkey as c, p.path from orders, (values ('output.md'), ('assets/metadata.json'), ('work/metrics.json'), ('work/diagnostics/validation.json'), ('work/screens/a.png'), ('work/review/d.json'), ('work/tasks/t.json')) p(path)
  where not (o_custkey % 6 = 0 and p.path = 'work/metrics.json')),
s as (select doc, c % 6 <> 0 and c % 4 <> 1 as good, sum(100 + length(path)) as before, sum(case when path in ('work/screens/a.png', 'work/tasks/t.json') then 0 else 100 + length(path) end) as kept from f group by doc, c)
select doc, before::bigint as before, (case when good then kept else before end)::bigint as after from s""")
def retention_sizes(spark, sf):
    orders, c = read(spark, sf, "orders").withColumn("doc", F.col("o_orderkey")), F.col("o_custkey")
    paths = F.array(*map(F.lit, (*writers.NEEDED, "work/screens/a.png", "work/review/d.json", "work/tasks/t.json")))
    files = orders.select("doc", "o_custkey", F.explode(paths).alias("path")).where(~((c % 6 == 0) & (F.col("path") == "work/metrics.json")))
    reports = orders.select("doc", F.when(c % 4 == 1, "failed").otherwise("passed").alias("status"))
    return writers.retention_sizes(writers.retention(files.select("doc", "path", (F.length("path") + 100).cast("long").alias("length")), reports))


@query("""
with l as (select conv_id as job, turn as seq, case when role = 'assistant' then 'message_end' when turn % 4 = 0 then 'tool_execution_start' else 'start' end as type, role, text, turn % 2 as tools from conversations)
select job, count(*) as n, sum(tools + case when type = 'tool_execution_start' then 1 else 0 end)::bigint as tool_calls, count(distinct type)::int as n_types, arg_max(text, seq) filter (type = 'message_end' and trim(text) <> '') as text from l group by job""")
def log_profile(spark, sf):
    kind = F.when(F.col("role") == "assistant", "message_end").when(F.col("turn") % 4 == 0, "tool_execution_start").otherwise("start")
    log = read(spark, sf, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("seq"), kind.alias("type"), "role", "text", (F.col("turn") % 2).alias("tools"))
    return usage.log_profile(log).select("job", "n", "tool_calls", F.size("types").alias("n_types"), "text")


@query(sql_of("page_sizes") + """,
w as (select id, (id % 4 + 1)::int as n, id % 5 as k from page_sizes)
select id, case when k = 0 then 'pages_not_consecutive' when k = 1 and n > 1 then 'wrong_roles' end as problem, case when k = 0 or (k = 1 and n > 1) then null else
  '1=1' || case when n > 1 then coalesce((select string_agg(',' || p || '=2', '' order by p) from range(2, n) r(p)), '') || ',' || n || '=3' else '' end end as boxes from w""")
def role_boxes(spark, sf):
    p = view(spark, sf, "page_sizes").select("id", (F.col("id") % 4 + 1).cast("int").alias("n"), (F.col("id") % 5).alias("k"))
    run = F.sequence(F.lit(1), F.col("n"))
    roles = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(r), F.lit(v)) for r, v in (("first", 1), ("middle", 2), ("last", 3)))), lambda e: (e["col1"] == "first") | ((e["col1"] == "last") & (F.col("n") > 1) & (F.col("k") != 1)) | ((e["col1"] == "middle") & (F.col("n") > 2))))
    rows = p.select("id", F.when(F.col("k") == 0, F.array(F.lit(1), F.lit(3))).otherwise(run).alias("pages"), roles.alias("roles"))
    out = regions.expanded_boxes(rows)
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("boxes")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return out.select("id", "problem", shown.alias("boxes"))


@query(sql_of("agent_tables") + """,
w as (select doc, id % 7 as id, id as seq, page, x0 from agent_tables), l as (select doc, id, page, arg_max(x0, seq) as x0 from w group by doc, id, page)
select doc, id, min(page) as page, arg_min(x0, page) as box, string_agg(page || ':' || x0, ',' order by page) as boxes from l group by doc, id""")
def box_accumulation(spark, sf):
    writes = view(spark, sf, "agent_tables").select("doc", (F.col("id") % 7).alias("id"), F.col("id").alias("seq"), "page", F.col("x0").alias("box"))
    out = regions.accumulated(writes)
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("boxes")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return out.select("doc", "id", "page", "box", shown.alias("boxes"))


@query(sql_of("blocks") + """
select doc, page, ord, 'layout-table-' || lpad((row_number() over (partition by doc order by page, ord))::varchar, 4, '0') as layout_id,
  sha256(rtrim(markdown) || chr(10)) as text_sha256, case when doc % 2 = 0 then true else false end as kept from blocks where kind = 'table'""")
def layout_exports(spark, sf):
    blocks = view(spark, sf, "blocks")
    out = None
    for keep in (True, False):
        some = blocks.where((F.col("doc") % 2 == 0) == F.lit(keep))
        part = lineage.retained(lineage.layout_ids(some), some, True).select("doc", "page", "ord", "layout_id", F.sha2("text", 256).alias("text_sha256"), F.lit(keep).alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out
