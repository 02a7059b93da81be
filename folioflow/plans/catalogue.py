"""The library's queries over the driver tables and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grid, text
from ..operators import audit, candidates, memo, regions, replies, review, usage, validate
from ..sources.adapters import VIEWS, sql_of, view
from . import pages as _pages  # noqa: F401  (registers its queries)
from . import records as _records  # noqa: F401
from .registry import ORACLE_SQL, QUERIES, query, read  # noqa: F401

FLAGSHIP = "insertion_slot"


@query("""
with s as (select o_orderkey as id, case o_custkey % 5 when 0 then '3,1-2,' || (o_custkey % 9 + 1) when 1 then '0,2' when 2 then '5-3' when 3 then (o_custkey % 7 + 1) || '-' || (o_custkey % 7 + 4) || ',2' else 'x' end as spec, o_custkey as c from orders)
select id, array_to_string(case when c % 5 = 0 and c % 9 + 1 <= 8 then list_sort(list_distinct([1, 2, 3, c % 9 + 1])) when c % 5 = 3 and c % 7 + 4 <= 8 then list_sort(list_distinct(list_append(range(c % 7 + 1, c % 7 + 5), 2))) end, ',') as pages,
  case when c % 5 in (1, 2, 4) then 'not_a_page_list' when (c % 5 = 0 and c % 9 + 1 > 8) or (c % 5 = 3 and c % 7 + 4 > 8) then 'beyond_last_page' end as problem from s""")
def page_selection(spark, sf):
    c = F.col("o_custkey")
    spec = F.when(c % 5 == 0, F.concat(F.lit("3,1-2,"), (c % 9 + 1).cast("string"))).when(c % 5 == 1, "0,2").when(c % 5 == 2, "5-3").when(c % 5 == 3, F.concat((c % 7 + 1).cast("string"), F.lit("-"), (c % 7 + 4).cast("string"), F.lit(",2"))).otherwise("x")
    out = candidates.page_selection(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), spec.alias("spec")), 8)
    return out.select("id", F.array_join("pages", ",").alias("pages"), "problem")


_CANDIDATES = """union_ as (select doc, page, 'layout' as src from blocks where kind = 'table' union all select doc, page, 'vision' from detections where has_table or estimate > 0
  union all select doc, page, 'heuristic' from detections where tables_found > 0 or lines_and_rects >= 20),
candidate as (select doc, page, array_to_string(list_sort(list(distinct src)), ',') as sources from union_ group by doc, page)"""
_CHAINS = """{0} as (select doc, page, max(case when starts then page end) over (partition by doc order by page rows between unbounded preceding and current row) as lead
  from (select doc, page, not (may_merge and coalesce(lag(page) over (partition by doc order by page) = page - 1, false)) as starts from {1}))"""


@query(sql_of("blocks", "detections") + "," + _CANDIDATES + " select * from candidate")
def candidate_union(spark, sf):
    return candidates.candidate_union(view(spark, sf, "blocks"), view(spark, sf, "detections"))


@query(sql_of("detections") + "," + _CHAINS.format("chains", "detections") + " select * from chains")
def page_chains(spark, sf):
    return candidates.page_chains(view(spark, sf, "detections").select("doc", "page", "may_merge"))


_READY = "known as (select * from detections where lines_and_rects <> 5), " + _CANDIDATES.replace("from detections", "from known") + ",\npicked as (select k.* from known k semi join candidate c on c.doc = k.doc and c.page = k.page)," + _CHAINS.format("chains", "picked") + """,
groups as (select doc, lead, count(*) as pages, max(page) as last from chains group by doc, lead),
ready as (select g.doc, g.lead, g.pages, (a.page is null or b.page is not null) and not (l.may_merge and p.page is not null and q.page is null) as ready
  from groups g join known l on l.doc = g.doc and l.page = g.lead left join detections a on a.doc = g.doc and a.page = g.last + 1 left join known b on b.doc = g.doc and b.page = g.last + 1
  left join detections p on p.doc = g.doc and p.page = g.lead - 1 left join known q on q.doc = g.doc and q.page = g.lead - 1)"""


@query(sql_of("blocks", "detections") + "," + _READY + " select * from ready")
def ready_groups(spark, sf):
    """Pages of all documents are selected; those with five ruling lines are not detected yet."""
    selected = view(spark, sf, "detections")
    known = selected.where("lines_and_rects <> 5")
    return candidates.ready_groups(known, candidates.candidate_union(view(spark, sf, "blocks"), known), selected)


#: Jobs skip pages, as detections do: physical numbers leave gaps where a shift comes up.
_JOBS = "j as (select doc, page + (sum(case when shift = 0 then 1 else 0 end) over (partition by doc order by page))::int as page, may_merge as hinted, estimate = 1 and page % 5 <> 2 as accepted from detections)"


def _jobs(spark, sf):
    from pyspark.sql import Window

    gaps = F.sum(F.when(F.col("shift") == 0, 1).otherwise(0)).over(Window.partitionBy("doc").orderBy("page"))
    return view(spark, sf, "detections").select("doc", (F.col("page") + gaps).cast("int").alias("page"), F.col("may_merge").alias("hinted"), ((F.col("estimate") == 1) & (F.col("page") % 5 != 2)).alias("accepted"))


@query(sql_of("detections") + ",\n" + _JOBS + """,
l as (select *, lag(page) over w as prev, lag(accepted) over w as before from j window w as (partition by doc order by page)),
o as (select *, last_value(case when accepted and not coalesce(hinted and before and prev = page - 1, false) then prev end ignore nulls) over (partition by doc order by page rows between unbounded preceding and current row) as lead from l),
f as (select doc, lead, page from o where accepted and lead is not null)
select * from f union all select distinct doc, lead, lead from f""")
def accepted_chains(spark, sf):
    return candidates.accepted_chains(_jobs(spark, sf))


@query(sql_of("blocks", "detections") + "," + _READY + """,
c as (select *, case when ready and pages > 1 then 0 when pages = 2 then 1 else 2 end as category from ready)
select doc, lead, category, row_number() over (partition by doc order by category, pages desc, lead)::int as place from c""")
def queue_priority(spark, sf):
    return candidates.queue_priority(ready_groups(spark, sf))


@query(sql_of("detections") + ",\n" + _JOBS + """,
n as (select doc, page, (row_number() over w - 1) // 8 as batch, lag(page) over w as prev from j window w as (partition by doc order by page))
select doc, batch::int as batch, min(page) as first, max(page) as last, count(*) as n, case when arg_min(prev, page) = min(page) - 1 then arg_min(prev, page) end as context from n group by doc, batch""")
def contact_batches(spark, sf):
    return candidates.batches(_jobs(spark, sf).select("doc", "page"))


@query(sql_of("detections") + ",\n" + _JOBS + """,
n as (select doc, page, (row_number() over (partition by doc order by page) - 1) // 12 as sheet from j)
select doc, sheet::int as sheet, string_agg(page::varchar, ',' order by page) as pages from n group by doc, sheet""")
def contact_sheets(spark, sf):
    return candidates.sheets(_jobs(spark, sf)).select("doc", "sheet", F.array_join("pages", ",").alias("pages"))


@query(sql_of("blocks") + """,
t as (select doc, page, ord, markdown, row_number() over (partition by doc order by page, ord) as n from blocks where kind in ('title', 'section_header')),
p as (select distinct doc, page from blocks),
m as (select p.doc, p.page, max(t.n) as upto from p left join t on t.doc = p.doc and t.page <= p.page group by p.doc, p.page)
select m.doc, m.page, coalesce(string_agg(t.markdown, '/' order by t.n), '') as headings from m left join t on t.doc = m.doc and t.n between m.upto - 5 and m.upto group by m.doc, m.page""")
def heading_carry(spark, sf):
    return candidates.headings_so_far(view(spark, sf, "blocks")).select("doc", "page", F.array_join("headings", "/").alias("headings"))


@query(sql_of("blocks") + """,
n as (select *, row_number() over (partition by doc, page, kind = 'caption' order by ord) as n from blocks where kind not in ('picture', 'table', 'title', 'section_header'))
select doc, page, coalesce(string_agg(markdown, '/' order by n) filter (kind = 'caption' and n <= 3), '') as captions, coalesce(string_agg(left(markdown, 6), '/' order by n) filter (kind <> 'caption' and n <= 2), '') as nearby
from (select doc, page, kind, n, case when kind = 'caption' then left(markdown, 6) else markdown end as markdown from n where n <= 3) group by doc, page having count(*) > 0""")
def text_context(spark, sf):
    out = candidates.text_context(view(spark, sf, "blocks"), captions=3, nearby=2, length=6)
    return out.select("doc", "page", F.array_join("captions", "/").alias("captions"), F.array_join("nearby", "/").alias("nearby"))


@query(sql_of("agent_events") + """,
e as (select *, case when seq % 3 = 0 then tokens::bigint else 0 end as c from agent_events)
select stage, job, count(*) as n, sum(tokens::bigint)::bigint as tokens, sum(c)::bigint as cached, case when sum(tokens::bigint) > 0 then round_even(sum(c)::double / sum(tokens::bigint)::double, 4) else 0.0 end as ratio from e group by rollup(stage, job)""")
def usage_rollup(spark, sf):
    return usage.usage_rollup(view(spark, sf, "agent_events").withColumn("cached", F.when(F.col("seq") % 3 == 0, F.col("tokens")).otherwise(0)))


@query("select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations where role = 'assistant' and trim(text) <> '') where n = 1")
def last_assistant(spark, sf):
    return usage.last_text(read(spark, sf, "conversations"))


@query("""
with r as (select event_type as stage, floor(epoch(ts))::bigint as ts, user_id % 900 + 1 as run from events),
t as (select stage, ts, 1 as d from r union all select stage, ts + run, -1 from r),
s as (select stage, ts, sum(case when d > 0 then 1 else 0 end) as up, sum(d) as net from t group by stage, ts),
l as (select *, sum(net) over (partition by stage order by ts) as level from s)
select stage, sum(up)::bigint as n, max(level)::bigint as peak from l group by stage""")
def sched_summary(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("stage"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), (F.col("user_id") % 900 + 1).alias("run"))
    return usage.scheduler_summary(e)


@query("""select stage, v[(round_even((len(v) - 1) * 0.2::double, 0))::int + 1] as p from (select event_type as stage, list_sort(list(user_id)) as v from events group by event_type)""")
def nearest_rank_p20(spark, sf):
    return usage.percentiles(read(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("v")))


@query("""select doc, task, ended from (select user_id as doc, event_type as task, event_id as ended, row_number() over (partition by user_id order by event_id desc, event_type desc) as n from events where event_id % 4 = 0) where n = 1""")
def latest_failure(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("task"), F.col("event_id").alias("ended"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("completed").alias("status"))
    return usage.latest_failure(e)


@query("""
with e as (select user_id % 40 as doc, event_type as task, case when event_id % 4 = 0 then 'failed' else 'completed' end as status, event_id % 60 + 0.5::double as elapsed, event_id, (json_extract_string(props, '$.k'))::bigint as k from events),
w as (select doc, round_even(sum(case when status = 'completed' then elapsed else 0 end), 3) as wall_seconds, count(*) as n_tasks from e group by doc),
u as (select doc, sum(k)::bigint as input, sum(k // 2)::bigint as output from e group by doc),
p as (select doc, count(distinct (task, event_id % 9)) as n_pages from e group by doc)
select doc, wall_seconds, n_tasks, n_pages, input + output as total from w join u using (doc) join p using (doc)""")
def run_metrics(spark, sf):
    e = read(spark, sf, "events").withColumn("doc", F.col("user_id") % 40).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    states = e.select("doc", F.col("event_type").alias("task"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("completed").alias("status"), (F.col("event_id") % 60 + 0.5).alias("elapsed"))
    jobs = e.select("doc", F.col("event_type").alias("stage"), (F.col("event_id") % 9).cast("int").alias("page"), F.lit(1.0).alias("elapsed"), F.lit(None).cast("array<int>").alias("pages"))
    events = e.select("doc", F.col("event_type").alias("stage"), (F.col("k") - F.floor(F.col("k") / 3)).alias("noncached"), F.floor(F.col("k") / 3).alias("cached"), F.floor(F.col("k") / 2).alias("output"), F.lit(0.0).alias("cost"))
    out = usage.metrics(states, jobs, events)
    return out.select("doc", "wall_seconds", F.size("tasks").cast("long").alias("n_tasks"), F.size("pages").cast("long").alias("n_pages"), F.col("total.total").alias("total"))


@query("""
with j as (select event_type as batch, case event_id % 6 when 0 then 'pending' when 1 then 'succeeded' when 2 then case when user_id % 2 = 0 then 'failed' else 'succeeded' end when 3 then 'skipped' when 4 then 'invalid' else 'succeeded' end as state from events)
select batch, count(*) as discovered, count(*) filter (state = 'pending') as pending, count(*) filter (state = 'succeeded') as succeeded, count(*) filter (state = 'failed') as failed, count(*) filter (state = 'skipped') as skipped,
  count(*) filter (state = 'invalid') as invalid, count(*) filter (state = 'interrupted') as interrupted, case when bool_or(state in ('failed', 'invalid')) then 'failed' else 'completed' end as status from j group by batch""")
def batch_outcome(spark, sf):
    n, odd = F.col("event_id") % 6, F.col("user_id") % 2 == 1
    state = F.when(n == 0, "pending").when((n == 1) | (n == 5) | ((n == 2) & odd), "succeeded").when(n == 2, "failed").when(n == 3, "skipped").otherwise("invalid")
    return usage.batch_outcome(read(spark, sf, "events").select(F.col("event_type").alias("batch"), state.alias("state")))


@query("""
with q as (select user_id as doc, case event_id % 4 when 0 then 'find' when 1 then 'cross_table' when 2 then 'table' else 'image' end as kind, event_id as sequence from events),
r as (select *, case kind when 'find' then 1 when 'cross_table' then 2 when 'table' then 3 else 4 end as rank, case when kind = 'cross_table' then 'table' else kind end as grp from q),
t as (select *, row_number() over (partition by doc, grp order by rank, sequence) as turn from r),
f as (select *, row_number() over (partition by doc order by rank, sequence) as place from t where turn <= case grp when 'find' then 2 when 'table' then 3 else 1 end)
select doc, kind, sequence from f where place <= 5""")
def dispatch_order(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, usage.KINDS)), (F.col("event_id") % 4 + 1).cast("int"))
    queue = read(spark, sf, "events").select(F.col("user_id").alias("doc"), kind.alias("kind"), F.col("event_id").alias("sequence"))
    return usage.dispatch(queue, queue.limit(0).select("doc", "kind"), {"find": 2, "table": 3, "image": 1})


_CELLS = sql_of("blocks") + f", cells as ({VIEWS['cells']})"


@query(_CELLS + """,
rows_ as (select doc, tab, r, string_agg(value, chr(1) order by c) as row, count(*) as w, count(*) filter (value = '') as empty from cells group by doc, tab, r),
first_ as (select doc, tab, arg_min(row, r) as f, min(r) as fr from rows_ group by doc, tab)
select doc, tab, count(*) as n_rows, max(w)::int as width, sum(empty)::bigint as empty, count(*) filter (row = f and r > fr) as repeated from rows_ join first_ using (doc, tab) group by doc, tab""")
def csv_profile(spark, sf):
    return review.csv_profile(view(spark, sf, "cells")).select("doc", "tab", "n_rows", "width", "empty", "repeated")


@query(_CELLS + """,
l as (select * from cells where (tab + r) % 9 <> 0), o as (select doc, tab, r, c, case when (tab + r + c) % 13 = 0 then value || '*' else value end as value from cells where (tab + r) % 8 <> 0)
select doc, tab, count(*) filter (coalesce(l.value, '') <> coalesce(o.value, '')) as changed from l full join o using (doc, tab, r, c) group by doc, tab""")
def cell_diff(spark, sf):
    cells = view(spark, sf, "cells")
    other = cells.where("(tab + r) % 8 <> 0").withColumn("value", F.when((F.col("tab") + F.col("r") + F.col("c")) % 13 == 0, F.concat("value", F.lit("*"))).otherwise(F.col("value")))
    return review.cell_diff(cells.where("(tab + r) % 9 <> 0"), other)


#: Versions of grids: what was extracted, what stands now (some documents' changed), what drafts want (some tables').
_VERSIONS = """ai as (select * from cells), now as (select doc, tab, r, c, case when doc % 3 = 1 and r = 1 and c = 1 then value || '!' else value end as value from cells where tab % 2 = 0),
draft as (select doc, tab, r, c, case when doc % 4 = 2 and r = 2 and c = 1 then value || '?' when doc % 3 = 1 and r = 1 and c = 1 and tab % 2 = 0 then value || '!' else value end as value from cells where tab % 5 = 0)"""


@query(_CELLS + ",\n" + _VERSIONS + """,
cur as (select * from now union all select * from ai where tab % 2 <> 0), want as (select * from draft union all select * from cur where tab % 5 <> 0),
p as (select doc, bool_or(coalesce(a.value, '') <> coalesce(b.value, '')) as pending from want a full join cur b using (doc, tab, r, c) group by doc),
q as (select doc, bool_or(coalesce(a.value, '') <> coalesce(b.value, '')) as applied from cur a full join ai b using (doc, tab, r, c) group by doc)
select doc, case when pending then 'pending_apply' when applied then 'applied' else 'no_apply_needed' end as state from p join q using (doc)""")
def application_state(spark, sf):
    cells = view(spark, sf, "cells")
    at = lambda r, c: (F.col("r") == r) & (F.col("c") == c)
    changed = (F.col("doc") % 3 == 1) & at(1, 1) & (F.col("tab") % 2 == 0)
    mark = lambda *cases: F.concat("value", sum_(cases))

    def sum_(cases):
        out = F.lit("")
        for condition, sign in reversed(cases):
            out = F.when(condition, sign).otherwise(out)
        return out

    now = cells.where("tab % 2 = 0").withColumn("value", mark((changed, "!")))
    drafts = cells.where("tab % 5 = 0").withColumn("value", mark(((F.col("doc") % 4 == 2) & at(2, 1), "?"), (changed, "!")))
    return review.application_state(cells, now, drafts)


@query(_CELLS + """,
u as (select distinct doc, tab, value from cells where length(value) >= 2 and value not in ('ja', 'nein', 'kw', 'km', 'mw', 'mva', 'euro', 'mio €')), own as (select doc, tab, count(*) as own from u group by doc, tab),
p as (select a.doc, a.tab, b.tab as other, count(*) as n_shared from u a join u b on a.doc = b.doc and a.value = b.value and a.tab <> b.tab group by a.doc, a.tab, b.tab),
g as (select doc, tab, other, n_shared, n_shared::double / own as recall from p join own using (doc, tab))
select doc, tab, other, n_shared, recall from (select *, row_number() over (partition by doc, tab order by recall desc, n_shared desc, abs(tab - other), other) as n from g where n_shared >= 3 and recall >= 0.45) where n = 1""")
def content_overlap(spark, sf):
    cells = view(spark, sf, "cells", "doc").withColumn("page", F.col("tab"))
    return review.content_overlap(cells, cells)


@query(sql_of("blocks", "agent_tables") + """,
spans as (select doc, id as span, page + more as page, top as t_top, bottom as t_bottom from agent_tables where more > 0),
every as (select doc, id, page + d as page, top from agent_tables, range(0, 3) r(d) where d <= more),
sure as (select s.doc, s.span, s.page, count(distinct e.id) as n from spans s join every e on e.doc = s.doc and e.page = s.page and e.id <> s.span and e.top >= s.t_bottom - 3 group by s.doc, s.span, s.page),
low as (select s.doc, s.span, s.page, max(b.top) as low from spans s join blocks b on b.doc = s.doc and b.page = s.page where b.kind = 'table' and b.top >= s.t_bottom - 3 and b.top > s.t_top + 3 group by s.doc, s.span, s.page),
marks as (select s.doc, s.span, s.page, count(distinct b.ord) as n from spans s join low l on l.doc = s.doc and l.span = s.span join blocks b on b.doc = s.doc and b.page = s.page
  where b.kind <> 'table' and b.top >= s.t_bottom - 3 and b.bottom <= l.low + 3 and b.kind = 'section_header' group by s.doc, s.span, s.page)
select coalesce(a.doc, b.doc) as doc, coalesce(a.span, b.span) as id, coalesce(a.page, b.page) as page, coalesce(a.n, 0) as others, coalesce(b.n, 0) as markers, case when a.n > 0 then 'high' else 'candidate' end as confidence
from sure a full join marks b on a.doc = b.doc and a.span = b.span""")
def transition_pages(spark, sf):
    tables, blocks = _pages.both(spark, sf)
    out = review.transition_pages(tables, blocks)
    return out.select("doc", "id", "page", F.size("others").cast("long").alias("others"), F.size("markers").cast("long").alias("markers"), "confidence")


@query("""
with d as (select doc_id // 10 as doc, case when quality = 1 then 'approved' when toxic = 1 then 'ignored' else 'unreviewed' end as status, toxic = 1 as marked, doc_id % 3 as changed, case when doc_id % 7 = 0 then ' see ' else ' ' end as note from labels)
select doc, count(*) as n, count(*) filter (status <> 'unreviewed') as reviewed, count(*) filter (changed > 0) as modified, count(*) filter (trim(note) <> '') as noted, count(*) filter (marked) as marked from d group by doc""")
def review_summary(spark, sf):
    status = F.when(F.col("quality") == 1, "approved").when(F.col("toxic") == 1, "ignored").otherwise("unreviewed")
    note = F.when(F.col("doc_id") % 7 == 0, " see ").otherwise(" ")
    return review.review_summary(read(spark, sf, "labels").select(F.floor(F.col("doc_id") / 10).cast("long").alias("doc"), status.alias("status"), (F.col("doc_id") % 3).alias("changed"), note.alias("note"), (F.col("toxic") == 1).alias("marked")))


@query("""
select doc, tab, saved, version from (select user_id as doc, event_type as tab, floor(epoch(ts))::bigint as saved, event_id as version, row_number() over (partition by user_id, event_type order by floor(epoch(ts))::bigint desc, event_id desc) as n from events) where n = 1""")
def latest_drafts(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("tab"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("saved"), F.col("event_id").alias("version"))
    return review.latest_drafts(e)


@query(sql_of("page_sizes") + """
select id, (ceil(width / 32.0) * ceil(height / 32.0))::bigint as patches,
  coalesce(list_max(list_filter(range(1, 241), lambda d: (ceil(ceil(width * d / 72.0::double) / 32.0) * ceil(ceil(height * d / 72.0::double) / 32.0))::bigint <= 10000)), 1)::int as dpi from page_sizes""")
def render_dpi(spark, sf):
    p = view(spark, sf, "page_sizes")
    return p.select("id", text.patch_count(F.col("width"), F.col("height")).alias("patches"), text.render_dpi(F.col("width"), F.col("height"), 240, 10_000).cast("int").alias("dpi"))


@query(sql_of("page_sizes") + """,
w as (select id, width + d * 7 as weight, d as page, 40 + id % 9 as rows from page_sizes, range(1, 4) r(d)),
b as (select *, sum(weight) over (partition by id order by page) as run, sum(weight) over (partition by id) as whole from w),
h as (select id, page, case when page = 3 then rows else floor(run::double / whole * rows + 0.5)::int end::int as high from b)
select id, page::int as page, coalesce(lag(high) over (partition by id order by page), 0)::int as low, high from h""")
def row_bounds(spark, sf):
    p = view(spark, sf, "page_sizes").select("id", "width", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    weights = p.select(F.lit(0).alias("doc"), "id", "page", (F.col("width") + F.col("page") * 7).alias("weight"), (F.col("id") % 9 + 40).cast("int").alias("rows"))
    return regions.row_bounds(weights).drop("doc")


@query(r"""
select doc_id, sha256(replace(replace(lower(trim(regexp_replace(translate(text, '*#', ''), '[\x20\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{2028}\x{2029}]+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')) as normal_sha256, sha256(text) as text_sha256,
  case when length(c) > 180 then left(c, 179) || '…' else c end as preview,
  coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), ''), 'item') as slug
from (select *, trim(regexp_replace(text, '[\x20\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{2028}\x{2029}]+', ' ', 'g')) as c from documents)""")
def normalized_text(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.normalised(t), 256).alias("normal_sha256"), F.sha2(t, 256).alias("text_sha256"), text.preview(t).alias("preview"), text.slug(t).alias("slug"))


@query("""
with recursive labels_(i, n, label) as (select p_partkey, p_partkey, '' from part union all select i, n // 26 - 1, chr((65 + n % 26)::int) || label from labels_ where n >= 0)
select i as id, label from labels_ where n < 0""")
def column_labels(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.column_label(F.col("p_partkey")).alias("label"))


@query(_CELLS + """,
e as (select doc, tab, r, string_agg(replace(replace(value, '|', chr(92) || '|'), chr(10), '<br>'), ' | ' order by c) as line from cells group by doc, tab, r)
select doc, tab, '| ' || (array_agg(line order by r))[1] || ' |' || chr(10) || '| --- | --- | --- | --- |' || coalesce(chr(10) || string_agg('| ' || line || ' |', chr(10) order by r) filter (r > 1), '') as markdown from e group by doc, tab""")
def grid_markdown(spark, sf):
    rows = view(spark, sf, "cells").groupBy("doc", "tab", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "value"))), lambda x: x["value"]).alias("row"))
    grids = rows.groupBy("doc", "tab").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("rows"))
    return grids.select("doc", "tab", grid.markdown(F.col("rows")).alias("markdown"))


@query("""
select user_id as doc, event_type as task, count(*) > 0 and bool_or(event_id % 3 = 0 and event_id % 5 > 0) as hit from events group by user_id, event_type""")
def cache_hits(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("task"), "event_id")
    wanted = e.select("doc", "task").distinct().withColumn("signature", memo.signature(F.col("doc"), F.col("task")))
    states = e.withColumn("signature", memo.signature(F.col("doc"), F.col("task"))).withColumn("status", F.when(F.col("event_id") % 3 == 0, "completed").otherwise("failed")).withColumn("n_outputs", F.col("event_id") % 5)
    return memo.cache_hits(wanted, states)


@query("""
select o_orderkey as doc, case when o_orderstatus <> 'O' then 'not completed' when o_custkey % 4 = 0 then 'validation failed' when o_custkey % 5 = 0 then 'no hash' when o_custkey % 6 = 0 then 'source changed' when o_custkey % 7 = 0 then 'empty output' end as reason from orders""")
def completed_reason(spark, sf):
    c = F.col("o_custkey")
    runs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderstatus") == "O", "completed").alias("status"), (c % 4 != 0).alias("valid"), F.when(c % 5 != 0, c).alias("stored"), F.when(c % 6 == 0, -1).otherwise(c).alias("actual"), (c % 7).alias("size"))
    return memo.completed_reason(runs)


@query(_CELLS.replace("with ", "with recursive ", 1) + """,
k as (select doc, tab, r, c, trim(value) as v from cells where trim(value) <> ''),
e as (select a.doc, a.tab, a.r, a.c, b.r as r2, b.c as c2 from k a join k b on a.doc = b.doc and a.tab = b.tab and a.v = b.v and abs(a.r - b.r) + abs(a.c - b.c) = 1),
reach(doc, tab, r, c, r2, c2) as (select * from e union select x.doc, x.tab, x.r, x.c, e.r2, e.c2 from reach x join e on e.doc = x.doc and e.tab = x.tab and e.r = x.r2 and e.c = x.c2),
root as (select doc, tab, r, c, min(r2 * 10 + c2) as root from reach group by doc, tab, r, c)
select doc, tab, r, c, ((dense_rank() over (partition by doc, tab order by root) - 1) % 4)::int as tone from root""")
def repeated_cells(spark, sf):
    return audit.repeated_cells(view(spark, sf, "cells"))


@query("""
select o_orderkey as id, case when o_custkey % 3 = 1 then '[[' || o_orderkey || ',' || (o_orderkey + 1) || '],[' || (o_orderkey + 2) || ']]' end as groups from orders""")
def planner_groups(spark, sf):
    p, c = F.col("o_orderkey").cast("int"), F.col("o_custkey")
    said = F.format_string('So: {"groups": [[%d, %d], [%d]]} as asked', p, p + 1, p + 1 + (c % 3).cast("int"))
    asked = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(p, p + 1, p + 2).alias("pages"), said.alias("text"))
    return replies.merge_groups(asked).select("id", F.to_json("groups").alias("groups"))


@query("""
with d as (select o_orderkey as doc, case when o_custkey % 11 = 0 then 2 else 3 end as version, case when o_custkey % 7 = 0 then 2 when o_custkey % 7 = 1 then 0 else 1 end as kind, o_custkey as c from orders),
b as (select doc, 'version' as rule from d where version <> 3
  union all select doc, 'page_markers' from d where kind = 0 or kind = 2
  union all select doc, 'not_empty' from d where kind = 0
  union all select doc, 'table_markers' from d where kind = 0 or c % 5 = 0 union all select doc, 'table_end_markers' from d where kind = 0
  union all select doc, 'placeholder' from d where kind <> 0 and c % 13 = 0 union all select doc, 'merged_range' from d where kind = 2)
select doc, rule, 'error' as severity, case when rule = 'merged_range' then '3-4' else doc::varchar end as subject from b""")
def validate_markers(spark, sf):
    """Documents of four pages, whose third is a table's second; some lack text, a marker, or say the wrong range."""
    c = F.col("o_custkey")
    n = lambda s: F.lit("\n\n" + s)
    whole = F.concat(
        F.lit("<!-- page:1 -->"), n("<!-- page:2 -->"), F.when(c % 5 == 0, "").otherwise(n("<!-- table:t page:2 -->")), n("| a |"), n("<!-- /table:t page:3 -->"),
        F.when(c % 7 == 2, n("<!-- page:3 -->")).otherwise(n("<!-- pages:3-3 merged-into:t -->")), n("<!-- page:4 -->"), F.when(c % 13 == 0, n("<!-- image -->")).otherwise(""),
    )
    wrong = F.replace(whole, F.lit("<!-- pages:3-3 merged"), F.lit("<!-- pages:3-4 merged"))
    said = F.when(c % 7 == 1, " \n").when(c % 7 == 0, wrong).otherwise(whole)
    orders = read(spark, sf, "orders").withColumn("doc", F.col("o_orderkey"))
    docs = orders.select("doc", F.when(c % 11 == 0, 2).otherwise(3).alias("version"), F.lit(4).alias("page_count"), F.lit(None).cast("array<int>").alias("selected"), said.alias("markdown"))
    tables = orders.select("doc", F.lit("t").alias("id"), F.lit(2).alias("page"), F.lit(1.0).alias("top"), F.lit(0).alias("page_table_index"), F.array(F.lit(2), F.lit(3)).alias("pages"))
    images = orders.limit(0).select("doc", F.lit("i").alias("id"), F.lit(1).alias("page"), F.lit(1).alias("pos"), F.lit("x").alias("image"), F.lit(True).alias("included"))
    return validate.document_issues(docs, tables, images)


_RECORDS = """recs as (select floor(o_orderkey / 3)::bigint as doc, 't' || (o_orderkey % 3) as id, o_custkey as c, o_orderkey % 3 as k from orders),
lay as (select doc, 'l' || k as layout_id, case when c % 5 = 0 then 'ambiguous_continuation' else 'replaced' end as status, case when c % 4 = 0 then null when c % 6 = 1 then 't9' else 't' || k end as replacement from recs)"""


@query("with " + _RECORDS + """
select doc, 'ambiguous_continuation' as rule, 'warning' as severity, layout_id as subject from lay where status = 'ambiguous_continuation'
union all select doc, 'unknown_table', 'warning', replacement || ' ' || layout_id from lay where replacement = 't9'
union all select r.doc, 'unknown_layout_table', 'warning', r.id || ' l' || (k + 7) from recs r where c % 7 = 3
union all select r.doc, 'lineage_one_sided', 'warning', r.id || ' l' || k from recs r join lay l on l.doc = r.doc and l.layout_id = 'l' || k where c % 7 <> 3 and c % 10 <> 9 and l.replacement is distinct from r.id
union all select r.doc, 'lineage_one_sided_back', 'warning', r.id || ' l' || k from recs r join lay l on l.doc = r.doc and l.layout_id = 'l' || k where (c % 7 = 3 or c % 10 = 9) and l.replacement = r.id""")
def validate_lineage(spark, sf):
    c, k = F.col("o_custkey"), (F.col("o_orderkey") % 3).cast("string")
    orders = read(spark, sf, "orders").withColumn("doc", F.floor(F.col("o_orderkey") / 3))
    own, other = F.concat(F.lit("l"), k), F.concat(F.lit("l"), (F.col("o_orderkey") % 3 + 7).cast("string"))
    ids = F.when(c % 7 == 3, F.array(other)).when(c % 10 == 9, F.array().cast("array<string>")).otherwise(F.array(own))
    tables = orders.select("doc", F.concat(F.lit("t"), k).alias("id"), ids.alias("layout_ids"))
    replaced = F.when(c % 4 == 0, F.array().cast("array<string>")).when(c % 6 == 1, F.array(F.lit("t9"))).otherwise(F.array(F.concat(F.lit("t"), k)))
    layout = orders.select("doc", own.alias("layout_id"), F.when(c % 5 == 0, "ambiguous_continuation").otherwise("replaced").alias("status"), replaced.alias("replacements"), F.array().cast("array<string>").alias("candidates"))
    return validate.lineage_issues(tables, layout)


@query("""
with i as (select o_orderkey as doc, o_custkey as c from orders)
select doc, 'analysis_failed' as rule, 'warning' as severity, 'i1' as subject from i where c % 8 = 0
union all select doc, 'chart_status', 'error', 'i1' from i where c % 3 = 1 and c % 4 = 2 union all select doc, 'chart_outside', 'error', 'i1' from i where c % 3 = 1 and c % 9 = 4
union all select doc, 'chart_without_csv', 'error', 'i1' from i where c % 3 <> 1 and c % 4 <> 2 union all select doc, 'image_missing', 'error', 'i1' from i where c % 10 = 0
union all select doc, 'chart_missing', 'error', 'i1' from i where c % 3 = 1 and c % 9 <> 4 and c % 5 = 0""")
def validate_images(spark, sf):
    c = F.col("o_custkey")
    orders = read(spark, sf, "orders").withColumn("doc", F.col("o_orderkey"))
    chart = F.when(c % 9 == 4, "assets/other/i1.csv").otherwise("assets/chart-tables/i1.csv")
    images = orders.select("doc", F.lit("i1").alias("id"), F.lit("assets/images/i1.png").alias("image"), F.when(c % 8 == 0, "failed").otherwise("completed").alias("analysis_status"), F.when(c % 4 == 2, "not_convertible").otherwise("exact").alias("chart_status"), F.when(c % 3 == 1, chart).alias("chart_csv"))
    files = orders.where(c % 10 != 0).select("doc", F.lit("assets/images/i1.png").alias("path")).unionByName(orders.where(c % 5 != 0).select("doc", F.lit("assets/chart-tables/i1.csv").alias("path")))
    return validate.image_issues(images, files)


@query(sql_of("page_sizes") + """
select id, x0, top, x1, bottom, case when x0 >= x1 or top >= bottom then 'empty' when x0 < 0 or top < 0 or x1 > width or bottom > height then 'outside' end as problem
from (select id, width, height, (id * 7 % 600)::double as x0, (id * 3 % 500)::double as top, (id * 7 % 600 + id % 900 - 50)::double as x1, (id * 3 % 500 + 400)::double as bottom from page_sizes)""")
def box_problems(spark, sf):
    p, i = view(spark, sf, "page_sizes"), F.col("id")
    b = p.select("id", "width", "height", (i * 7 % 600).cast("double").alias("x0"), (i * 3 % 500).cast("double").alias("top"), (i * 7 % 600 + i % 900 - 50).cast("double").alias("x1"), (i * 3 % 500 + 400).cast("double").alias("bottom"))
    return b.select("id", "x0", "top", "x1", "bottom", regions.box_problem(G.box(), F.col("width"), F.col("height")).alias("problem"))
