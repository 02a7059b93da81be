"""Adapter views: the engine's entities read from star-schema and text tables.

Coordinates are whole numbers, so that any engine computes the same overlaps.  The view bodies are
plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "blocks": """
select doc, page, cast(ord as int) as ord, kind, x0, top, x0 + width as x1, top + height as bottom, markdown from (
  select cast(floor(l_orderkey / 300) as int) as doc, cast(floor(l_orderkey / 3) as int) % 100 + 1 as page,
    row_number() over (partition by floor(l_orderkey / 3) order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord,
    case l_returnflag when 'A' then 'table' when 'R' then 'text' else case l_linenumber % 3 when 1 then 'picture' when 0 then 'caption' else 'section_header' end end as kind,
    cast(l_partkey % 400 as int) as x0, cast((l_suppkey * 37 + l_linenumber * 90) % 700 as int) as top,
    cast(60 + 4 * l_quantity as int) as width, cast(20 + l_partkey % 80 as int) as height,
    case when l_returnflag = 'A' then '| ' || case when l_suppkey % 4 = 0 then '1.' else 'Tab ' end || cast(l_partkey % 5 as varchar(9)) || ' Sum | ' || cast(l_suppkey as varchar(20)) || ' |'
      when l_returnflag <> 'R' and l_linenumber % 3 = 0 then case when l_suppkey % 4 = 0 then '**1.' else 'Tab ' end || cast(l_partkey % 5 as varchar(9)) || '  SUM'
      else 'Text ' || cast(l_partkey as varchar(20)) end as markdown
  from lineitem) b""",
    "agent_tables": """
select *, cast(row_number() over (partition by doc, page order by top, id) as int) as k from (
  select cast(floor(o_orderkey / 300) as int) as doc, o_orderkey as id, cast(floor(o_orderkey / 3) as int) % 100 + 1 as page, cast(o_custkey % 3 as int) as more,
    cast(o_custkey % 300 as int) as x0, cast((o_custkey * 7) % 500 as int) as top,
    cast(o_custkey % 300 + 220 as int) as x1, cast((o_custkey * 7) % 500 + 200 as int) as bottom
  from orders) t""",
    "detections": """
select cast(floor(o_orderkey / 100) as int) as doc, cast(o_orderkey % 100 + 1 as int) as page, o_custkey % 3 <> 0 as may_merge, o_orderstatus <> 'F' as has_table, cast(o_custkey % 2 as int) as estimate,
  cast(o_custkey % 40 as int) as lines_and_rects, o_custkey % 7 as tables_found, o_custkey % 9 as shift from orders""",
    "agent_events": """
select user_id % 50 as job, event_type as stage, event_id as seq, cast(get_json_object(props, '$.k') as bigint) as tokens from events""",
    "cells": """
select doc, page as tab, ord as r, c, value from (
  select doc, page, ord, 0 as c, kind as value from blocks union all select doc, page, ord, 1, cast(x0 as varchar(20)) from blocks
  union all select doc, page, ord, 2, cast(top as varchar(20)) from blocks union all select doc, page, ord, 3, case when ord % 5 = 0 then '' else kind end from blocks) g""",
    "page_sizes": """
select p_partkey as id, cast(300 + 60 * p_size as int) as width, cast(400 + p_partkey % 3000 as int) as height from part""",
}


#: Where a line item stands.  Windows by these columns, not by an expression, let what groups by page keep the exchange.
_PLACE = "cast(floor(l_orderkey / 300) as int) as doc, cast(floor(l_orderkey / 3) as int) % 100 + 1 as page"


def _columns(select: str) -> list[str]:
    """The columns of a SELECT, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in select.strip().removeprefix("select "):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _blocks(items: DataFrame, by: str | None) -> DataFrame:
    # column by column: the names of subqueries would hide from unions that both of their sides are dealt alike
    outer, inner = VIEWS["blocks"].removesuffix("\n  from lineitem) b").split(" from (\n", 1)
    inner = inner.replace(_PLACE, "doc, page").replace("partition by floor(l_orderkey / 3)", "partition by doc, page")
    placed = items.selectExpr("*", *_columns(_PLACE))
    return (placed.repartition(by) if by else placed).selectExpr(*_columns(inner)).selectExpr(*_columns(outer))


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """One adapter view over the tables of ``sf_dir``; columns prune down to the scan.

    Blocks and cells are dealt by page, or by column ``by``, once: cells are made of one pass over blocks."""
    source = {"blocks": "lineitem", "agent_tables": "orders", "detections": "orders", "agent_events": "events", "cells": "lineitem", "page_sizes": "part"}[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if source == "lineitem":
        blocks = _blocks(rows, by)
        if name == "blocks":
            return blocks
        values = "stack(4, 0, kind, 1, cast(x0 as string), 2, cast(top as string), 3, case when ord % 5 = 0 then '' else kind end) as (c, value)"
        return blocks.selectExpr("doc", "page as tab", "ord as r", values)
    return spark.sql(VIEWS[name].replace(f"from {source}", "from {t}"), t=rows)


def sql_of(*names: str) -> str:
    """The views as CTEs of another engine's SQL."""
    ctes = [f"{n} as ({VIEWS[n].replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')")})" for n in names]
    return "with " + ",\n".join(ctes)
