"""Command line: names and runs of queries, whole conversions, single tasks and inspection of grids.

    python -m folioflow list | run QUERY TABLES OUT
    python -m folioflow list-tasks | convert INPUTS OUT [--pages 1,3-5] | run-task TASK INPUTS OUT | rerun-tables INPUTS OUT NEW
    python -m folioflow inspect CSV
"""

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .engine import INPUTS, Engine, tasks
from .options import Options
from .plans import catalogue
from .sources import readers


def inputs_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in INPUTS}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    commands.add_parser("list-tasks", help="tasks of a run in order")
    run = commands.add_parser("run", help="run one query over a folder of tables")
    run.add_argument("query", choices=sorted(catalogue.QUERIES))
    run.add_argument("tables")
    run.add_argument("out")
    for name, first in (("convert", ()), ("run-task", ("task",)), ("rerun-tables", ())):
        p = commands.add_parser(name)
        for a in (*first, "inputs", "out", *(("new",) if name == "rerun-tables" else ())):
            p.add_argument(a)
        p.add_argument("--batch-id", default="run")
        p.add_argument("--pages")
        p.add_argument("--force", action="store_true")
    inspect = commands.add_parser("inspect", help="shape and oddities of CSV files")
    inspect.add_argument("path")
    args = parser.parse_args(argv)
    if args.command in ("list", "list-tasks"):
        print("\n".join(sorted(catalogue.QUERIES) if args.command == "list" else [t.name for t in tasks(Options())]))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "run":
        catalogue.QUERIES[args.query](spark, args.tables).write.parquet(args.out)
    elif args.command == "inspect":
        for r in readers.csv_grids(spark, args.path, pad=False).selectExpr("path", "size(rows) as n_rows", "array_max(transform(rows, r -> size(r))) as width", "rows[0] as header").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        engine = Engine(spark, args.out, Options(pages=args.pages, batch_id=args.batch_id, force=args.force))
        result = engine.convert(inputs_of(spark, args.inputs), [args.task] if args.command == "run-task" else None)
        if args.command == "rerun-tables":
            docs = result.frames["docs"]
            result = engine.rerun_tables(result, spark.read.parquet(args.new), docs.limit(0).select("doc"), docs.selectExpr("doc", "sha256 as actual"))
        print(json.dumps(result.to_dict()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
