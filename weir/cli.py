"""python -m weir.cli: run a graph file on bounded input, list and run the queries, or control a running application.

A graph file is a Python module with ``build(spark) -> Graph``.
"""

from __future__ import annotations

import argparse
import runpy

from pyspark.sql import SparkSession

from weir import queries
from weir.errors import GraphError
from weir.plans.compile import run_batch
from weir.streaming.control import ControlTable


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weir", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("queries", help="list the queries")
    q = verbs.add_parser("query", help="run a query")
    q.add_argument("name")
    q.add_argument("folder", help="folder of the tables")
    r = verbs.add_parser("run", help="run a graph file and write its sinks")
    r.add_argument("file")
    r.add_argument("--out", help="folder for the sinks, as Parquet; shown if not given")
    r.add_argument("--alternate", action="append", default=[], metavar="NODE=NAME", help="active alternate of a dynamic node")
    r.add_argument("--scale", action="append", default=[], metavar="NODE=N", help="instances of a node")
    for verb, what, values in (("signal", "send a payload to a node", ["node", "value"]), ("switch", "choose an alternate of a node", ["node", "value"]), ("scale", "more or fewer instances of a node", ["node", "value"]), ("kill", "stop an application", []), ("status", "what an application last reported", [])):
        v = verbs.add_parser(verb, help=what)
        v.add_argument("folder", help="control folder of the engine")
        v.add_argument("app")
        for x in values:
            v.add_argument(x)
    verbs.add_parser("version")
    return top


def control(args: argparse.Namespace) -> int:
    """Talks to a running engine through its control folder."""
    table = ControlTable(args.folder)
    if args.verb == "status":
        found = table.reported(args.app)
        print(found or f"no application {args.app}")
        return 0 if found else 1
    if args.verb == "kill":
        table.send(args.app, "", "kill", None)
    else:
        kind = "alternate" if args.verb == "switch" else args.verb
        table.send(args.app, args.node, kind, int(args.value) if kind == "scale" else args.value)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "version":
        print("weir 0.1")
        return 0
    if args.verb == "queries":
        print("\n".join(queries.QUERIES))
        return 0
    if args.verb in ("signal", "switch", "scale", "kill", "status"):
        return control(args)
    spark = SparkSession.builder.appName("weir").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.verb == "query":
            queries.QUERIES[args.name](spark, args.folder).show(50, truncate=False)
            return 0
        graph = runpy.run_path(args.file)["build"](spark)
        for x in args.alternate:
            node, _, name = x.partition("=")
            graph.nodes[node].use(name)
        for x in args.scale:
            node, _, n = x.partition("=")
            graph.nodes[node].parallelism(int(n))
        for name, df in run_batch(graph, spark).items():
            if args.out:
                df.write.mode("overwrite").parquet(f"{args.out}/{name}")
            else:
                df.show(50, truncate=False)
        return 0
    except GraphError as e:
        print(f"{type(e).__name__}: {e}")
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
