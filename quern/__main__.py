"""Command line: ``python -m quern query NAME FOLDER`` | ``bench FOLDER`` | ``stat FOLDER`` | ``backfill FOLDER OUT`` | ``random N DIM OUT``."""

from __future__ import annotations

import argparse
import sys

from quern.session import local_session


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="shows a registered query")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--rows", type=int, default=20)
    b = sub.add_parser("bench", help="measurement protocol over the vectors of a folder")
    b.add_argument("folder")
    b.add_argument("--engine", default="exact", choices=["exact", "two-stage", "graph", "auto"])
    b.add_argument("--k", type=int, default=10)
    b.add_argument("--sweep", default="64,128")
    b.add_argument("--concurrency", default="1")
    b.add_argument("--seconds", type=float, default=3.0)
    for name in ("stat", "backfill"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        if name == "backfill":
            s.add_argument("out")
    r = sub.add_parser("random", help="writes random vectors as parquet")
    r.add_argument("n", type=int)
    r.add_argument("dim", type=int)
    r.add_argument("out")
    a = p.parse_args(argv)
    spark = local_session()
    from quern.plans import core, harness, search, settings, threads

    queries = {**core.QUERIES, **search.QUERIES, **threads.QUERIES}
    if a.command == "query":
        queries[a.name](spark, a.folder).show(a.rows, truncate=False)
    elif a.command == "stat":
        threads.store_stats(spark, a.folder).show(truncate=False)
    elif a.command == "backfill":
        threads.tree_backfill(spark, a.folder).write.parquet(a.out)
    elif a.command == "random":
        from quern.sources.binary import random_vectors

        random_vectors(spark, a.n, a.dim).write.parquet(a.out)
    else:
        base = search._vectors(spark, a.folder)
        held = base.where("vec_id % 100 = 0")
        engines = {"exact": harness.ExactEngine, "two-stage": harness.TwoStageEngine, "graph": harness.GraphEngine, "auto": harness.AutoEngine}
        rows = harness.run_protocol(engines[a.engine](search.DIM), base.where("vec_id % 100 <> 0"), held, a.k, tuple(settings.parse_ints(a.sweep, 1)), tuple(settings.parse_ints(a.concurrency, 1)), a.seconds, dataset=a.folder, path=a.folder)
        print(harness.emit(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
