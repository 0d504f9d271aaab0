"""Command line: list the registered analyses or run one.

    python -m quarry list
    python -m quarry run rfm_segments --sf /root/testdata/sf0.01 --show 10
    python -m quarry run month_revenue --sf s3a://bucket/sf100 --out s3a://bucket/out/month_revenue --format parquet

``run`` writes the full result to ``--out`` (distributed write, nothing collected) and/or
prints the first ``--show`` rows. ``--master`` is for local use; on a cluster submit with
``spark-submit -m quarry ...`` and the cluster's own settings.
"""

from __future__ import annotations

import argparse
import sys

from .plans.registry import COVERS, ORACLE, QUERIES, load_all


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quarry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered analyses with the SURVEY ids they cover")
    run = sub.add_parser("run", help="run one analysis")
    run.add_argument("name")
    run.add_argument("--sf", required=True, help="folder holding <table>.parquet")
    run.add_argument("--out", help="write the result here")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    run.add_argument("--show", type=int, default=0, help="print the first N rows")
    run.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    load_all()
    if a.cmd == "list":
        for name in sorted(QUERIES):
            tag = "sql" if name in ORACLE else "rows"
            print(f"{name:28s} {tag:5s} {COVERS.get(name, '')}")
        return 0

    if a.name not in QUERIES:
        print(f"unknown analysis {a.name!r}; see `python -m quarry list`", file=sys.stderr)
        return 2
    from .session import get_spark
    spark = get_spark(a.master)
    df = QUERIES[a.name](spark, a.sf)
    if a.out:
        if a.format == "csv":
            from .sources.csv import write_csv
            write_csv(df, a.out)
        else:
            df.write.mode("errorifexists").parquet(a.out)
    if a.show:
        df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
