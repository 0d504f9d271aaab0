"""Print the physical plan of registered queries.

    python tools/explain.py [--sf DIR] [--large] [--mode formatted|simple] name [name ...]

``--large`` turns automatic broadcast off, as if every driver table were far above the
broadcast threshold (what the plan looks like at cluster scale); explicit broadcasts of
bounded tables remain.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans.registry import QUERIES, load_all  # noqa: E402
from quarry.session import get_spark  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--large", action="store_true")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1"} if a.large else {}
    extra["spark.sql.maxMetadataStringLength"] = "400"
    spark = get_spark("local[8]", 8, extra=extra)
    load_all()
    for name in a.names:
        print(f"==== {name} ====")
        QUERIES[name](spark, a.sf).explain(a.mode)
    spark.stop()


if __name__ == "__main__":
    main()
