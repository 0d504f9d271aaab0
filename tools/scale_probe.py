"""Compare whole-table ordered operators at a larger row count than the test tables.

    python tools/scale_probe.py [--sf /root/testdata/sf0.1] [--times 100] [--cpus 8]

``events`` is amplified ``--times`` fold (each row repeated with a copy number, values
perturbed by the copy number so they stay distinct) and materialised once; then the
built-in single-partition window / ``percentile`` and the distributed operators of
``quarry.operators.rank`` run on the same data. Prints one JSON line of seconds.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quarry.operators.rank import exact_quantiles, ntile  # noqa: E402
from quarry.session import get_spark, scratch_path  # noqa: E402
from quarry.sources.tables import read_table  # noqa: E402


def timed(fn):
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 2)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--times", type=int, default=100)
    ap.add_argument("--cpus", type=int, default=8)
    a = ap.parse_args()
    spark = get_spark(f"local[{a.cpus}]", a.cpus)
    ev = read_table(spark, a.sf, "events").select("event_id", "value")
    big = (ev.select("event_id", "value", F.explode(F.sequence(F.lit(0), F.lit(a.times - 1))).alias("copy"))
             .select((F.col("event_id") * a.times + F.col("copy")).alias("k"),
                     (F.col("value") + F.col("copy") / 1000.0).alias("v")))
    path = scratch_path(spark, "scale-probe")
    big.repartition(a.cpus * 4).write.parquet(path)
    data = spark.read.parquet(path)
    n = data.count()
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    out = {"rows": n, "cpus": a.cpus}
    out["ntile_builtin_single_partition"] = timed(lambda: noop(data.withColumn("t", F.ntile(4).over(Window.orderBy("v", "k")))))
    out["ntile_distributed"] = timed(lambda: noop(ntile(data, 4, ["v", "k"], "t")))
    out["percentile_builtin"] = timed(lambda: data.agg(F.percentile("v", 0.5), F.percentile("v", 0.9)).collect())
    out["exact_quantiles_distributed"] = timed(lambda: exact_quantiles(data, "v", {"m": 0.5, "p9": 0.9}).collect())
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
