"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "flagship", "agg_02", "agg_03", "flt_10", "flt_26", "win_01", "win_02", "jn_17", "jn_20", "jn_21", "red_10", "red_11", "red_13",
    "chk_01", "chk_02", "chk_03", "chk_04", "chk_20", "agg_11", "agg_12", "agg_19", "agg_26", "prj_01", "src_01", "src_03", "str_02",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from alertweft.plans import load_queries
    from alertweft.session import local_session

    spark = local_session(cores, "bench")
    queries = load_queries()[0]
    # one small query first, so start-up cost is not charged to whichever query comes first
    queries["flt_01"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
