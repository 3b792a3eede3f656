"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query (the six reports and the three player-set queries)
to completion on ``local[BENCH_CPUS]`` and prints one JSON line with the
per-query wall time. Every query first runs once untimed (JIT warm-up of its
code paths), then ``BENCH_REPEAT`` times (default 3) in a rotated order; the best time is kept. Results are consumed
with a no-op write, so the timing covers the full plan but not a collect.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from seqlens.plans.catalog import QUERIES  # noqa: E402
from seqlens.session import get_session  # noqa: E402

HEADLINE = [
    "experience_tiers",            # Q1
    "learning_curve",              # Q2
    "within_player_improvement",   # Q3
    "cohort_first_games",          # Q4
    "cohort_learning_curve",       # Q5
    "skill_persistence",           # Q6 (flagship)
    "distinct_players",            # Q7
    "mint_event_players",          # Q8
    "veteran_overlap",             # Q9
]


def _run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "16g"})
    for name in HEADLINE:                      # warm-up (JIT, file listing)
        _run(spark, name, sf_dir)
    taken: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for r in range(repeat):                    # another order each time
        shift = r * len(HEADLINE) // max(repeat, 1)
        for name in HEADLINE[shift:] + HEADLINE[:shift]:
            taken[name].append(_run(spark, name, sf_dir))
    times = {name: round(min(t), 3) for name, t in taken.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
