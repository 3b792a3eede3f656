"""Run every report on landed token tables and write them as JSON records.

    python tools/run_reports.py --metadata P --scores P --owners P [--members P]
                                [--mint-events P] --out DIR

Tables are parquet with the schemas in ``seqlens/sources/schemas.py``; the
member list is JSON lines ``{"addr": ...}``.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqlens.plans.landed import read_landed, report_set  # noqa: E402
from seqlens.session import get_session  # noqa: E402
from seqlens.sources.readers import read_members, read_mint_events  # noqa: E402
from seqlens.sources.sinks import BLOCK_RANGE, write_report  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    for name in ("metadata", "scores", "owners", "out"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--members")
    ap.add_argument("--mint-events")
    a = ap.parse_args()
    spark = get_session()
    tables = read_landed(spark, a.metadata, a.scores, a.owners)
    members = read_members(spark, a.members) if a.members else None
    mints = read_mint_events(spark, a.mint_events) if a.mint_events else None
    # folders landed by sinks.land_mint_events are pruned by their block range
    for name, df in report_set(tables, members, mints, mints={"block_range": BLOCK_RANGE}).items():
        write_report(df, os.path.join(a.out, name))
        print(name)
    spark.stop()


if __name__ == "__main__":
    main()
