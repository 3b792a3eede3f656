"""Write report results as JSON records (one folder per report)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from seqlens.plans.catalog import QUERIES
from seqlens.sources.sinks import write_report

# The reports whose results the original publishes as data files.
PUBLISHED = ["experience_tiers", "within_player_improvement", "cohort_first_games",
             "skill_persistence"]


def export_reports(spark: SparkSession, sf_dir: str, out_dir: str,
                   names: list[str] | None = None, fmt: str = "json") -> dict[str, str]:
    """Run each report on the tables in ``sf_dir`` and write it under
    ``out_dir/<name>`` (keys in alphabetical order). Returns name -> path."""
    written = {}
    for name in names or PUBLISHED:
        path = os.path.join(out_dir, name)
        write_report(QUERIES[name](spark, sf_dir), path, fmt=fmt)
        written[name] = path
    return written
