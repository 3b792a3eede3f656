"""Write the published reports as JSON records.

    python tools/write_reports.py <sf_dir> <out_dir> [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqlens.plans.export import export_reports  # noqa: E402
from seqlens.session import get_session  # noqa: E402


def main() -> None:
    sf_dir, out_dir, names = sys.argv[1], sys.argv[2], sys.argv[3:] or None
    spark = get_session()
    for name, path in export_reports(spark, sf_dir, out_dir, names).items():
        print(name, path)
    spark.stop()


if __name__ == "__main__":
    main()
