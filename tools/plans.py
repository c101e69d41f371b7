"""Print the formatted physical plan of registered queries.

Usage: python tools/plans.py [sf_dir] name [name ...]
Shows where the scans prune columns / push filters, where the exchanges
(shuffles) and broadcasts are, and which stages are whole-stage codegen'd.
Queries whose fits run eagerly (models, tuning) execute those fits first.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from callsheet.plans import spark_queries  # noqa: E402
from callsheet.session import get_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_session()
    qs = spark_queries()
    for name in args or ["segment_rate", "common_features", "split_stratified"]:
        print(f"===== {name}")
        qs[name](spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
