"""python -m sextant list | run NAME FOLDER [ROWS] | gate NAME FOLDER METRIC LEAST: queries from the command line.

gate ends with status 1 if the metric in the query's first row is under its least value.
"""

from __future__ import annotations

import json
import sys

from sextant.operators.evaluation import passes
from sextant.plans import catalog


def main(args: list[str]) -> int:
    known = catalog.queries()
    if args[:1] == ["list"]:
        print("\n".join(sorted(known)))
        return 0
    if len(args) < 3 or args[0] not in ("run", "gate") or args[1] not in known:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sextant").getOrCreate()
    df = known[args[1]](spark, args[2])
    if args[0] == "run":
        df.show(int(args[3]) if len(args) > 3 else 20, truncate=False)
        return 0
    row = df.first().asDict()
    print(json.dumps(row, default=str))
    return 0 if passes(row, float(args[4]), args[3]) else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
