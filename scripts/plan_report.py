"""Write PLANS.md: the condensed physical plan of each headline query.

Broadcast joins are limited to 64 KB, so the plans show what runs on large inputs: only facts
per language and other tables that do not grow with the rows are joined map-side. Only the operators that decide cost are kept: exchanges,
joins, windows, aggregates, generators, Python evaluation and scans.

usage: python scripts/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "Join", "Window", "Aggregate", "Generate", "ArrowEval", "MapInPandas", "Scan", "Sort ")


def condensed(plan: str) -> list[str]:
    out = []
    for line in plan.split("== Initial Plan ==")[0].splitlines():
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            line = re.sub(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*\], ", "", line)
            out.append(line.rstrip()[:220])
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from bench import HEADLINE
    from babelqa.plans.queries import QUERIES
    from babelqa.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64k")
    parts = ["# Physical plans of the headline queries\n",
             "Generated by `scripts/plan_report.py` (AQE final plans, broadcast joins limited to 64 KB "
             "to show the large-input shape). Expression ids are "
             "removed.\n"]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        lines = condensed(df._jdf.queryExecution().executedPlan().toString())
        shuffles = sum(1 for ln in lines if "Exchange" in ln and "Reused" not in ln)
        parts.append(f"\n## `{name}` ({shuffles} exchanges)\n\n```\n" + "\n".join(lines) + "\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("".join(parts))


if __name__ == "__main__":
    main()
