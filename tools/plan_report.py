"""Summarise the physical plan of every registered query (for PLANS.md).

Usage: python tools/plan_report.py [SF_DIR] > PLANS.md
Per query: shuffle exchanges, broadcast exchanges, Python (Arrow) nodes, windows,
and for every Parquet scan its read schema and pushed filters.  Queries that run
their own jobs while being planned (streams, sinks, IVF training) are planned too;
only their final plan is summarised.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ragtide.plans.registry import load_all  # noqa: E402
from ragtide.session import get_session  # noqa: E402


def summarise(df) -> dict:
    spark = df.sparkSession
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    head = text.split("\n\n(1)")[0]
    return {
        "shuffles": len(re.findall(r"(?<!Broadcast)Exchange \(", head)),
        "broadcasts": len(re.findall(r"BroadcastExchange", head)),
        "python": len(re.findall(r"(?:ArrowEvalPython|MapInPandas|FlatMapCoGroupsInPandas)", head)),
        "windows": len(re.findall(r"\bWindow \(", head)),
        "scans": sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", text))),
        "pushed": sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", text) if p)),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    print("| query | shuffles | broadcasts | python nodes | windows | scan columns | pushed filters |")
    print("|---|---|---|---|---|---|---|")
    for name, q in load_all().items():
        try:
            s = summarise(q.fn(spark, sf))
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {type(e).__name__} | | | | | |")
            continue
        scans = "; ".join(s["scans"]).replace("|", "/")
        pushed = "; ".join(s["pushed"]).replace("|", "/")
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['python']} | {s['windows']} | {scans} | {pushed} |")


if __name__ == "__main__":
    main()
