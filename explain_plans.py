"""Write PLANS.md: the executed (post-AQE) physical plans of the headline queries.

Usage: python explain_plans.py [sf_dir]   (default /root/testdata/sf0.1)
For each query the plan tree is kept, plus the scan details (partition and
pushed filters, read schema).
"""

from __future__ import annotations

import sys

from longstats.plans.queries import QUERIES
from longstats.session import build_session

HEADLINE = {
    "rollup_county": "one-pass roll-up (materialised) read back, anti join against the redundant-total list",
    "rollup_state": "state rows of the same roll-up, semi join against the known county classes",
    "rollup_level": "a single-level roll-up straight from the landed table: pruning, pushdown, partial aggregation",
    "residual_left": "state minus county sums: aggregate + left join",
    "tidy_table": "known counties UNION ALL residual counties",
    "yield_trend": "flagship: trend over the tidy table",
    "grand_total": "grand total as a scalar subquery (no join, no unpartitioned window)",
    "partition_total": "partition totals as aggregate + join back (no hot-key window)",
    "state_profile": "coverage arrays over distinct (state, year, commodity) triples",
    "level_totals": "grouping sets over the finest sums: Expand repeats groups, not rows",
    "snapshot_summary": "two loads compared by hash and count: one shuffle of hashes, no row fetched",
    "top_counties": "window group limit in every task before the shuffle",
    "running_area": "running totals over ranges: windows by series and range, offsets per series and range",
    "dimension_join": "rows without a key set apart, the others a left join by the text code",
}


def plan_text(df) -> str:
    """Final adaptive plan after running the query itself (``*(n)`` marks a
    whole-stage-codegen stage), one line per node, plus the scan details."""
    df.collect()
    qe = df._jdf.queryExecution()
    tree = []
    for line in qe.executedPlan().toString().split("\n"):
        if line.strip().startswith(("Final Plan", "Initial Plan")) or not line.strip():
            continue
        if "Initial Plan" in line:
            break
        node = line.split("(keys=")[0].split(" [")[0].split(", [")[0]
        tree.append(node[:150])
    jvm = df.sparkSession._jvm
    formatted = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(qe, "formatted")
    details = formatted.partition("\n\n\n")[2]
    keep = ("PartitionFilters", "PushedFilters", "ReadSchema")
    scan_lines = []
    for block in details.split("\n\n"):
        lines = block.split("\n")
        if " Scan " in lines[0]:
            scan_lines.append(lines[0])
            scan_lines += [line[:400] for line in lines[1:] if line.startswith(keep)]
    return "\n".join(tree) + "\n\n" + "\n".join(scan_lines)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    out = ["# Executed plans of the headline queries", "",
           f"Generated by `python explain_plans.py {sf_dir}` on local[8] with AQE on: the final adaptive plan of "
           "each query after it ran; `*(n)` marks operators fused into whole-stage-codegen stage n.", ""]
    for name, note in HEADLINE.items():
        out += [f"## {name}", "", note, "", "```", plan_text(QUERIES[name](spark, sf_dir)), "```", ""]
    with open("PLANS.md", "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
