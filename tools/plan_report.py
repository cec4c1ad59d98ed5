"""Summarise the physical plans of registered queries into PLANS.md.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
The shop tables are derived from the driver tables and stored as Parquet first,
as a deployment has them. For each query: number of shuffles, join strategies,
windows, scans with the filters pushed into them and the columns they read.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = ["monthly_sales_trend", "category_seasonality", "promotion_impact", "product_counts_cross_year",
        "item_sales_fact", "apply_filters", "promotion_metrics", "rotation_metrics",
        "product_counts_year", "basket_pairs", "basket_pairs_brand", "basket_lift_display", "rotation_distribution",
        "discount_sensitivity", "seasonal_decompose"]


def summarise(df) -> str:
    txt = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    tree = txt.split("\n\n")[0]
    ops = Counter(re.findall(r"(Exchange|BroadcastExchange|SortMergeJoin \w+|BroadcastHashJoin \w+|"
                             r"BroadcastNestedLoopJoin \w+|Window|Generate|HashAggregate|Scan \w+)", tree))
    out = ["operators: " + ", ".join(f"{k} x{v}" for k, v in sorted(ops.items()))]
    for block in txt.split("\n\n"):
        if re.search(r"^\(\d+\) Scan parquet", block.strip()):
            loc = re.search(r"/([\w.]+\.parquet)\]", block)
            pf = re.search(r"PushedFilters: (\[.*\])", block)
            rs = re.search(r"ReadSchema: (.*)", block)
            out.append(f"scan `{loc.group(1) if loc else '?'}` pushed={pf.group(1) if pf else '[]'} "
                       f"reads={rs.group(1) if rs else '?'}")
    return "\n".join("    " + line for line in out)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from tallyloom.session import get_session
    spark = get_session("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    from tallyloom.plans.registry import PLANS
    from tallyloom.sources.tables import open_tables, shop_tables_from_tpch
    stored = tempfile.mkdtemp(prefix="shop-tables-")
    for name, df in shop_tables_from_tpch(spark, sf_dir).items():
        df.write.parquet(f"{stored}/{name}.parquet")
    tables = open_tables(spark, stored)
    print("# Physical plans (initial adaptive plans)\n")
    print(f"Generated by `python tools/plan_report.py {sf_dir}` on stored shop tables. Broadcast choices at this scale come "
          "from file-size statistics; at cluster scale the same joins plan as sort-merge joins that AQE "
          "may turn into broadcast joins after measuring the shuffled side.\n")
    for k in KEYS:
        print(f"## {k}\n")
        print(summarise(PLANS[k](tables)))
        print()


if __name__ == "__main__":
    main()
