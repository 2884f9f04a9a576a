"""Print the condensed physical plan of the headline queries: exchanges,
joins, aggregates, windows and scans (with pushed filters and read schema).

usage: python scripts/show_plans.py [sf_dir]
"""

from __future__ import annotations

import datetime as dt
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillpoint.plans import analytics as A  # noqa: E402
from tillpoint.plans import catalog as C  # noqa: E402
from tillpoint.session import get_session  # noqa: E402
from tillpoint.sources.testdata import bind  # noqa: E402

KEEP = ("Exchange", "Join", "HashAggregate", "Window", "TakeOrdered", "Scan", "Filter", "Union")


def condensed(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.split("\n"):
        if any(k in line for k in KEEP):
            line = re.sub(r"file:[^,\]]*/", "", line)
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            out.append(line[:220])
    return "\n".join(out)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session(master="local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    t = bind(spark, sf_dir)
    q = {
        "Q1 monthly_revenue_summary": lambda: A.monthly_revenue_summary(t),
        "Q2 product_sales_ranking (after the ranges are written)": lambda: A.product_sales_ranking(t),
        "Q3 top_products": lambda: A.top_products(t, 10),
        "Q4 customer_lifetime_value (after the ranges are written)": lambda: A.customer_lifetime_value(
            t, as_of=dt.datetime(2001, 9, 1)),
        "Q6 category_performance": lambda: A.category_performance(t),
        "Q7 sales_by_period": lambda: A.sales_by_period(t, dt.datetime(1997, 1, 1), dt.datetime(1997, 12, 31)),
        "Q5 customer_stats (head of the order aggregate, joined with customers)":
            lambda: A.customer_stats(t, 20, as_of=dt.datetime(2001, 9, 1)),
        "Q8 top_customers (head of the order aggregate, joined with customers)":
            lambda: A.top_customers(t, 10),
        "Q8 top_customers (country)": lambda: A.top_customers(t, 5, "NATION_7"),
        "Q10 orders_page": lambda: C.orders_page(t, 3, 20).items,
    }
    for name, fn in q.items():
        print(f"### {name}\n```text\n{condensed(fn())}\n```\n")


if __name__ == "__main__":
    main()
