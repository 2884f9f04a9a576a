"""Benchmark: headline queries and the feed load at $BENCH_SF_DIR
(default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Each query is run once to warm up and then timed REPEATS times (median);
the plan is executed fully with the no-op sink (``write.format('noop')``),
so nothing is collected to the driver.  The feed load reads a CSV derived
from the supplied tables (written once, untimed) and publishes into a
fresh run store each time.  Prints one JSON line.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillpoint.plans import analytics as A  # noqa: E402
from tillpoint.plans import catalog as C  # noqa: E402
from tillpoint.plans import feed_load as L  # noqa: E402
from tillpoint.plans import placement as P  # noqa: E402
from tillpoint.session import (get_session, release_scratch,  # noqa: E402
                               scratch_mark, scratch_path)
from tillpoint.sources.feed import write_order_feed  # noqa: E402
from tillpoint.sources.store import RunStore  # noqa: E402
from tillpoint.sources.testdata import bind, derive_feed  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
AS_OF = dt.datetime(2001, 9, 1)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, spark=None, since: int = 0) -> float:
    fn()
    samples = []
    for _ in range(REPEATS):
        t0 = time.perf_counter()
        fn()
        samples.append(time.perf_counter() - t0)
        if spark is not None:
            release_scratch(spark, since)     # intermediates of the finished run
    return round(statistics.median(samples), 3)


def main() -> None:
    spark = get_session(master=f"local[{CPUS}]", app="tillpoint-bench",
                        shuffle_partitions=int(CPUS) * 2,
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    t = bind(spark, SF_DIR)
    q = {
        "q1_monthly_revenue_summary": lambda: run(A.monthly_revenue_summary(t)),
        "q2_product_sales_ranking": lambda: run(A.product_sales_ranking(t)),
        "q3_top_products": lambda: run(A.top_products(t, 10)),
        "q4_customer_lifetime_value": lambda: run(A.customer_lifetime_value(t, as_of=AS_OF)),
        "q5_customer_stats": lambda: run(A.customer_stats(t, 20, as_of=AS_OF)),
        "q6_category_performance": lambda: run(A.category_performance(t)),
        "q7_sales_by_period": lambda: run(A.sales_by_period(t, dt.datetime(1997, 1, 1),
                                                           dt.datetime(1997, 12, 31))),
        "q8_top_customers": lambda: run(A.top_customers(t, 10)),
        "q10_orders_page": lambda: run(C.orders_page(t, 3, 20).items),
    }
    results = {name: timed(fn, spark) for name, fn in q.items()}

    feed_dir = scratch_path(spark, "bench_feed_csv")
    write_order_feed(derive_feed(spark, SF_DIR, t), feed_dir)

    def feed_load():
        store = RunStore(spark, scratch_path(spark, "bench_store"))
        L.load_feed(t, feed_dir, store)

    results["feed_load"] = timed(feed_load, spark, scratch_mark())   # keeps the feed CSV

    raw_o = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    raw_l = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    requests = P.requests_from_orders(t, raw_o, raw_l)
    results["place_orders"] = timed(lambda: run(P.place_orders(requests, t, placed_at=AS_OF).orders),
                                    spark, scratch_mark())
    release_scratch(spark)

    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": int(CPUS),
                      "repeats": REPEATS}))


if __name__ == "__main__":
    main()
