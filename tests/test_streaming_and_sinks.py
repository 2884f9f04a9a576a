import json
import os

from seed import SAMPLE_FEED
from tillpoint.plans import analytics as A
from tillpoint.sources.sinks import to_json_documents
from tillpoint.sources.store import RunStore
from tillpoint.streaming.feed_watch import watch_feed_directory


def test_json_documents_use_camel_case(seed):
    doc = json.loads(to_json_documents(A.monthly_revenue_summary(seed)).first()["value"])
    assert set(doc) == {"month", "orderCount", "revenue", "avgOrderValue", "prevMonthRevenue", "momGrowthPct"}
    assert doc["prevMonthRevenue"] is None and doc["momGrowthPct"] is None
    assert doc["orderCount"] == 3


def test_file_drop_directory(spark, seed, scratch):
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox)
    lines = SAMPLE_FEED.strip().split("\n")
    with open(os.path.join(inbox, "a.csv"), "w") as f:
        f.write("\n".join(lines[:6]) + "\n")
    with open(os.path.join(inbox, "b.csv"), "w") as f:
        f.write("\n".join([lines[0]] + lines[6:]) + "\n")
    store = RunStore(spark, os.path.join(scratch, "store"))
    results = []
    q = watch_feed_directory(spark, inbox, lambda: seed, store, checkpoint=os.path.join(scratch, "ck"),
                             available_now=True, max_files_per_trigger=1, on_result=results.append)
    q.awaitTermination(300)
    assert sorted(r.records_loaded for r in results) == [5, 5]
    assert store.table("orders").count() == 10
    assert store.table("etl_run_log").count() == 2
