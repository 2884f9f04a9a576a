import datetime as dt
import os

from pyspark.sql import functions as F

from tillpoint.functions.expr import (full_name, is_blank, normalize_status, parse_lenient_timestamp,
                                      trim_ws, whole_days_between)
from tillpoint.plans import analytics as A
from tillpoint.sources import tables


def test_save_load_views_and_sql(spark, seed, scratch):
    root = os.path.join(scratch, "retail")
    tables.save(seed, root)
    t = tables.load(spark, root)
    assert t.orders.count() == 20 and t.order_items.count() == 30
    tables.register_views(t, prefix="rt_")
    got = tables.sql(spark, "SELECT revenue FROM rt_monthly_revenue_summary WHERE month = :m",
                     {"m": dt.datetime(2023, 10, 1)}).first()
    assert str(got.revenue) == "289.96"
    assert tables.sql(spark, "SELECT count(*) AS n FROM rt_product_sales_ranking").first().n == 17
    assert [r.customer_id for r in A.top_customers(t, 2).collect()] == [6, 1]


def test_expressions(spark):
    df = spark.createDataFrame(
        [("  Shipped\t", "SHIPPED", "2024-03-01", "Ana", "Silva"),
         ("   ", "lost", "03/15/2024", None, "X"),
         (None, None, "2024-02-30", "A", "B"),
         ("x", "Pending", "2024", "A", "B"),
         ("y", "pending", "2024-03-01T10:30:00+02:00", "A", "B"),
         ("z", "pending", "2024/03/09", "A", "B")],
        "s string, st string, d string, first_name string, last_name string")
    r = df.select(trim_ws("s").alias("t"), is_blank(F.col("s")).alias("b"),
                  normalize_status(F.col("st")).alias("n"), parse_lenient_timestamp(F.col("d")).alias("ts"),
                  full_name().alias("fn")).collect()
    assert [x.t for x in r] == ["Shipped", "", None, "x", "y", "z"]
    assert [x.b for x in r] == [False, True, True, False, False, False]
    assert [x.n for x in r] == ["shipped", None, None, "pending", "pending", "pending"]
    assert r[0].ts == dt.datetime(2024, 3, 1) and r[1].ts == dt.datetime(2024, 3, 15)
    assert r[2].ts is None and r[3].ts is None
    assert r[4].ts == dt.datetime(2024, 3, 1, 8, 30) and r[5].ts == dt.datetime(2024, 3, 9)
    assert r[1].fn is None and r[0].fn == "Ana Silva"
    days = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1)),
                                  (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3, 0, 0, 1)),
                                  (dt.datetime(2024, 1, 3, 1), dt.datetime(2024, 1, 1))], "a timestamp, b timestamp")
    got = [x[0] for x in days.select(whole_days_between(F.col("b"), F.col("a"))).collect()]
    assert got == [0, 2, -2]


def test_release_scratch(spark):
    import os as _os

    from tillpoint.session import materialize, release_scratch, scratch_mark
    mark = scratch_mark()
    df = materialize(spark.range(10), "probe")
    path = df.inputFiles()[0]
    assert df.count() == 10 and _os.path.exists(path.replace("file:", ""))
    assert release_scratch(spark, mark) == 1
    assert not _os.path.exists(path.replace("file:", ""))


def test_bucketed_layout_avoids_shuffle_for_order_item_joins(spark, seed):
    from tillpoint.plans import catalog as C
    tables.save_bucketed(seed, "tp_bucketed", buckets=4)
    t = tables.load_catalog(spark, "tp_bucketed")
    j = t.orders.join(t.order_items.withColumnRenamed("id", "item_id").withColumnRenamed("order_id", "id"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert C.order_detail_lines(t, order_ids=t.orders.select("id")).count() == 30
    assert [r.revenue for r in A.monthly_revenue_summary(t).collect()][0] == \
        [r.revenue for r in A.monthly_revenue_summary(seed).collect()][0]
