"""Pages from an order-statistics directory, against the full sort."""

import re

import pytest
from pyspark.sql import functions as F

from tillpoint.operators.page_directory import build_directory, open_directory
from tillpoint.operators.ranking import SortKey
from tillpoint.plans import catalog as C

KEYS = [SortKey("v", descending=True, nulls_first=True), SortKey("id")]


def rows(spark, n):
    # Few values, so ties cross the ranges; some nulls.
    return spark.range(n).select("id", F.when(F.col("id") % 11 != 0, F.col("id") % 7).alias("v"),
                                 F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_slices_equal_the_full_sort(spark, scratch, n):
    df = rows(spark, n)
    d = build_directory(df, KEYS, scratch + "/d", "kind", ranges=9)
    full = [tuple(r) for r in df.orderBy(*[k.expr() for k in KEYS]).collect()]
    again = open_directory(spark, scratch + "/d", df, KEYS, "kind")
    assert again.counts == d.counts and d.total() == n
    for offset, size in ((0, 7), (n // 2, 40), (max(n - 3, 0), 10), (n + 5, 10), (0, n), (13, 0)):
        assert [tuple(r) for r in again.slice(offset, size).collect()] == full[offset:offset + size]
        ours = [r for r in full if r[2] == "a"]
        assert [tuple(r) for r in d.slice(offset, size, "a").collect()] == ours[offset:offset + size]
    assert d.slice(0, 5, "none").count() == 0


def test_a_deep_page_reads_one_range(spark, scratch):
    d = build_directory(rows(spark, 2000), KEYS, scratch + "/d", "kind", ranges=10)
    page = d.slice(1800, 5)
    assert page.count() == 5
    before, holding = 0, []
    for r, _, n in sorted(d.counts):
        if before < 1805 and before + n > 1800:
            holding.append(r)
        before += n
    plan = page._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {int(x) for x in re.findall(r"\d+", re.sub(r"_range#\d+", "", filters))}
    assert read == set(holding) and len(read) <= 2
    assert max(n for _, _, n in d.counts) < 400


def test_arguments(spark, scratch):
    d = build_directory(rows(spark, 3), KEYS, scratch + "/d")
    for bad in ((-1, 5), (0, -1), (0, 1, "a")):
        with pytest.raises(ValueError):
            d.slice(*bad)


def test_pages_of_the_catalog(seed):
    def ids(df):
        return [r.id for r in df.collect()]
    orders, customers, products = C.orders_pages(seed, ranges=4), C.customers_pages(seed, ranges=4), C.products_pages(seed, ranges=4)
    for n in (1, 3, 5):
        for status in (None, "delivered"):
            want, got = C.orders_page(seed, n, 6, status), orders.page(n, 6, status)
            assert got.items.collect() == want.items.collect()
            assert (got.total_count, got.total_pages, got.has_next_page) == (want.total_count, want.total_pages, want.has_next_page)
        assert ids(customers.page(n, 4).items) == ids(C.customers_page(seed, n, 4).items)
        assert ids(products.page(n, 4, True).items) == ids(C.products_page(seed, n, 4).items)
        assert ids(products.page(n, 4).items) == ids(C.products_page(seed, n, 4, active_only=False).items)
    with pytest.raises(ValueError):
        orders.page(0, 6)
