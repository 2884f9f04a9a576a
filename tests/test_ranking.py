"""Distributed rank / row_number / ntile / running sum equal the plain windows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillpoint.operators.ranking import SortKey, ntile_of, window_positions


@pytest.mark.parametrize("desc,nulls_first", [(True, True), (False, True), (True, False), (False, False)])
@pytest.mark.parametrize("groups", [(), ("g",)])
def test_paths_agree_with_hot_tie(spark, desc, nulls_first, groups):
    df = spark.range(0, 20000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 11).alias("v"),
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 5).alias("g"),
        (F.col("id") % 13).alias("x"))
    kw = dict(group_by=groups, tie_break=("id",), rank="r", row_number="rn", running_sum={"s": "x"},
              ntile=None if groups else ("nt", 4))
    keys = [SortKey("v", descending=desc, nulls_first=nulls_first)]
    a = sorted(map(tuple, window_positions(df, keys, force="window", **kw).collect()))
    b = sorted(map(tuple, window_positions(df, keys, force="distributed", **kw).collect()))
    assert a == b


@given(st.integers(min_value=1, max_value=80), st.integers(min_value=1, max_value=7))
@settings(max_examples=40, deadline=None)
def test_ntile_formula(n, k):
    expected = []
    q, m = divmod(n, k)
    for tile in range(1, k + 1):
        expected += [tile] * (q + (1 if tile <= m else 0))
    import pyspark.sql.functions as Fn  # noqa: F401
    got = [ntile_formula(r, n, k) for r in range(1, n + 1)]
    assert got == expected[:n]


def ntile_formula(r, n, k):
    q, m = divmod(n, k)
    big = m * (q + 1)
    return (r - 1) // (q + 1) + 1 if r <= big else m + (r - 1 - big) // max(q, 1) + 1


def test_ntile_expression_matches_formula(spark):
    df = spark.range(1, 60).select(F.col("id").alias("r"))
    got = [x[0] for x in df.select(ntile_of(F.col("r"), F.lit(59), 4)).collect()]
    assert got == [ntile_formula(r, 59, 4) for r in range(1, 60)]


@pytest.mark.parametrize("per_bucket", [7, 1000, 10**6])
def test_dense_ids_by_int_key(spark, per_bucket):
    from tillpoint.operators.ranking import dense_ids_by_int_key
    df = spark.range(0, 5000).select((F.col("id") * 3 + F.when(F.col("id") > 4000, 100000).otherwise(0))
                                     .alias("k"))
    got = sorted((r.k, r.i) for r in dense_ids_by_int_key(df, "k", "i", start=10,
                                                          target_rows_per_bucket=per_bucket).collect())
    assert [i for _, i in got] == list(range(10, 5010))


def test_distributed_path_on_empty_input(spark):
    df = spark.range(0).select("id", (F.col("id") % 3).alias("v"))
    out = window_positions(df, [SortKey("v", descending=True)], tie_break=("id",), rank="r",
                           row_number="rn", ntile=("nt", 4), running_sum={"s": "v"}, force="distributed")
    assert out.count() == 0 and {"r", "rn", "nt", "s"} <= set(out.columns)


def test_nested_ranks_match_plain_windows(spark):
    import random

    from tillpoint.operators.ranking import nested_ranks
    rng = random.Random(9)
    # Huge tie classes over many ranges, null values and groups, a group of one row.
    rows = [(i, rng.choice([None, 5, 5, 5, rng.randrange(40)]), rng.choice([1, 1, 1, 2, None])) for i in range(3000)] + [(9999, 5, 7)]
    df = spark.createDataFrame(rows, "id long, v int, g int")
    key = SortKey("v", descending=True, nulls_first=True)
    got = nested_ranks(df, key, "g", "id", "r", "rg")
    want = window_positions(window_positions(df, [key], rank="r", force="window"), [key], group_by=("g",), rank="rg", force="window")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert nested_ranks(df.limit(0), key, "g", "id", "r", "rg").count() == 0
