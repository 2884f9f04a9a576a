"""Join the head of a ranking (a top-k report, a page) with its dimension
rows without joining the whole ranked table.

Spark cannot push a LIMIT through an inner join, so "join, then take the
first k" shuffles every row for k results.  Here the first k rows are taken
first (top-k per task) and written; only they are joined with the dimension.
That equals join-then-limit exactly when every head row finds exactly one
dimension row.  One aggregate per key checks it; if a key is NULL, unmatched
or matched twice, the result is ``None`` and the caller joins first.

The path is the same for every k.  Nothing is collected but the outcome of
the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.session import materialize


def join_head(head: DataFrame, dim: DataFrame, key: str) -> DataFrame | None:
    top = materialize(head, "head")
    # The head is a written table of known size: Catalyst broadcasts it when
    # it is under the threshold, so the dimension is scanned but not moved.
    joined = materialize(top.join(dim, key), "head_joined")
    want = top.groupBy(key).agg(F.count(F.lit(1)).alias("_want"))
    got = joined.groupBy(key).agg(F.count(F.lit(1)).alias("_got"))
    wrong = want.join(got, key, "left").filter(F.col("_got").isNull() | (F.col("_got") != F.col("_want")))
    return None if wrong.limit(1).count() else joined
