"""Pages at any depth from an order-statistics directory.

``OFFSET n`` makes one task merge the n rows before the page.  Here the rows
are range-partitioned once by the page order and written with one folder
per range; a count per (range, filter value) is written beside them.  Prefix
sums of these counts tell which range holds the first row of a page and how many
rows of that range come before it, so a page reads one range (or neighbours, when it
crosses a border) by partition pruning, and no task ever holds more than
a range's rows.

The directory shows the rows as they were when it was built.  Nulls sort as
in the page order.  Only the counts reach the driver: one row per range and
value of the filter column, which must have few values (a status, a flag)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.operators.ranking import SortKey

RANGE = "_range"


def _order(keys: list[SortKey]) -> list[Column]:
    return [k.expr() for k in keys]


@dataclass(frozen=True)
class PageDirectory:
    rows: DataFrame
    keys: tuple[SortKey, ...]
    # (range, filter value, rows), ranges ascending.
    counts: tuple[tuple[int, object, int], ...]
    filter_column: str | None = None

    def total(self, value=None) -> int:
        """Rows of the directory (with that filter value, if given)."""
        return sum(n for _, v, n in self.counts if value is None or v == value)

    def slice(self, offset: int, size: int, value=None) -> DataFrame:
        """Rows offset+1 .. offset+size in the page order, of those with that
        filter value (of all rows: None).  Empty beyond the end."""
        if offset < 0 or size < 0:
            raise ValueError("offset and size must not be negative")
        if value is not None and self.filter_column is None:
            raise ValueError("this directory has no filter column")
        per_range: dict[int, int] = {}
        for r, v, n in self.counts:
            if value is None or v == value:
                per_range[r] = per_range.get(r, 0) + n
        before, skip, wanted = 0, 0, []
        for r in sorted(per_range):
            start, before = before, before + per_range[r]
            if before > offset and start < offset + size:
                if not wanted:
                    skip = offset - start
                wanted.append(r)
        found = self.rows.filter(F.col(RANGE).isin(wanted)) if wanted else self.rows.limit(0)
        if value is not None:
            found = found.filter(F.col(self.filter_column) == F.lit(value))
        return found.drop(RANGE).orderBy(*_order(list(self.keys))).offset(skip).limit(size)


def build_directory(df: DataFrame, keys: list[SortKey], path: str, filter_column: str | None = None,
                    ranges: int | None = None) -> PageDirectory:
    """Write the directory of ``df`` under ``path`` (which must not exist) and
    open it.  ``keys`` must order the rows totally, or pages may share ties.
    ``ranges``: how many, the session's shuffle partitions by default; a page
    costs a range's rows, so more of them make pages cheaper."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *_order(keys)).withColumn(RANGE, F.spark_partition_id())
    # The range is constant in a task, so this writes one folder per task.
    ranged.write.partitionBy(RANGE).parquet(f"{path}/rows")
    value = F.col(filter_column) if filter_column else F.lit(None).cast("string")
    rows = _rows(spark, path, df)
    rows.groupBy(RANGE, value.alias("value")).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/counts")
    return open_directory(spark, path, df, keys, filter_column)


def _rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    # With the schema given, an empty table (no file at all) reads as empty.
    return spark.read.schema(like.withColumn(RANGE, F.lit(0)).schema).parquet(f"{path}/rows")


def open_directory(spark: SparkSession, path: str, like: DataFrame, keys: list[SortKey],
                   filter_column: str | None = None) -> PageDirectory:
    """A directory written before; ``like`` gives the columns, by schema only."""
    counts = spark.read.parquet(f"{path}/counts").orderBy(RANGE).collect()
    return PageDirectory(_rows(spark, path, like), tuple(keys), tuple((r[RANGE], r["value"], r["n"]) for r in counts), filter_column)
