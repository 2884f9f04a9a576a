"""Rank, row number and ntile over a whole table without one giant task.

An unpartitioned window (``RANK() OVER (ORDER BY v DESC)``) moves every
row into a single task.  Here, for tables of any size:

1. ``repartitionByRange`` on (group, key, tie-break) - balanced ranges
   from sampling; a huge tie class spills over several ranges instead of
   one task, because the tie-break keeps the order total.
2. Per range: row number, group-relative row number and rank, computed by
   windows partitioned by the range id; the result is written to the
   checkpoint folder (range ids stay fixed if a task is re-run).
3. Per range one small summary row (first/last group and key, counts);
   these rows - one per range, bounded by the partition count - are
   collected and turned into carries: how many rows of the range's first
   group and first tie class lie in earlier ranges.
4. A broadcast join of the carries (again one row per range) gives each
   row its global position.

All grouping and ordering stay in Spark; the driver only sees one row per
range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.session import materialize


# Lower bits of monotonically_increasing_id, and the neighbours in one bitmap
# (that many bits is what bitmap_construct_agg makes).
PLACE_BITS = 33
SLOT_BITS = 15
WORDS = 1 << (SLOT_BITS - 6)
BITMAP_BYTES = 64 << 20


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False
    nulls_first: bool | None = None   # None: Spark default for the direction

    def expr(self) -> Column:
        c = F.col(self.column)
        nf = self.nulls_first
        if self.descending:
            return c.desc_nulls_first() if nf else c.desc_nulls_last() if nf is False else c.desc()
        return c.asc_nulls_last() if nf is False else c.asc_nulls_first() if nf else c.asc()


def _same(a, b) -> bool:
    if a == b:
        return True
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b)
    return False


def window_positions(df: DataFrame, keys: list[SortKey], *, group_by: tuple[str, ...] = (),
                     tie_break: tuple[str, ...] = (), rank: str | None = None,
                     row_number: str | None = None, ntile: tuple[str, int] | None = None,
                     running_sum: dict[str, str] | None = None,
                     force: str | None = None, tie_desc: bool = False) -> DataFrame:
    """Add rank / row_number / ntile columns ordered by ``keys`` within
    ``group_by`` (whole table if empty).  ``tie_break`` columns make the row
    order total (needed for row_number and ntile).

    The result is written to the checkpoint folder (see above).
    ``running_sum`` maps output column -> value column: the inclusive
    running sum within the group in (keys, tie_break) order, which must be
    total for the result to be deterministic.
    ``force='window'`` plans one plain window instead, lazily: the reference
    for tests, and for tables that are small by nature.
    ``tie_desc`` sorts the tie-break columns descending."""
    running_sum = running_sum or {}
    tie_break = tuple(F.col(c).desc() if tie_desc else F.col(c).asc() for c in tie_break)
    if ntile is not None and group_by:
        raise ValueError("ntile is supported over the whole table only")
    if force == "window":
        return _plain(df, keys, group_by, tie_break, rank, row_number, ntile, running_sum)
    return _distributed(df, keys, group_by, tie_break, rank, row_number, ntile, running_sum)


def _plain(df, keys, group_by, tie_break, rank, row_number, ntile, running_sum):
    order_k = [k.expr() for k in keys]
    order_t = order_k + list(tie_break)
    w_rank = Window.partitionBy(*group_by).orderBy(*order_k)
    w_total = Window.partitionBy(*group_by).orderBy(*order_t)
    out = df
    if rank:
        out = out.withColumn(rank, F.rank().over(w_rank).cast("long"))
    if row_number:
        out = out.withColumn(row_number, F.row_number().over(w_total).cast("long"))
    if ntile:
        out = out.withColumn(ntile[0], F.ntile(ntile[1]).over(w_total))
    frame = w_total.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, col in running_sum.items():
        out = out.withColumn(name, F.sum(col).over(frame))
    return out


def ntile_of(position: Column, total: Column, n: int) -> Column:
    """NTILE(n) from a 1-based position and the row count: the first
    ``total % n`` tiles hold one row more."""
    q = F.floor(total / n).cast("long")
    m = (total % n).cast("long")
    big = m * (q + 1)
    return F.when(position <= big, F.floor((position - 1) / (q + 1)) + 1) \
            .otherwise(m + F.floor((position - 1 - big) / F.greatest(q, F.lit(1))) + 1).cast("int")


def _distributed(df, keys, group_by, tie_break, rank, row_number, ntile, running_sum):
    spark = df.sparkSession
    key_cols = [k.column for k in keys]
    order_k = [k.expr() for k in keys]
    order_all = [F.col(g).asc() for g in group_by] + order_k + list(tie_break)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    ranged = df.repartitionByRange(n_parts, *order_all).withColumn("_pid", F.spark_partition_id())
    w_pid = Window.partitionBy("_pid").orderBy(*order_all)
    w_grp = Window.partitionBy("_pid", *group_by)
    staged = (ranged
              .withColumn("_rn", F.row_number().over(w_pid))
              .withColumn("_gstart", F.min("_rn").over(w_grp))
              .withColumn("_grn", F.row_number().over(
                  w_grp.orderBy(*order_k, *tie_break)))
              .withColumn("_grk", F.rank().over(w_grp.orderBy(*order_k))))
    w_run = w_grp.orderBy(*order_k, *tie_break) \
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {name: f"_gs{i}" for i, name in enumerate(running_sum)}
    for name, col in running_sum.items():
        staged = staged.withColumn(sums[name], F.sum(col).over(w_run))
    staged = materialize(staged, "ranked")

    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    probe = list(group_by) + key_cols
    firsts = {r["_pid"]: r for r in staged.filter(F.col("_rn") == 1).select("_pid", *probe).collect()}
    lasts = {r["_pid"]: r for r in staged.join(F.broadcast(counts), "_pid")
             .filter(F.col("_rn") == F.col("_n"))
             .select("_pid", "_n", "_grn", "_grk", *sums.values(), *probe).collect()}

    def gk(row):
        return (tuple(row[c] for c in group_by), tuple(row[c] for c in key_cols))

    def eq(a, b):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))

    # Forward pass over the ranges in order.  run_g / run_t: group and
    # (group, key) that the previous range ends with, and how many rows of
    # them precede the current range.
    carry_rows, before = [], 0
    run_g, run_gc, run_t, run_tc = None, 0, None, 0
    run_sum = {c: 0 for c in sums.values()}
    sum_carry_rows = []
    for p in sorted(lasts):
        (fg, fk), (lg, lk) = gk(firsts[p]), gk(lasts[p])
        n, l_grn, l_grk = lasts[p]["_n"], lasts[p]["_grn"], lasts[p]["_grk"]
        g_carry = run_gc if run_g is not None and eq(fg, run_g) else 0
        t_carry = run_tc if run_t is not None and eq(fg, run_t[0]) and eq(fk, run_t[1]) else 0
        carry_rows.append((p, before, g_carry, t_carry))
        same_group = run_g is not None and eq(fg, run_g)
        s_carry = {c: (run_sum[c] if same_group else 0) for c in sums.values()}
        sum_carry_rows.append(tuple(s_carry[c] for c in sums.values()))
        one_group = eq(fg, lg)
        for c in sums.values():
            run_sum[c] = (s_carry[c] if one_group else 0) + (lasts[p][c] or 0)
        one_tie = one_group and eq(fk, lk)
        run_gc = g_carry + n if one_group else l_grn
        run_tc = t_carry + n if one_tie else l_grn - l_grk + 1
        run_g, run_t = lg, (lg, lk)
        before += n
    total = before

    sum_types = {c: dict(staged.dtypes)[c] for c in sums.values()}
    carry_schema = "_pid int, _before long, _gcarry long, _tcarry long" + "".join(
        f", _c{c} {sum_types[c]}" for c in sums.values())
    rows = [r + sc for r, sc in zip(carry_rows, sum_carry_rows)]
    carries = spark.createDataFrame(rows, carry_schema)
    out = staged.join(F.broadcast(carries), "_pid")
    first_grp = F.col("_gstart") == 1
    gcarry = F.when(first_grp, F.col("_gcarry")).otherwise(F.lit(0))
    if rank:
        first_tie = first_grp & (F.col("_grk") == 1)
        out = out.withColumn(rank, F.when(first_tie, F.col("_gcarry") - F.col("_tcarry") + 1)
                             .otherwise(F.col("_grk") + gcarry).cast("long"))
    if row_number:
        out = out.withColumn(row_number, (F.col("_grn") + gcarry).cast("long"))
    if ntile:
        pos = F.col("_before") + F.col("_rn")
        out = out.withColumn(ntile[0], ntile_of(pos, F.lit(total), ntile[1]))
    for name, c in sums.items():
        out = out.withColumn(name, F.col(c) + F.when(first_grp, F.col(f"_c{c}")).otherwise(F.lit(0)))
    extra = list(sums.values()) + [f"_c{c}" for c in sums.values()]
    return out.drop("_pid", "_rn", "_gstart", "_grn", "_grk", "_before", "_gcarry", "_tcarry", *extra)


def nested_ranks(df: DataFrame, key: SortKey, group: str, tie_break: str, rank: str, rank_in_group: str) -> DataFrame:
    """RANK over the whole table and RANK within each group, both by ``key``,
    from one range sort (``tie_break`` only spreads equal keys over ranges).

    In a range, a row's rank follows from its local rank, the rows of earlier
    ranges and those of them that tie with it; within its group likewise.
    Rows before a range are prefix sums of a count per range, or per (range,
    group), which stays a table; ties can only reach back from the value that
    a range begins with, so they are counted for those values."""
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_parts, key.expr(), F.col(tie_break).asc()).withColumn("_pid", F.spark_partition_id())
    for name, keys in (("_rk", ["_pid"]), ("_grk", ["_pid", group])):
        ranged = ranged.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(key.expr())))
    staged = materialize(ranged, "ranked")
    value = F.col(key.column)

    def before(counts: DataFrame, by: list, out: str) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(out, F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")

    number = F.count(F.lit(1)).alias("_n")
    per_group = staged.groupBy("_pid", group).agg(number)
    # One row per range; the value it begins with.
    per_range = before(per_group.groupBy("_pid").agg(F.sum("_n").alias("_n")), [], "_before")
    begins = staged.filter("_rk = 1").select(value.alias("_v")).distinct()
    ties = staged.join(F.broadcast(begins), value.eqNullSafe(F.col("_v")), "left_semi").groupBy(
        F.col("_pid"), F.col(group), value.alias("_v")).agg(number)
    group_ties = before(ties, [group, "_v"], "_gties").withColumnRenamed(group, "_g").withColumnRenamed("_pid", "_p")
    all_ties = before(ties.groupBy("_pid", "_v").agg(F.sum("_n").alias("_n")), ["_v"], "_ties").withColumnRenamed("_v", "_av").withColumnRenamed("_pid", "_ap")
    of_group = before(per_group, [group], "_gbefore").withColumnRenamed(group, "_og").withColumnRenamed("_pid", "_op")
    out = (staged.join(F.broadcast(per_range), "_pid")
           .join(of_group, (F.col("_pid") == F.col("_op")) & F.col(group).eqNullSafe(F.col("_og")))
           .join(group_ties, (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")) & value.eqNullSafe(F.col("_v")), "left")
           .join(all_ties, (F.col("_pid") == F.col("_ap")) & value.eqNullSafe(F.col("_av")), "left"))
    zero = F.lit(0)
    return out.select(*[F.col(c) for c in df.columns],
                      (F.col("_rk") + F.col("_before") - F.coalesce("_ties", zero)).cast("long").alias(rank),
                      (F.col("_grk") + F.col("_gbefore") - F.coalesce("_gties", zero)).cast("long").alias(rank_in_group))


def dense_ids(df: DataFrame, order_cols: list[str], out: str, start: int = 1,
              force: str | None = None, ranged: bool = False) -> DataFrame:
    """Consecutive ids start, start+1, ... in ``order_cols`` order (which
    must be total), without a global single-task window.

    Rows are sorted within ranges and written with their place in the range; the
    counts of the ranges (one row each) give the place of a range.  ``ranged``:
    the partitions of ``df`` follow each other in ``order_cols`` order already, so
    no row moves; if their bounds show that they do not, the rows are ranged."""
    if force == "window":
        res = window_positions(df, [SortKey(order_cols[0])], tie_break=tuple(order_cols[1:]), row_number="_dense_rn", force=force)
        return res.withColumn(out, (F.col("_dense_rn") + F.lit(start - 1)).cast("long")).drop("_dense_rn")
    spark = df.sparkSession
    order = [F.col(c).asc() for c in order_cols]
    parts = df if ranged else df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    # Partition number in the upper bits, place in the sorted partition in the lower ones.
    staged = materialize(parts.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked", "zstd")
    staged = staged.withColumn("_pid", F.shiftright("_place", PLACE_BITS).cast("int"))
    first = F.col(order_cols[0])
    bounds = [F.min(first), F.max(first), F.count_if(first.isNull())] if ranged else []
    ranges = sorted(staged.groupBy("_pid").agg(F.count(F.lit(1)), *bounds).collect(), key=lambda r: r[0])
    if ranged and not _in_order(ranges):
        return dense_ids(staged.drop("_place", "_pid"), order_cols, out, start)
    offsets, before = [], start
    for r in ranges:
        offsets.append((r[0], before))
        before += r[1]
    table = spark.createDataFrame(offsets, "_pid int, _off long")
    local = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))
    return staged.join(F.broadcast(table), "_pid").withColumn(out, F.col("_off") + local).drop("_pid", "_place", "_off")


def _in_order(ranges: list) -> bool:
    """Whether ranges (number, rows, least, greatest, nulls) follow each other,
    NULLs in the first one only and no value in two."""
    if any(r[4] for r in ranges[1:]):
        return False
    known = [r for r in ranges if r[2] is not None]
    return all(a[3] < b[2] for a, b in zip(known, known[1:]))


def dense_ids_by_int_key(df: DataFrame, key: str, out: str, start: int = 1, target_rows_per_bucket: int = 200_000,
                         known: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Consecutive ids in order of a unique integer ``key`` (e.g. a feed row
    number or a request sequence), and no row moves.

    The keys alone are gathered into bitmaps (``key_bitmaps``); a row's id is
    the number of keys in the bitmaps before its own (a prefix sum, one row per
    bitmap) and in its own up to the key.  Keys that are too far apart for
    bitmaps, or not unique, are numbered by ``_by_buckets``.  ``known``: the bitmaps
    of exactly the keys of ``df`` and the number of its rows, where the caller has them."""
    spark = df.sparkSession
    counts: list = []
    if known is not None:
        bitmaps, n = known
        counts = _bit_counts(bitmaps)
    if known is None or sum(c for _, c in counts) != n:
        lo, hi, n, given = df.agg(F.min(key), F.max(key), F.count(F.lit(1)), F.count(key)).first()
        if n != given:
            return dense_ids(df, [key], out, start=start)
        bitmaps = key_bitmaps(df.select(key), key, lo, hi)
        counts = [] if bitmaps is None else _bit_counts(bitmaps)
        if sum(c for _, c in counts) != n:
            return _by_buckets(df, key, out, start, target_rows_per_bucket, lo, hi, n)
    offsets, before = [], start - 1
    for slot, c in counts:
        offsets.append((slot, before))
        before += c
    table = bitmaps.select("_slot", "_words", "_earlier").join(F.broadcast(spark.createDataFrame(offsets, "_slot long, _off long")), "_slot")
    place = bitmap_place(F.col(key))
    at = _word_at(place)
    # The word from the key's byte on: the bytes before it, and of that one the bits up to the key.
    head = F.call_function("shiftrightunsigned", F.get("_words", at), (F.lit(56) - place.bitwiseAND(F.lit(56).cast("long"))).cast("int"))
    upto = F.call_function("shiftright", F.lit(255).cast("long"), (7 - place % 8).cast("int")).bitwiseOR(F.lit(-256).cast("long"))
    rank = F.col("_off") + F.get("_earlier", at) + F.bit_count(head.bitwiseAND(upto))
    return (df.withColumn("_slot", bitmap_slot(F.col(key))).join(F.broadcast(table), "_slot")
            .withColumn(out, rank.cast("long")).drop("_slot", "_words", "_earlier", "_off"))


def _bit_counts(bitmaps: DataFrame) -> list[tuple[int, int]]:
    return sorted(tuple(r) for r in bitmaps.select("_slot", "_n").collect())


def _by_buckets(df, key, out, start, target_rows_per_bucket, lo, hi, n):
    """The key range is cut into equal-width buckets; per-bucket counts - one
    row per bucket - give offsets; each bucket is numbered by a window
    partitioned by the bucket, so the work is spread over all tasks.  If the
    keys are clustered so that one bucket would hold far more than its share,
    the range-partitioned path of ``dense_ids`` is used instead."""
    spark = df.sparkSession
    buckets = max(1, math.ceil(n / target_rows_per_bucket))
    width = max(1, math.ceil((hi - lo + 1) / buckets))
    b = F.floor((F.col(key) - F.lit(lo)) / F.lit(width)).cast("long")
    tagged = df.withColumn("_bucket", b)
    counts = sorted((r[0], r[1]) for r in tagged.groupBy("_bucket").count().collect())
    if buckets > 1 and max(c for _, c in counts) > 4 * target_rows_per_bucket:
        return dense_ids(df, [key], out, start=start)
    offsets, before = [], start - 1
    for bucket, c in counts:
        offsets.append((bucket, before))
        before += c
    table = spark.createDataFrame(offsets, "_bucket long, _off long")
    w = Window.partitionBy("_bucket").orderBy(F.col(key))
    return (tagged.join(F.broadcast(table), "_bucket")
            .withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("long"))
            .drop("_bucket", "_off"))


def bitmap_slot(key: Column) -> Column:
    return F.shiftright(key.cast("long"), SLOT_BITS)


def bitmap_place(key: Column) -> Column:
    return key.cast("long").bitwiseAND(F.lit((1 << SLOT_BITS) - 1).cast("long"))


def bitmap_words(bits: Column) -> Column:
    """A bitmap as an array of numbers, eight bytes each, the first byte highest:
    a bit is read from a number without copying the bitmap."""
    half = lambda at: F.conv(F.hex(F.substring(bits, at, F.lit(4))), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.shiftleft(half(i * 8 + 1), 32).bitwiseOR(half(i * 8 + 5)))


def _word_at(place: Column) -> Column:
    return F.shiftright(place, 6).cast("int")


def has_bit(words: Column, place: Column) -> Column:
    """Whether the bit ``place`` of a bitmap is set, from its ``bitmap_words``."""
    # Bytes go down in a word, bits go up in a byte.
    return F.getbit(F.get(words, _word_at(place)), place.bitwiseXOR(F.lit(56).cast("long")).bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def key_bitmaps(keys: DataFrame, key: str, lo: int | None, hi: int | None) -> DataFrame | None:
    """The integers in the column ``key``, all between ``lo`` and ``hi``, as bitmaps
    of 2^15 neighbours, written once: (_slot, _words, _earlier, _n), the ``bitmap_words``, the bits
    before each of them and the number of bits, 5 KB each.  None if the keys are spread so
    far that the bitmaps could take more than BITMAP_BYTES; below that they can
    be broadcast (64 MB hold 500 million consecutive keys)."""
    if lo is not None and ((hi >> SLOT_BITS) - (lo >> SLOT_BITS) + 1) << (SLOT_BITS - 3) > BITMAP_BYTES:
        return None
    # NULLs lie in no bitmap.
    spread = keys.filter(F.col(key).isNotNull()).select(bitmap_slot(F.col(key)).alias("_slot"), bitmap_place(F.col(key)).alias("_at"))
    bits = F.col("_bits")
    earlier = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.bitmap_count(F.substring(bits, F.lit(1), i * 8)).cast("short"))
    return materialize(spread.groupBy("_slot").agg(F.bitmap_construct_agg("_at").alias("_bits")).select(
        "_slot", bitmap_words(bits).alias("_words"), earlier.alias("_earlier"), F.bitmap_count(bits).alias("_n")), "bitmaps")
