"""Mixing sources to target weights, with DataFrame operations only.

Sizes are added up per source, targets are derived from the weights, and each
document is taken floor(rate) times plus one more time with probability equal
to the fraction, by a draw that depends only on the seed and the document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import col, free_name, materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_REPEATS = 2
SEED = 7
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the control spaces; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) with 52 bits from the digest of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET,
                   most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, size) -> one row per source: ``source, source_size,
    target, rate``.

    Sources in code point order, null last, take the weights in turn and share
    ``budget`` times all sizes by weight; a target stops at ``most`` times its
    source's size and the excess is shared again by weight.  The fixed point
    is found at once: sorted by cap/weight, the capped sources are a prefix.
    A source without words has target and rate 0."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: the windows below see the list of sources.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    listed = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    per = per.withColumn("level", left / share)
    per = per.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    per = per.withColumn("k", F.row_number().over(by_cap))
    level = F.min(F.when(~F.col("capped"), F.struct("k", "level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level["level"] * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS,
             seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with added columns size, source_size, target and copies, and
    the names these columns got (lengthened if the caller's columns clash).

    The source list is written first; its size in bytes is then known, so
    Spark broadcasts it only under its threshold and splits a hot source's
    rows otherwise."""
    names = {k: free_name(docs, k) for k in ("size", "source_size", "target", "copies")}
    sized = docs.withColumn(names["size"], word_count(col(text_col)))
    stats = materialize(source_targets(
        sized.select(col(source_col).alias("source"), col(names["size"]).alias("size")), weights, budget, most), "sources")
    right = {k: free_name(sized, f"mix_{k}") for k in ("source", "source_size", "target", "rate")}
    stats = stats.select(*[F.col(k).alias(v) for k, v in right.items()])
    joined = sized.join(stats, col(source_col).eqNullSafe(col(right["source"])))
    rate = col(right["rate"])
    # Rows without an id are told apart by their texts.
    key = F.coalesce(col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(col(text_col), F.lit("")))))
    copies = F.floor(rate) + F.when(draw(seed, key) < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))
    return joined.select(*[col(c) for c in docs.columns], col(names["size"]),
                         col(right["source_size"]).alias(names["source_size"]),
                         col(right["target"]).alias(names["target"]), copies.cast("int").alias(names["copies"])), names


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken.

    Null texts have size 0; rows without words are taken like the others of
    their source; a null source is a source; null ids draw by their texts; repeated
    rows share a draw; an empty table gives an empty mix."""
    planned, names = plan_mix(docs, **options)
    copy = free_name(planned, "copy")
    often = F.sequence(F.lit(1), col(names["copies"]))
    return (planned.filter(col(names["copies"]) > 0).withColumn(copy, F.explode(often))
            .select(*[col(c) for c in docs.columns]))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS key, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, source_size * {MOST_REPEATS} AS cap,
         row_number() OVER (ORDER BY CAST(source_size * {MOST_REPEATS} AS DOUBLE) / weight, source IS NULL, source) AS k,
         CAST(sum(source_size) OVER () AS DOUBLE) * {BUDGET} AS pool, CAST(sum(weight) OVER () AS DOUBLE) AS parts
  FROM per),
levels AS (
  SELECT *, (pool - CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE)) / (parts - CAST(coalesce(sum(weight) OVER w, 0) AS DOUBLE)) AS level
  FROM ordered WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (
  SELECT *, cap <= level * weight AS capped FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE arg_min(level, k) FILTER (WHERE NOT capped) OVER () * weight END AS target
  FROM fixed),
drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('{SEED}:' || d.key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn"""
