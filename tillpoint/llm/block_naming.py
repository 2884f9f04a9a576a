"""Exact duplicates by block naming, with DataFrame operations only.

Each text is cut into blocks of fixed size.  The blocks that occur more than
once are sorted and get integer names in that order; then adjacent names are
paired, and the pairs that occur more than once are sorted and named in turn,
until one name stands for a whole text.  Names are given by comparing the
blocks and pairs themselves, so two texts share their last name only if they
are equal: no hash decides anything.

A block or pair that occurs once makes its text unique; such a text needs no
further names and leaves the rounds.  A hot text costs one partial-aggregate
row per task in naming; the joins that hand names back read two plain tables,
so adaptive execution can split a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import as_frame, growing, materialize

BLOCK_BYTES = 4096


def _names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names of the keys that occur more than once, in sort order
    inside each partition; written, so that every reader sees the same names.

    The aggregate's own partitions are sorted: a global sort would send samples
    of whole blocks to the driver."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return materialize(repeated.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "names")


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    count = F.greatest(F.ceil(F.length("bytes") / F.lit(block_bytes)), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                      lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    return (texts.withColumn("blocks", count)
            .select(*[c for c in texts.columns if c != "bytes"], "blocks", F.posexplode(cut).alias("at", "block")))


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id``, ``uid`` (row number of this run),
    ``text_sha256`` and the identity ``(blocks, level, name)``; ``name`` is
    null for a text that no other row has.

    Null texts count as empty and all empty texts are equal; repeated rows and
    null ids are kept as rows of their own; other columns are not read; an
    empty table gives an empty result."""
    texts = as_frame(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    names = _names(_blocks(texts, block_bytes), ["block"])
    cut = _blocks(texts.select("doc_id", "bytes", F.sha2("bytes", 256).alias("text_sha256"),
                               F.monotonically_increasing_id().alias("uid")), block_bytes)
    first = F.col("at") == 0
    rows = materialize(
        cut.select("uid", "at", "blocks", "block", F.when(first, F.col("doc_id")).alias("doc_id"),
                   F.when(first, F.col("text_sha256")).alias("text_sha256"))
        .join(growing(names), "block", "left").drop("block"), "level")
    heads = rows.filter("at = 0").select("doc_id", "uid", "text_sha256", "blocks")
    rows = rows.select("uid", "at", "blocks", "name")
    most = rows.agg(F.max("blocks")).first()[0] or 1
    done, level = [], 0
    while True:
        # A text with an unnamed block is unique; one whose names have all met is finished.
        whole = rows.groupBy("uid").agg(F.count("name").alias("named"), F.count(F.lit(1)).alias("all"))
        whole = whole.filter(F.col("named") == F.col("all")).select("uid")
        over = F.col("blocks") <= (1 << level)
        done.append(rows.filter(over & F.col("name").isNotNull()).select("uid", F.lit(level).alias("level"), "name"))
        if (1 << level) >= most:
            break
        pairs = (rows.filter(~over).join(whole, "uid", "left_semi")
                 .groupBy("uid", "blocks", F.shiftright("at", 1).alias("at"))
                 .agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")))
        pairs = materialize(pairs, "pairs")
        names = _names(pairs, ["left", "right"])
        rows = materialize(pairs.join(growing(names), ["left", "right"], "left").select("uid", "at", "blocks", "name"), "level")
        level += 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return heads.join(found, "uid", "left")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays (null ids last; of rows
    that tie in their id, exactly one stays)."""
    named = materialize(name_texts(docs, id_col, text_col, block_bytes), "named")
    key = ["blocks", "level", "name"]
    shared = named.filter("name is not null")
    groups = materialize(shared.groupBy(*key).agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "uid")).alias("last")), "groups")
    out = [F.col("doc_id"), F.col("last.doc_id").alias("keep_id"), F.col("group_size"),
           (F.col("uid") == F.col("last.uid")).alias("kept"), F.col("text_sha256")]
    alone = named.filter("name is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return shared.join(growing(groups), key).select(*out).unionByName(alone)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of the rows that stay."""
    return exact_duplicates(docs, id_col, text_col).filter("kept").select("doc_id")
