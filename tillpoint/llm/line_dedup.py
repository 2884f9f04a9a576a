"""Substring dedup by lines: equal normalised lines are kept once.

Every line with a word (of MIN_WORDS or more) is a unit.  Units are normalised (A-Z
lower-cased, runs of white space one space), their digests are grouped over
all documents, and the occurrence that ranks first stays.  Only digests and
offsets are shuffled; the texts meet their spans once, at the end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import SLICE_BYTES, as_frame, growing, materialize

MIN_WORDS = 1
# Units that a task holds before it passes them on.
HELD_UNITS = 20_000


def text_key(*columns: str) -> Column:
    """What tells documents of one id apart."""
    return F.xxhash64(*columns)


def units(raw: bytes, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the lines of ``raw`` with at least ``min_words`` words."""
    at = 0
    for line in raw.split(b"\n"):
        words = line.lower().split()
        if len(words) >= min_words:
            yield at, at + len(line), hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        at += len(line) + 1


def _find(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lo, hi, digest = [], [], [], []

            def passed():
                rows = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int32())), batch.column("key").take(pa.array(row, pa.int32())),
                     pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(digest, pa.binary())],
                    names=["doc_id", "key", "lo", "hi", "digest"])
                for column in (row, lo, hi, digest):
                    column.clear()
                return rows

            for i, text in enumerate(batch.column("bytes")):
                for a, b, d in units(text.as_py(), min_words):
                    row.append(i)
                    lo.append(a)
                    hi.append(b)
                    digest.append(d)
                    if len(row) == HELD_UNITS:
                        yield passed()
            yield passed()
    return run


def _remove(min_words: int):
    spans_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size = 0, 0
            counts, removed, kept = [], [], []
            for i, (text, spans) in enumerate(zip(batch.column("bytes"), batch.column("spans"))):
                raw, gone = text.as_py(), sorted((s["lo"], s["hi"]) for s in spans.as_py() or ())
                drop, at, n, lines = {lo for lo, _ in gone}, 0, 0, []
                for line in raw.split(b"\n"):
                    if at not in drop or not line:
                        lines.append(line)
                    n += len(line.split(None, min_words)) >= min_words
                    at += len(line) + 1
                counts.append(n)
                removed.append([{"lo": lo, "hi": hi} for lo, hi in gone])
                kept.append(b"\n".join(lines).decode())
                size += len(raw)
                if size > SLICE_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, len(kept)), pa.array(counts, pa.int64()),
                         pa.array(removed, spans_type), pa.array(kept, pa.string())], names=["doc_id", "units", "removed", "kept"])
                    first, size = i + 1, 0
                    counts, removed, kept = [], [], []
    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, units`` (lines long enough to count),
    ``removed`` (their byte spans in the original, ``lo`` to before ``hi``) and
    ``kept`` (the other lines, joined by line breaks).

    Occurrences rank by id (null last), then by position.  Null and empty
    texts have no units.  Rows that agree in id and text are one document:
    they lose the same lines.  Equal texts under different ids are different
    documents.  A very long text is handled by itself, its units passed on as they come.  Other columns
    are not read; an empty table gives an empty result.  Documents are followed
    by their id and a 64-bit hash of id and text."""
    keyed = as_frame(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", text_key("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("bytes"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    found = materialize(keyed.mapInArrow(_find(min_words), f"doc_id {kind}, key long, lo long, hi long, digest binary"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "lo")
    # Counting a document's units once, so that repeated rows alone are no repeat.
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    first = materialize(first.select("digest", "first"), "first")
    later = found.join(growing(first), "digest").filter(place != F.col("first")).select("doc_id", "key", "lo", "hi").distinct()
    spans = later.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = materialize(spans, "spans")
    texts = keyed.join(growing(spans), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    return texts.select("doc_id", "bytes", "spans").mapInArrow(
        _remove(min_words), f"doc_id {kind}, units long, removed array<struct<lo:long,hi:long>>, kept string")


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
normal AS (
  SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[ \\t\\r\\f\\x0b]+', ' ', 'g'), ' ') AS unit FROM lines),
ranked AS (
  SELECT *, unit <> '' AND len(string_split(unit, ' ')) >= {MIN_WORDS} AS counts,
         row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) AS place FROM normal)
SELECT doc_id, CAST(count(*) FILTER (WHERE counts) AS BIGINT) AS n_units,
       CAST(count(*) FILTER (WHERE counts AND place > 1) AS BIGINT) AS n_removed,
       CAST(coalesce(sum(strlen(line)) FILTER (WHERE counts AND place > 1), 0) AS BIGINT) AS removed_bytes,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (counts AND place > 1)), '')) AS kept_sha256
FROM ranked GROUP BY doc_id"""
