"""Repeated substrings by suffix sorting: every byte that a string of
``length`` bytes covers which also starts somewhere else is removed.

1. Every start of a ``length``-byte string is given the smallest hash of the
   PROBE-byte strings inside it (of several, the last).  Equal strings get
   equal hashes, so both starts of a repeat fall into the same bucket; runs of
   starts with the same hash are one row with the digest of the segment that
   they span.  A run within which the place of the hash moves may repeat itself.
2. Buckets with one row, of one place, hold no repeat.  Equal segments of a
   bucket count as one with a multiplicity: copies cost one row per task.
3. The texts of the distinct segments of a bucket meet in one task, which sorts
   their suffixes in two stages and compares neighbours (suffix_sort.py).  A
   start repeats if its common prefix with a neighbour is ``length`` long, or
   its segment has copies.  Buckets of more than BUCKET_SEGMENTS segments are
   split further: by the digest of the whole string, counted with a
   partial aggregate.
4. The covered bytes of a text are the union of its repeated strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.llm.common import as_frame, growing, materialize, text_slices
from tillpoint.llm.jaccard_join import whole_groups
from tillpoint.llm.suffix_sort import common_prefixes, suffix_order
from tillpoint.llm.text import mix

LENGTH = 400
PROBE = 128
# Bytes of text hashed at once, segments per bucket, and bytes of segments
# sorted at once.
CHUNK = 1 << 20
BUCKET_SEGMENTS = 4096
SORT_BYTES = 1 << 20

# Bits for a place in a chunk.
_PLACE = 21
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, np.uint64(base))
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    m, span = h, 1
    while span * 2 <= width:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - span:width - span + n])


def runs(data: np.ndarray, length: int, probe: int, power: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(bucket, segment digest, first start, starts, whether the place of the
    smallest hash moves) of one text's runs."""
    found = []
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at:at + CHUNK + length - 1]
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[0][:n], out=total[1:])
        h = mix((total[probe:] - total[:-probe]) * power[1][:n - probe + 1])
        # The high bits of the hash, then the place, later places first.
        low = np.uint64((1 << _PLACE) - 1)
        ranked = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        place = (low - (_smallest(ranked, length - probe + 1) & low)).astype(np.int64)
        least = h[place]
        # A hash stands in a text's strings for length - probe + 1 starts, unless it
        # comes again; only runs that repeat themselves reach twice that and are cut.
        new = np.concatenate([[True], least[1:] != least[:-1]])
        since = np.arange(len(least))
        since -= np.maximum.accumulate(np.where(new, since, 0))
        first = np.flatnonzero(since % (2 * (length - probe + 1)) == 0)
        count = np.diff(np.append(first, len(least)))
        moves = place[first] != place[first + count - 1]
        stop = first + count + length - 1
        segment = mix((total[stop] - total[first]) * power[1][first] + count.astype(np.uint64))
        found.append((least[first], segment, first + at, count, moves))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*found))


def _find(length: int, probe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(CHUNK + length)
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                keys = batch.column("key").slice(at, len(texts)).to_numpy()
                found, many = [], []
                for t in texts:
                    r = runs(np.frombuffer(t.as_buffer(), np.uint8), length, probe, power)
                    found.append(r)
                    many.append(len(r[0]))
                bucket, segment, first, count, moves = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(keys, many)), pa.array(bucket.view(np.int64)), pa.array(segment.view(np.int64)),
                     pa.array(first, pa.int64()), pa.array(count.astype(np.int32)), pa.array(moves)],
                    names=["key", "bucket", "segment", "first", "starts", "moves"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text, a few texts at a time."""
    names = ("bucket", "segment", "copies", "starts")
    held: dict[str, list] = {k: [] for k in (*names, "bytes")}
    size = 0
    for batch in batches:
        for text, wanted in zip(batch.column("bytes"), batch.column("wanted")):
            raw = text.as_buffer()
            for w in wanted.as_py():
                for k in names:
                    held[k].append(w[k])
                held["bytes"].append(raw[w["first"]:w["first"] + w["size"]].to_pybytes())
                size += w["size"]
            if size > SORT_BYTES:
                yield pa.RecordBatch.from_pydict(held, schema=_SEGMENTS)
                held, size = {k: [] for k in held}, 0
    yield pa.RecordBatch.from_pydict(held, schema=_SEGMENTS)


_SEGMENTS = pa.schema([("bucket", pa.int64()), ("segment", pa.int64()), ("copies", pa.int64()),
                       ("starts", pa.int32()), ("bytes", pa.binary())])


def repeated_starts(segments: list[bytes], starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, which of its first ``starts`` positions begin a
    string of ``length`` bytes that also starts elsewhere in the segments."""
    size = np.array([len(s) for s in segments])
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    data = np.zeros(int((size + 1).sum()), np.uint16)
    body = np.frombuffer(b"".join(segments), np.uint8)
    data[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = body.astype(np.uint16) + 1
    asked = np.zeros(len(data), bool)
    for a, n in zip(first, starts):
        asked[a:a + n] = True
    order = suffix_order(data, length)
    order = order[asked[order]]
    # A string that is asked for ends inside its segment: bytes will do here.
    plain = (data - 1).astype(np.uint8)
    long = common_prefixes(plain, order[:-1], order[1:], length) >= length
    hit = np.zeros(len(data), bool)
    hit[order[:-1][long]] = hit[order[1:][long]] = True
    return [hit[a:a + n] for a, n in zip(first, starts)]


def _ranges(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _sort(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            buckets = table.column("bucket").to_numpy()
            size = np.cumsum([len(b) for b in (x.as_buffer() for x in table.column("bytes"))])
            at = 0
            while at < len(buckets):
                # As many whole buckets as SORT_BYTES hold, one at least.
                stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + SORT_BYTES, side="right"))
                stop = max(stop, at + 1)
                if stop < len(buckets):
                    back = int(np.searchsorted(buckets, buckets[stop]))
                    stop = back if back > at else int(np.searchsorted(buckets, buckets[at], side="right"))
                part = table.slice(at, stop - at)
                hits = repeated_starts(part.column("bytes").to_pylist(), part.column("starts").to_numpy(), length)
                copies = part.column("copies").to_numpy()
                found = [_ranges(h | (c > 1)) for h, c in zip(hits, copies)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("bucket").combine_chunks(), part.column("segment").combine_chunks(),
                     pa.array(found, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                    names=["bucket", "segment", "ranges"])
                at = stop
    return run


def _strings(length: int):
    """One row per start of a segment, with the digest of its string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["starts"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["bucket"]] * n, pa.int64()), pa.array([row["segment"]] * n, pa.int64()),
                     pa.array(range(n), pa.int32()), pa.array([row["copies"]] * n, pa.int64()),
                     pa.array([hashlib.blake2b(row["bytes"][i:i + length], digest_size=16).digest() for i in range(n)], pa.binary())],
                    names=["bucket", "segment", "lo", "copies", "string"])
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, probe: int = PROBE,
                   bucket_segments: int = BUCKET_SEGMENTS) -> DataFrame:
    """Rows (key, text) -> distinct rows (key, lo, hi): byte spans of the text
    that repeated strings cover; spans of a text may overlap."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(docs.mapInArrow(_find(length, probe), "key long, bucket long, segment long, first long, starts int, moves boolean"), "runs")
    buckets = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("segment").alias("a"),
                                            F.max("segment").alias("b"), F.max("moves").alias("moves"))
    buckets = buckets.filter("rows > 1 or moves").select("bucket", F.expr("a <> b or moves").alias("mixed"))
    buckets = materialize(buckets, "buckets")
    shared = materialize(found.join(growing(buckets), "bucket"), "shared")
    # A bucket of one segment: all its copies repeat.
    spans = shared.filter("not mixed").select("key", F.col("first").alias("lo"), (F.col("first") + F.col("starts") + (length - 1)).alias("hi"))
    mixed = shared.filter("mixed").drop("mixed")
    distinct = mixed.groupBy("bucket", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "first", "starts")).alias("at"))
    distinct = materialize(distinct, "segments")
    sizes = materialize(distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("segments")), "sizes")
    distinct = materialize(distinct.join(growing(sizes), "bucket").select(
        "bucket", "segment", "copies", "segments", "at.key", "at.first", "at.starts",
        (F.col("at.starts") + (length - 1)).alias("size")), "segments")
    found_ranges = []
    for large, keep in ((False, F.col("segments") <= bucket_segments), (True, F.col("segments") > bucket_segments)):
        chosen = distinct.filter(keep)
        if large and not chosen.limit(1).count():
            continue
        wanted = chosen.groupBy("key").agg(F.collect_list(F.struct("bucket", "segment", "copies", "starts", "first", "size")).alias("wanted"))
        wanted = materialize(wanted, "wanted")
        text = docs.select("key", F.col("text").cast("binary").alias("bytes")).join(growing(wanted), "key").select("bytes", "wanted")
        cut = text.mapInArrow(_cut, "bucket long, segment long, copies long, starts int, bytes binary")
        if large:
            strings = materialize(cut.mapInArrow(_strings(length), "bucket long, segment long, lo int, copies long, string binary").dropDuplicates(
                ["bucket", "segment", "lo"]), "strings")
            often = materialize(strings.groupBy("string").agg(F.sum("copies").alias("n")).filter("n > 1").select("string"), "often")
            found_ranges.append(strings.join(growing(often), "string").select("bucket", "segment", "lo", (F.col("lo") + 1).alias("hi")))
        else:
            ordered = cut.repartition(parts, "bucket").sortWithinPartitions("bucket", "segment")
            ranges = materialize(ordered.mapInArrow(_sort(length), "bucket long, segment long, ranges array<struct<lo:int,hi:int>>"), "ranges")
            found_ranges.append(ranges.select("bucket", "segment", F.explode("ranges").alias("r")).select("bucket", "segment", "r.lo", "r.hi"))
    for ranges in found_ranges:
        ranges = materialize(ranges, "found")
        spans = spans.unionByName(mixed.join(growing(ranges), ["bucket", "segment"]).select(
            "key", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + (length - 1)).alias("hi")))
    return spans.distinct()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept")}
        for text, spans in zip(batch.column("bytes"), batch.column("covered")):
            raw = memoryview(text.as_buffer())
            union: list[list[int]] = []
            for s in sorted((s["lo"], s["hi"]) for s in spans.as_py() or ()):
                if union and s[0] <= union[-1][1]:
                    union[-1][1] = max(union[-1][1], s[1])
                else:
                    union.append(list(s))
            kept, at = [], 0
            for lo, hi in union:
                kept.append(raw[at:lo])
                at = hi
            rows["n_bytes"].append(len(raw))
            rows["n_removed"].append(sum(hi - lo for lo, hi in union))
            rows["spans"].append([{"lo": lo, "hi": hi} for lo, hi in union])
            rows["kept"].append(b"".join([*kept, raw[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["n_removed"], pa.int64()),
             pa.array(rows["spans"], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(rows["kept"], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   probe: int = PROBE, bucket_segments: int = BUCKET_SEGMENTS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, spans`` (maximal
    removed runs, byte offsets ``lo`` to before ``hi`` of the original) and
    ``kept``, the bytes that stay (a run may end inside a character).

    Null texts count as empty; texts shorter than ``length`` keep all their
    bytes; rows with equal texts, repeated rows and null ids included, are
    texts of their own that repeat each other; other columns are not read; an
    empty table gives an empty result.  Rows are followed by a 64-bit hash of
    id and text."""
    keyed = as_frame(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select("key", "text"), length, probe, bucket_segments)
    covered = materialize(spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("covered")), "covered")
    texts = keyed.select("key", "doc_id", F.col("text").cast("binary").alias("bytes")).join(growing(covered), "key", "left")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "bytes", "covered").mapInArrow(
        _remove, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary")
