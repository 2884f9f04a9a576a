"""Benchmark decontamination by shared word n-grams.

A benchmark of at most BLOCK_WINDOWS windows is broadcast as a hash set, and
each hit is verified on the words in the scan itself.  Of a larger one only a
bitmap of bounded size is broadcast: one scan cuts out the windows that
may occur, which are verified by a join on their words.  Either way every text is
scanned for windows once, and no broadcast grows with the benchmark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.llm.common import as_frame, col, free_name, growing, materialize, text_slices
from tillpoint.llm.text import Words, hash_words, split_words, window_hashes

WINDOW = 10
# Windows of a broadcast hash set (about 250 bytes each with their words).
BLOCK_WINDOWS = 100_000
# The bitmap of a larger benchmark: 32 bits a window, of which two are set, and
# at most 32 MB; above eight million windows more candidates pass it.
WINDOW_BITS = 32
MAX_BITS = 1 << 28
SLICE_BITS = 15
CANDIDATE_ROWS = 20_000


# A block: window length -> sorted hashes, and the windows' words -> items.
Block = tuple[dict[int, np.ndarray], dict[bytes, list[str]]]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Rows (words, length, item): each distinct window with an item it occurs in."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item").to_pylist()
            for first, texts in text_slices(batch.column("text")):
                w = split_words(texts)
                out = set()
                for d in range(len(texts)):
                    a, b = w.docs[d], w.docs[d + 1]
                    n = min(window, b - a)
                    out.update((w.joined(i, i + n), int(n), names[first + d]) for i in range(a, b - n + 1) if n)
                rows = sorted(out, key=lambda r: (r[0], str(r[2])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()),
                                                  pa.array([r[1] for r in rows], pa.int32()),
                                                  pa.array([r[2] for r in rows], pa.string())], names=["words", "length", "item"])

    items = as_frame(benchmark, item=id_col, text=text_col).select(F.col("item").cast("string").alias("item"), "text")
    return items.mapInArrow(cut, "words binary, length int, item string").distinct()


def _block(rows: list) -> Block:
    words: dict[bytes, list[str]] = {}
    by_length: dict[int, list[bytes]] = {}
    for r in rows:
        key = bytes(r["words"])
        if key not in words:
            by_length.setdefault(r["length"], []).append(key)
        words.setdefault(key, []).append(r["item"])
    lengths = {}
    for n, keys in by_length.items():
        w = split_words(pa.array([k.decode("utf-8", "surrogateescape") for k in keys], pa.large_string()))
        lengths[n] = np.unique(window_hashes(hash_words(w), n)[::1][w.docs[:-1]])
    return lengths, words


def _inside(found: np.ndarray, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of ``n`` words that start at the words ``found``, those that lie in
    one text, and their texts."""
    owner = np.searchsorted(w.docs, found, side="right") - 1
    whole = found + n <= w.docs[owner + 1]
    return found[whole], owner[whole]


def _maps(hit: np.ndarray, w: Words) -> list[bytes | None]:
    """A bitmap of each text's hit words, None without any; ``hit`` holds the
    steps of the number of occurrences over a word."""
    inside = np.cumsum(hit)[:-1] > 0
    parts = [inside[a:b] for a, b in zip(w.docs[:-1], w.docs[1:])]
    return [np.packbits(p).tobytes() if p.any() else None for p in parts]


def _hits(texts: pa.Array, block: Block) -> tuple[list, list[bytes | None], np.ndarray]:
    """Per text: the items with occurring windows, a bitmap of its words that
    are inside an occurrence, its number of words."""
    w = split_words(texts)
    hit = np.zeros(len(w.starts) + 1, dtype=np.int64)
    items: dict[int, set] = {}
    hashes = hash_words(w)
    lengths, words = block
    for n, wanted in lengths.items():
        found = window_hashes(hashes, n)
        place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
        at, owner = _inside(np.flatnonzero(wanted[place] == found) if len(wanted) else np.zeros(0, np.int64), w, n)
        for i, d in zip(at.tolist(), owner.tolist()):
            names = words.get(w.joined(i, i + n))
            if names:
                hit[i] += 1
                hit[i + n] -= 1
                items.setdefault(d, set()).update(names)
    return [items.get(d, set()) for d in range(len(texts))], _maps(hit, w), np.diff(w.docs)


def _filter(hashed: DataFrame, total: int) -> np.ndarray:
    """The bitmap of all window hashes, as bytes; at most MAX_BITS bits reach
    the driver."""
    bits = 1 << SLICE_BITS
    while bits < min(total * WINDOW_BITS, MAX_BITS):
        bits *= 2
    mask, low = F.lit(bits - 1).cast("long"), F.lit((1 << SLICE_BITS) - 1).cast("long")
    places = F.array(*[F.shiftrightunsigned("hash", k).bitwiseAND(mask) for k in (0, 32)])
    slices = (hashed.select(F.explode(places).alias("p"))
              .groupBy(F.shiftright("p", SLICE_BITS).alias("slice")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(low)).alias("bits")))
    out = np.zeros(bits // 8, np.uint8)
    size = (1 << SLICE_BITS) // 8
    for r in slices.toLocalIterator():
        out[r["slice"] * size:(r["slice"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bitmap) * 8 - 1)
    ok = np.ones(len(hashes), bool)
    for k in (0, 32):
        p = ((hashes >> np.uint64(k)) & mask).astype(np.int64)
        ok &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return ok


def _hashed(windows: DataFrame) -> DataFrame:
    """The hash of each window's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column("words").cast(pa.large_binary()).cast(pa.large_string())):
                lengths = batch.column("length").slice(first, len(texts)).to_numpy()
                w = split_words(texts)
                hashes = hash_words(w)
                out = np.zeros(len(texts), np.uint64)
                for n in np.unique(lengths):
                    out[lengths == n] = window_hashes(hashes, int(n))[w.docs[:-1][lengths == n]]
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["hash"])

    return windows.select("words", "length").mapInArrow(run, "hash long")


def _candidates(texts_of: DataFrame, lengths: list[int], shared) -> DataFrame:
    """Rows (key, at, length, words): the windows of each text, known by its
    digest, that pass the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                w = split_words(texts)
                hashes = hash_words(w)
                keys: dict[int, str] = {}
                for n in lengths:
                    at, owner = _inside(np.flatnonzero(_may_hold(shared.value, window_hashes(hashes, n))), w, n)
                    for d in np.unique(owner).tolist():
                        if d not in keys:
                            keys[d] = hashlib.sha256(texts[d].as_py().encode()).hexdigest()
                    for k in range(0, len(at), CANDIDATE_ROWS):
                        part, of = at[k:k + CANDIDATE_ROWS], owner[k:k + CANDIDATE_ROWS]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([keys[d] for d in of.tolist()], pa.string()), pa.array(part - w.docs[of], pa.int64()),
                             pa.array(np.full(len(part), n), pa.int32()),
                             pa.array([w.joined(i, i + n) for i in part.tolist()], pa.binary())], names=["key", "at", "length", "words"])

    return texts_of.mapInArrow(run, "key string, at long, length int, words binary")


def _with_hits(docs: DataFrame, windows: DataFrame, total: int, text_col: str) -> DataFrame:
    """``docs`` with two more columns: the occurrences (at, length) in a text and their
    items, null without any.  For a benchmark that is too large to be broadcast."""
    spark = docs.sparkSession
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())     # at most ``window`` values
    shared = spark.sparkContext.broadcast(_filter(_hashed(windows), total))
    # Copies of a text find the same: they are one from here on.
    maybe = materialize(_candidates(as_frame(docs, text=text_col), lengths, shared).distinct(), "candidates")
    found = materialize(maybe.join(growing(windows.select("words").distinct()), "words", "left_semi"), "occurrences")
    spans = found.groupBy("key").agg(F.collect_list(F.struct("at", "length")).alias("spans"))
    named = found.select("key", "words").distinct().join(growing(windows.filter("item is not null")), "words")
    items = named.select("key", "item").distinct().groupBy("key").agg(F.collect_list("item").alias("items"))
    hits = materialize(spans.join(growing(items), "key", "left"), "hits")
    key, spans, items = (free_name(docs, c) for c in ("key", "spans", "items"))
    hits = hits.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("items").alias(items))
    joined = docs.withColumn(key, F.sha2(col(text_col), 256)).join(growing(hits), key, "left")
    return joined.select(*[col(c) for c in docs.columns], spans, items)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW,
         block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with added columns ``n_words`` long, ``n_hit`` long (words
    inside an occurrence of a benchmark window), ``hit_items`` (sorted strings)
    and ``hit_words`` (bitmap of the hit words, null if none), and the names
    they got (lengthened if the caller's columns clash).

    A benchmark window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window.  Null and empty texts have no
    words.  Null item ids are left out of ``hit_items`` but still hit.  Repeated
    rows get equal results.  An empty benchmark hits nothing."""
    spark = docs.sparkSession
    names = {k: free_name(docs, k) for k in ("n_words", "n_hit", "hit_items", "hit_words")}
    added = T.StructType([T.StructField(names["n_words"], T.LongType()), T.StructField(names["n_hit"], T.LongType()),
                          T.StructField(names["hit_items"], T.ArrayType(T.StringType())),
                          T.StructField(names["hit_words"], T.BinaryType())])
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    total = windows.count()
    width, text_at = len(docs.columns), docs.columns.index(text_col)
    if total <= block_windows:
        shared = spark.sparkContext.broadcast(_block(windows.collect()))
        rows = docs

        def found(batch: pa.RecordBatch, texts: pa.Array) -> tuple[list, list[bytes | None], np.ndarray]:
            return _hits(texts, shared.value)
    else:
        rows = _with_hits(docs, windows, total, text_col)

        def found(batch: pa.RecordBatch, texts: pa.Array) -> tuple[list, list[bytes | None], np.ndarray]:
            w = split_words(texts)
            hit = np.zeros(len(w.starts) + 1, dtype=np.int64)
            for d, spans in enumerate(batch.column(width)):
                if spans.is_valid:
                    at, n = (spans.values.field(c).to_numpy() for c in ("at", "length"))
                    np.add.at(hit, w.docs[d] + at, 1)
                    np.add.at(hit, w.docs[d] + at + n, -1)
            return [x or [] for x in batch.column(width + 1).to_pylist()], _maps(hit, w), np.diff(w.docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(text_at)):
                part = batch.slice(first, len(texts))
                items, maps, counts = found(part, texts)
                hit = [int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) if m else 0 for m in maps]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(counts, pa.int64()), pa.array(hit, pa.int64()),
                     pa.array([sorted(x for x in s if x is not None) for s in items], pa.list_(pa.string())),
                     pa.array(maps, pa.binary())], names=[f"c{i}" for i in range(width + 4)])

    return _by_position(rows.mapInArrow, run, T.StructType([*docs.schema.fields, *added.fields])), names


def _by_position(apply, run, schema: T.StructType) -> DataFrame:
    """Spark matches Arrow columns by name; name them as the schema has them."""
    labels = [f.name for f in schema.fields]

    def named(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=labels)

    return apply(named, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark hit, with all their columns."""
    found, names = scan(docs, benchmark, **options)
    return found.filter(F.col(f"`{names['n_hit']}`") == 0).select(*[f"`{c}`" for c in docs.columns])


def cut_spans(text: str | None, hit_words: bytes | None) -> str | None:
    """``text`` without its hit words and what stands between two of them."""
    if text is None or not hit_words:
        return text
    raw = text.encode()
    w = split_words(pa.array([text], pa.large_string()))
    hit = np.unpackbits(np.frombuffer(hit_words, np.uint8), count=len(w.starts)).astype(bool)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        out.append(raw[at:w.starts[a]])
        at = int(w.ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, with the hit words cut out of their texts.  Null texts
    stay null, texts without a hit as they are; an empty table gives an empty result."""
    found, names = scan(docs, benchmark, text_col=text_col, **options)
    labels, width, text_at = docs.columns, len(docs.columns), docs.columns.index(text_col)
    found = found.select(*[f"`{c}`" for c in labels], f"`{names['hit_words']}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:width])
            texts = [cut_spans(t.as_py(), h.as_py()) for t, h in zip(columns[text_at], batch.column(width))]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    return found.mapInArrow(run, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
