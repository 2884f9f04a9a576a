"""Token-ID output: flat files of unsigned integers with 64-bit offsets.

Documents are range-partitioned by id and sorted; each task encodes its texts
and writes one shard of three files:

  NAME.bin   the token ids, little-endian uint16 or uint32, end id after each document
  NAME.idx   int64 little-endian, one more than documents: where each document starts in NAME.bin
  NAME.ids   Parquet with the documents' ids in the same order

A shard's name carries the attempt that wrote it, and only the shards that the
manifest lists count, so a lost or repeated task leaves nothing half-read.
The place of a shard in the whole corpus is the prefix sum of the shards'
token counts, from the manifest, which has one row per shard."""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.llm.common import as_frame, materialize, process_store, text_slices
from tillpoint.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# Distinct pieces whose ids a worker keeps, and bytes of text encoded at once.
KEPT_WORDS = 1_500_000
ENCODE_BYTES = 8 << 20
BATCH_ROWS = 2_000
# Lower-casing before NFC is not lower-casing after it: these small letters
# compose with these marks, their capitals do not.
SMALL_COMPOSES = "[HJTWY][^\\x00-\\x7F]*[\u0308\u030a\u030c\u0331\u0344]"


class Encoder:
    """Encodes batches through the tokenizers library, each distinct
    white-space-free piece of text once.

    Exact for tokenizers that lower-case, drop white space and split words
    between an ASCII letter and an ASCII sign, which ``pieces=True`` states;
    they may compose (NFC) first, see SMALL_COMPOSES.  Others encode whole texts.  Known pieces are kept
    as flat arrays: the pieces, where their ids start, how many they are."""

    def __init__(self, path: str, pieces: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not self.pieces:
            parts = [self._ids([t])[0] for t in texts.to_pylist()]
            counts = np.array([len(p) for p in parts], dtype=np.int64)
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts
        # Lower-casing A-Z and splitting off signs first leaves fewer distinct
        # pieces.  Not where that could make or break a special token.
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            lower = pc.if_else(pc.match_substring_regex(texts, SMALL_COMPOSES), texts, pc.ascii_lower(texts))
            texts = pc.replace_substring_regex(lower, r"([A-Za-z])([!-/:-@\[-`{-~])", r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self.known) > KEPT_WORDS:
            self.clear()
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(place))
        found = [self._ids(new.slice(i, 5_000).to_pylist()) for i in range(0, len(new), 5_000)]
        where = place.to_numpy(zero_copy_only=False)
        unknown = np.isnan(where) if where.dtype.kind == "f" else np.zeros(len(where), bool)
        which = np.where(unknown, 0, where).astype(np.int64)
        which[unknown] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.flat = np.concatenate([self.flat, *[f for f, _ in found]])
        self.size = np.concatenate([self.size, *[n for _, n in found]])
        first = np.cumsum(self.size) - self.size
        which = which[coded.indices.to_numpy(zero_copy_only=False)]
        per = self.size[which]
        at = np.concatenate([[0], np.cumsum(per)])
        pick = np.repeat(first[which] - at[:-1], per)
        pick += np.arange(at[-1])
        return self.flat[pick], np.diff(at[ends - (ends[0] if len(ends) else 0)])


def encoder(path: str, pieces: bool) -> Encoder:
    """The worker process's encoder: tasks go on with the pieces known so far."""
    store = process_store()
    if store.get("encoder_for") != (path, pieces):
        store["encoder"], store["encoder_for"] = Encoder(path, pieces), (path, pieces)
    return store["encoder"]


def shared_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI that pyarrow opens on every executor: a path
    without a scheme belongs to the cluster's default file system."""
    if ":/" not in folder:
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        folder = ("file://" if default.startswith("file:") else default.rstrip("/")) + folder
    return folder.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each document."""
    counts = counts.astype(np.int64)
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("name", T.StringType()),
                         T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, dtype: str = "uint16", pieces: bool = True,
                 shards: int | None = None) -> DataFrame:
    """Write ``docs`` in ascending id order under ``folder``; returns the
    manifest ``shard, name, docs, tokens, base`` (base: tokens of all shards
    before it).

    Null texts count as empty: one end id.  Null ids come first; rows that tie
    in their id are ordered by their text and all written.  An empty table
    writes no shard.  Other columns are not read.  A task holds a few batches
    of text, never a shard.  ``dtype`` must hold the vocabulary: an id beyond
    it fails the task."""
    spark = docs.sparkSession
    most = np.iinfo(dtype).max
    place = shared_uri(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        store, root = fs.FileSystem.from_uri(place)
        enc, tokens, rows, ids_file, out, idx = None, 0, 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if enc is None:
                enc = encoder(tokenizer_path, pieces)
                store.create_dir(root, recursive=True)
                out, idx = (store.open_output_stream(f"{root}/{name}.{e}") for e in ("bin", "idx"))
                id_stream = store.open_output_stream(f"{root}/{name}.ids")
                ids_file = pq.ParquetWriter(id_stream, pa.schema([batch.schema.field("doc_id")]))
                idx.write(np.zeros(1, "<i8").tobytes())
            for _, texts in text_slices(batch.column("text"), ENCODE_BYTES):
                ids, counts = with_end(*enc.encode(texts), end_id)
                if len(ids) and int(ids.max()) > most:
                    raise ValueError(f"token id {int(ids.max())} does not fit {dtype}")
                out.write(ids.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
                idx.write((tokens + np.cumsum(counts)).astype("<i8").tobytes())
                tokens += len(ids)
            ids_file.write_batch(batch.select(["doc_id"]))
            rows += batch.num_rows
        if enc is not None:
            ids_file.close()
            for stream in (id_stream, out, idx):
                stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "name": name, "docs": rows, "tokens": tokens}],
                schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    narrow = as_frame(docs, doc_id=id_col, text=text_col)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    # One row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, id_type: T.DataType,
                dtype: str = "uint16") -> DataFrame:
    """Read the files back, memory-mapped where the store is local: per
    document ``doc_id, start, n_tokens, ids_crc32`` (of the ids as
    little-endian uint32)."""
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    width = np.dtype(dtype).itemsize
    place = shared_uri(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(place)
        for shard in (row for b in batches for row in b.to_pylist()):
            stem = f"{root}/{shard['name']}"
            if isinstance(store, fs.LocalFileSystem):
                tokens = np.memmap(f"{stem}.bin", dtype=np.dtype(dtype).newbyteorder("<"), mode="r")
                offsets = np.memmap(f"{stem}.idx", dtype="<i8", mode="r")
                source = None
            else:
                source = store.open_input_file(f"{stem}.bin")
                with store.open_input_stream(f"{stem}.idx") as f:
                    offsets = np.frombuffer(f.read(), dtype="<i8")
            at = 0
            with store.open_input_file(f"{stem}.ids") as f:
                for piece in pq.ParquetFile(f).iter_batches(batch_size=BATCH_ROWS):
                    here = np.asarray(offsets[at:at + piece.num_rows + 1])
                    crcs = []
                    for a, b in zip(here[:-1], here[1:]):
                        if source is None:
                            ids = tokens[a:b]
                        else:
                            ids = np.frombuffer(source.read_at(int(b - a) * width, int(a) * width),
                                                dtype=np.dtype(dtype).newbyteorder("<"))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), pa.array(here[:-1] + shard["base"], pa.int64()),
                         pa.array(np.diff(here), pa.int64()), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at += piece.num_rows

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "shard").mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = END_ID, dtype: str = "uint16") -> DataFrame:
    """Write token files into the shared scratch folder and read them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(docs, folder, tokenizer_path, id_col, text_col, end_id, dtype)
    return read_tokens(spark, folder, manifest, docs.schema[id_col].dataType, dtype)
