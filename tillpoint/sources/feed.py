"""Order feed source: CSV with a header, every column read as text and
bound by header name, plus the record number of each row in its file.

Record numbers (``row_num`` = index + 2, the header being line 1) are
computed without a global window: the scan tags each row with its split
(file, block start) and a per-task counter; one small aggregate gives the
row count and first counter of every split (one row per split, the same
order of magnitude as the scan's task list); offsets per file are prefix
sums over the splits in block order; a broadcast join of that split table
adds them back.  Files are split normally, so a large feed is read by many
tasks.  A folder may hold files whose headers order the columns differently:
each group of equal headers is read with its own.  Of a header only the file's first
bytes are read.

Quoted fields may hold line breaks with ``multiline=True``.  A split cannot tell
whether it begins inside quotes, but the number of quotes before it can: it
does if that is odd.  A first pass counts, for each split, its quotes and the
records that begin in it in either case; the prefix XOR over a file's splits
settles which case holds, and the prefix sum gives the record numbers.  The second pass
numbers each line's record and puts the lines of a record together; only the lines of
records that lie in two splits are grouped again."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tillpoint.schema import FEED_COLUMNS
from tillpoint.session import shuffles_dropped

HEADER_BYTES = 1 << 12
HEADER_READERS = 16


class _Headers:
    """Reads the headers of files.  What does not depend on the file is looked up
    once: a folder may hold very many small files."""

    def __init__(self, spark: SparkSession):
        hadoop = spark._jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()
        self.path, self.uri = hadoop.fs.Path, spark._jvm.java.net.URI
        self.codecs = hadoop.io.compress.CompressionCodecFactory(self.conf)
        self.systems: dict[str, object] = {}
        self.codec_of: dict[str, object] = {}

    def _open(self, file: str):
        path = self.path(self.uri(file))
        # One file system for all paths of a scheme and host; the codec follows from the end of the name.
        host, ending = file[:file.find("/", file.find("://") + 3)], file.rpartition("/")[2].rpartition(".")[2]
        if host not in self.systems:
            self.systems[host] = path.getFileSystem(self.conf)
        if ending not in self.codec_of:
            self.codec_of[ending] = self.codecs.getCodec(path)
        stream, codec = self.systems[host].open(path), self.codec_of[ending]
        return stream if codec is None else codec.createInputStream(stream)

    def read(self, file: str) -> tuple[str, bool]:
        """The first record of a file that is not empty, from its first bytes, and whether
        its lines end with a carriage return."""
        stream = self._open(file)
        raw, start = b"", 0
        try:
            while True:
                more = bytes(stream.readNBytes(HEADER_BYTES))
                raw += more
                while (end := raw.find(b"\n", start)) >= 0 and raw[:end].count(b'"') % 2:
                    start = end + 1
                if end >= 0 and not raw[:end].strip(b"\r\n\xef\xbb\xbf"):
                    raw, start = raw[end + 1:], 0
                elif end >= 0 or not more:
                    record = raw[:end] if end >= 0 else raw
                    return record.decode("utf-8", "replace").strip("\ufeff\r"), record.endswith(b"\r")
        finally:
            stream.close()


def _header_groups(spark: SparkSession, files: list[str]) -> dict[tuple[str, bool], list[str]]:
    """The files, grouped by their header."""
    groups: dict[tuple[str, bool], list[str]] = {}
    headers = _Headers(spark)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for file, header in zip(files, pool.map(headers.read, files)):
            groups.setdefault(header, []).append(file)
    return {h: sorted(g) for h, g in sorted(groups.items())}


def _listed(reader: Callable[[str], DataFrame], path: str) -> DataFrame:
    """The files under a path as ``reader`` reads them; they are listed here."""
    try:
        return reader(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"CSV file not found: {path}") from e
        raise


def _require(columns: list[str]) -> None:
    missing = [c for c in FEED_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"Feed header lacks columns: {', '.join(missing)}")


_CSV_IN = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def scan_order_feed(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """FEED_COLUMNS + source_file + split tags (_block, _mid), taken right
    at the scan.  ``number_rows`` turns the tags into record numbers, also
    after the rows went through joins or were written out.  Columns are bound
    by the header of each file.  With ``multiline`` the rows are numbered already (row_num, feed_seq)."""
    if multiline:
        return _scan_quoted(spark, sorted(_listed(spark.read.text, path).inputFiles()))
    reader = spark.read.options(header=True, inferSchema=False, **_CSV_IN)
    # Columns by their place, so that what was listed serves files of any header.
    scanned = _listed(reader.schema(_places(len(FEED_COLUMNS))).csv, path)
    reader = spark.read.options(header=True, inferSchema=False, **_CSV_IN)
    files = sorted(scanned.inputFiles())
    groups = _header_groups(spark, files) if len(files) > 1 else {}
    # Line ends do not matter here: files of one header are read together.
    by_header: dict[str, list[str]] = {}
    for (header, _), group in groups.items():
        by_header.setdefault(header, []).extend(group)
    if len(by_header) > 1:
        return _bind(scanned, reader, path, list(by_header.values()))
    named = reader.csv(path)
    _require(named.columns)
    return named.select(*[F.col(c) for c in FEED_COLUMNS], *_split_tags())


def _places(n: int) -> str:
    return ", ".join(f"_at{i} string" for i in range(n))


def _split_tags() -> list[Column]:
    return [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_mid")]


def _bind(scanned: DataFrame, reader, path: str, groups: list[list[str]]) -> DataFrame:
    """Files of several headers from one scan, so that a folder is listed once however
    many files it holds: a file's header tells which place each column has in it."""
    spark = scanned.sparkSession
    jvm = spark._jvm
    headers = [reader.csv(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(g[0])).toString()).columns for g in groups]
    for names in headers:
        _require(names)
    width = max(len(names) for names in headers)
    if width > len(FEED_COLUMNS):
        scanned = reader.schema(_places(width)).csv(path)
    places = [f"_at{i}" for i in range(width)]
    scanned = scanned.select(*places, F.input_file_name().alias("_path"), *_split_tags())
    table = spark.createDataFrame([(file, k) for k, g in enumerate(groups) for file in g], "_path string, _header int")
    found = scanned.join(F.broadcast(table), "_path", "left")

    def bound(column: str) -> Column:
        at = F.when(F.col("_header").isNull(), F.raise_error(F.concat(F.lit("file without a header that was read: "), F.col("_path"))))
        for k, names in enumerate(headers):
            at = at.when(F.col("_header") == k, F.col(places[names.index(column)]))
        return at.alias(column)
    return found.select(*[bound(c) for c in FEED_COLUMNS], "source_file", "_block", "_mid")


def _runs(batch: pa.RecordBatch) -> list[tuple[tuple, int, int]]:
    """(split, from, to) of the rows of each split in a batch: it holds one
    split's lines after another's."""
    n = batch.num_rows
    columns = [batch.column(c) for c in ("source_file", "_block")]
    cuts = [pc.not_equal(c.slice(1), c.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False).astype(bool) for c in columns]
    edges = [0, *(int(i) + 1 for i in np.flatnonzero(cuts[0] | cuts[1])), n]
    return [(tuple(c[a].as_py() for c in columns), a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _line_states(values: pa.Array, runs: list, state: dict, crlf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line: whether it begins inside quotes, whether it ends so, and
    whether it is empty.  ``state``: quote parity of the split being read."""
    quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.less_equal(pc.binary_length(pc.utf8_rtrim(values, "\r") if crlf else values), 0).to_numpy(zero_copy_only=False)
    begins = np.zeros(len(quotes), bool)
    ends = np.zeros(len(quotes), bool)
    for key, a, b in runs:
        after = (np.cumsum(quotes[a:b]) + state.setdefault(key, 0)) % 2 == 1
        ends[a:b] = after
        begins[a], begins[a + 1:b] = state[key] % 2 == 1, after[:-1]
        state[key] = int(after[-1])
    return begins, ends, empty


def _count_splits(crlf: bool):
    """Rows (source_file, _block, quotes, even, odd) of the splits: parity of
    the quotes, records that begin if an even or an odd number came before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        state: dict = {}
        for batch in batches:
            runs = _runs(batch)
            begins, _, empty = _line_states(batch.column("value"), runs, state, crlf)
            for key, a, b in runs:
                row = found.setdefault(key, [0, 0])
                row[0] += int((~begins[a:b] & ~empty[a:b]).sum())
                row[1] += int((begins[a:b] & ~empty[a:b]).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
             pa.array([state[k] for k in found], pa.int32()), pa.array([v[0] for v in found.values()], pa.int64()),
             pa.array([v[1] for v in found.values()], pa.int64())], names=["source_file", "_block", "quotes", "even", "odd"])
    return run


# Bytes of an unfinished record that a task keeps; the lines of a longer one go out as pieces.
HELD_BYTES = 16 << 20
_PIECES = ["value", "source_file", "_block", "_mid", "row_num", "whole"]


def _number_lines(before: dict, crlf: bool):
    """Records with their number.  The lines of a record are put together where
    they are; those of a record that begins or ends in another split come one by
    one (not ``whole``).  Empty lines between records go."""
    def pieces(lines: list[pa.Array], rows: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([lines[0], *(x.take(at) for x in lines[1:]), pa.array(whole)], names=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {key: parity for key, (parity, _) in before.items()}
        number = {key: n for key, (_, n) in before.items()}
        held, held_starts = None, None                       # lines of the record that is open
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = _runs(batch)
            begins, ends, empty = _line_states(batch.column("value"), runs, state, crlf)
            starts = ~begins & ~empty
            record = np.zeros(batch.num_rows, np.int64)
            fresh = np.zeros(batch.num_rows, bool)           # first line of a split in this batch
            for key, a, b in runs:
                record[a:b] = number[key] + np.cumsum(starts[a:b])
                number[key] = int(record[b - 1])
                fresh[a] = a > 0
            value = batch.column("value")
            value = pc.replace_substring_regex(value, "\r$", "") if crlf else value
            kept = begins | ~empty
            # A split whose first line goes begins with the next one.
            split = np.cumsum(fresh)[kept]
            lines = [x.filter(pa.array(kept)) for x in (value, *(batch.column(c) for c in ("source_file", "_block", "_mid")), pa.array(record))]
            starts, ends, split = starts[kept], ends[kept], split.astype(np.int64)
            if held is not None:
                first = (held[1][0].as_py(), held[2][0].as_py())
                split = np.concatenate([np.full(len(held[0]), 0 if first == runs[0][0] else -1), split])
                starts, ends = np.concatenate([held_starts, starts]), np.concatenate([np.ones(len(held_starts), bool), ends])
                lines = [pa.concat_arrays([h, x]) for h, x in zip(held, lines)]
                held = None
            n = len(starts)
            if not n:
                continue
            head = starts.copy()
            head[0] = True
            head[1:] |= split[1:] != split[:-1]
            group = np.flatnonzero(head)
            upto = np.append(group[1:], n)
            # The last record goes on in the next batch, if its lines are few enough to wait.
            if ends[-1] and starts[group[-1]] and lines[0].slice(group[-1]).nbytes <= HELD_BYTES:
                a = int(group[-1])
                held, held_starts = [x.slice(a) for x in lines], starts[a:]
                group, upto, n = group[:-1], upto[:-1], a
            whole = starts[group] & ~ends[upto - 1]
            if whole.any():
                # One list of lines for each group; those that are not whole are joined in vain and dropped.
                offsets = pa.array(np.append(group, n).astype(np.int32))
                text = pc.binary_join(pa.ListArray.from_arrays(offsets, lines[0].slice(0, n)), "\n").filter(pa.array(whole))
                yield pieces([text, *lines[1:]], group[whole], np.ones(int(whole.sum()), bool))
            part = np.flatnonzero(np.repeat(~whole, upto - group))
            if len(part):
                yield pieces([lines[0].take(pa.array(part)), *lines[1:]], part, np.zeros(len(part), bool))
        if held is not None:
            yield pieces(held, np.arange(len(held[0])), np.zeros(len(held[0]), bool))
    return run


def _scan_quoted(spark: SparkSession, files: list[str]) -> DataFrame:
    """The feed with line breaks in quotes: FEED_COLUMNS, source_file, row_num, feed_seq.

    A record that spans lines is put together in one row; a quote that is never closed
    makes one record of the rest of its file, as in any CSV reader."""
    parts, totals = [], {}
    for (header, crlf), group in _header_groups(spark, files).items():
        names = next(csv.reader([header]), []) if header else []
        _require(names)
        lines = spark.read.option("lineSep", "\n").text(group).select(
            "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_mid"))
        splits = lines.drop("_mid").mapInArrow(_count_splits(crlf), "source_file string, _block long, quotes int, even long, odd long").collect()
        before, running = {}, {}
        for r in sorted(splits, key=lambda r: (r["source_file"], r["_block"])):
            parity, n = running.get(r["source_file"], (0, 0))
            before[r["source_file"], r["_block"]] = (parity, n)
            running[r["source_file"]] = (parity ^ r["quotes"], n + (r["odd"] if parity else r["even"]))
        totals |= {file: n for file, (_, n) in running.items()}
        # A record lies in two splits, or is open at the end of its file, only after an odd number of quotes.
        crossing = any(parity for parity, _ in [*before.values(), *running.values()])
        numbered = lines.mapInArrow(_number_lines(before, crlf), "value string, source_file string, _block long, _mid long, row_num long, whole boolean")
        records = numbered.filter("whole").select("source_file", "row_num", "value")
        if crossing:
            several = numbered.filter(~F.col("whole")).groupBy("source_file", "row_num").agg(
                F.array_sort(F.collect_list(F.struct("_block", "_mid", "value"))).alias("lines"))
            records = records.unionByName(
                several.select("source_file", "row_num", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value")))
        fields = ", ".join(f"c{i} string" for i in range(len(names)))
        row = F.from_csv("value", fields, _CSV_IN).alias("row")
        records = records.filter("row_num > 1").select("source_file", "row_num", row)
        parts.append(records.select(*[F.col(f"row.c{names.index(c)}").alias(c) for c in FEED_COLUMNS], "source_file", "row_num"))
    # Rows before each file, files by name; one row per file.
    offsets, passed = [], 0
    for file in sorted(totals):
        offsets.append((file, passed))
        passed += max(totals[file] - 1, 0)
    table = spark.createDataFrame(offsets, "source_file string, _overall long")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(table), "source_file").withColumn(
        "feed_seq", F.col("row_num") - 1 + F.col("_overall")).drop("_overall")


def number_rows(tagged: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Replace the split tags by ``row_num`` (index in its file + 2) and
    ``feed_seq`` (position over all files of the run, files by name), which
    is unique when a folder holds several files.  ``files``: the table of
    ``number_files``, if files are numbers; their names are put back."""
    spark = tagged.sparkSession
    key = ["source_file", "_block"] if files is None else ["_file", "_block"]
    splits = (tagged.groupBy(*key)
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_mid0"))
              .collect())
    names = {} if files is None else {r["_file"]: r["source_file"] for r in files.collect()}
    if files is not None and any(r["_file"] is None for r in splits):
        return number_rows(name_files(tagged, files))
    offsets, running, overall = [], {}, 0
    file_of = (lambda r: r["source_file"]) if files is None else (lambda r: names[r["_file"]])
    for r in sorted(splits, key=lambda r: (file_of(r), r["_block"])):
        file = file_of(r)
        before = running.get(file, 0)
        offsets.append((r[0], file, r["_block"], r["_mid0"], before, overall))
        running[file] = before + r["_n"]
        overall += r["_n"]
    table = spark.createDataFrame(
        offsets, f"_key {'string' if files is None else 'int'}, source_file string, _block long, _mid0 long, _before long, _overall long")
    # The name comes from the splits: no row looks its file up by text where it is a number.
    table = table.drop("source_file").withColumnRenamed("_key", "source_file") if files is None else table.withColumnRenamed("_key", "_file")
    out = (tagged if files is None else tagged.drop("source_file")).join(F.broadcast(table), key)
    local = F.col("_mid") - F.col("_mid0")
    return out.withColumn("row_num", local + F.col("_before") + 2) \
              .withColumn("feed_seq", local + F.col("_overall") + 1) \
              .drop("_block", "_mid", "_mid0", "_before", "_overall", "_file")


def read_order_feed(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Columns: order_id ... status (strings), source_file, row_num."""
    feed = scan_order_feed(spark, path, multiline)
    return (feed if multiline else number_rows(feed)).select(*FEED_COLUMNS, "source_file", "row_num", "feed_seq")


def write_order_feed(feed: DataFrame, path: str) -> None:
    """Write a feed DataFrame (FEED_COLUMNS, ordered by row_num) as one CSV
    file with a header, in row order (test and benchmark input)."""
    (feed.orderBy("row_num").select(*FEED_COLUMNS).coalesce(1)
     .write.mode("overwrite").options(**_CSV_OUT).csv(path))


_CSV_OUT = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False}


def number_files(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned feed with ``_file``, a number, in place of its long
    ``source_file``, and the table of the numbers for ``name_files``.  The text
    stays where a file is not in the list of the scan's files."""
    # The list writes file:///folder where a row's metadata has file:/folder.
    names = [re.sub("^file:///", "file:/", f) for f in tagged.inputFiles()]
    table = tagged.sparkSession.createDataFrame(list(enumerate(sorted(names))), "_file int, source_file string")
    short = tagged.join(F.broadcast(table), "source_file", "left")
    return short.withColumn("source_file", F.when(F.col("_file").isNull(), F.col("source_file"))), table


def name_files(short: DataFrame, table: DataFrame) -> DataFrame:
    """``source_file`` again in place of ``_file``."""
    named = short.join(F.broadcast(table.withColumnRenamed("source_file", "_path")), "_file", "left")
    return named.withColumn("source_file", F.coalesce("_path", "source_file")).drop("_file", "_path")


def write_feed_files(feed: DataFrame, root: str, rows_per_file: int) -> None:
    """Write a feed DataFrame (FEED_COLUMNS + row_num from 2 on) as a folder
    of gzip CSV files of ``rows_per_file`` consecutive rows each, every second one
    with its columns in reverse order."""
    spark, at = feed.sparkSession, F.col("row_num") - 2
    cut = feed.withColumn("chunk", F.format_string("%06d", F.floor(at / rows_per_file).cast("long")))
    for odd, columns in ((0, FEED_COLUMNS), (1, FEED_COLUMNS[::-1])):
        part = cut.filter(F.floor(at / rows_per_file) % 2 == odd)
        with shuffles_dropped(spark):
            (part.repartition("chunk").sortWithinPartitions("chunk", "row_num").select(*columns, "chunk")
             .write.mode("overwrite").partitionBy("chunk").options(compression="gzip", **_CSV_OUT).csv(f"{root}/side={odd}"))
