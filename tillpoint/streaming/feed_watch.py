"""File-drop directory watcher: every CSV file arriving in a directory is
loaded by the feed load job, exactly as a batch run on that file.

Structured Streaming tracks which files were seen (its checkpoint in the
shared checkpoint folder); ``foreachBatch`` hands each micro-batch's file
list (one row per file, bounded by ``maxFilesPerTrigger``) to
``load_feed``.  A micro-batch that is replayed after a failure loads its
files again with the same run ids, and ``load_feed`` returns the recorded
result of those that were committed.  The stream itself reads only the
files' names; a file with nothing but a header is a run like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillpoint.plans.feed_load import FeedLoadResult, load_feed
from tillpoint.session import checkpoint_dir, release_scratch, scratch_mark
from tillpoint.sources.store import RunStore
from tillpoint.sources.tables import Tables

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_feed_directory(spark: SparkSession, directory: str, tables: Callable[[], Tables], store: RunStore,
                         checkpoint: str | None = None, max_files_per_trigger: int = 16,
                         available_now: bool = False, processing_time: str = "30 seconds",
                         on_result: Callable[[FeedLoadResult], None] | None = None) -> StreamingQuery:
    """Start the watcher.  ``tables`` returns the current tables for each
    micro-batch (so lookups see newly added customers and products)."""
    checkpoint = checkpoint or f"{checkpoint_dir(spark)}/tillpoint/streams/feed_watch"
    files = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
             .option("maxFilesPerTrigger", max_files_per_trigger).option("pathGlobFilter", "*.csv")
             .load(directory)
             .select(F.col("path").alias("file_path")))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r[0] for r in batch.select("file_path").distinct().collect())
        for path in paths:
            run_id = f"s{batch_id}-" + hashlib.sha1(path.encode()).hexdigest()[:12]
            mark = scratch_mark()
            res = load_feed(tables(), path, store, run_id=run_id, source_name=path)
            if on_result:
                on_result(res)
            # The outputs are published: a running watcher keeps no scratch.
            release_scratch(spark, since=mark)

    writer = files.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
