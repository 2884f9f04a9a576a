"""tillpoint: retail order analytics as Spark DataFrame jobs.

Layout:
  schema       table schemas, fixed value sets, contracts
  session      session defaults and lineage-cutting helpers
  functions/   column expressions (money rounding, trims, parsing, argument checks)
  sources/     table loading, test-data binding, CSV feed, run store
  operators/   distributed ranking / dense ids, table contracts
  plans/       the named queries, the feed load job, the placement job
  streaming/   file-drop feed watcher (Structured Streaming + foreachBatch)
"""

__version__ = "0.1.0"
