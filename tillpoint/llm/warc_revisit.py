"""Resolution of not-modified revisit records of a web archive.

A revisit record carries no payload; it stands for the latest earlier full
response to the same canonical URL.  The as-of join sorts all records by
(URL, time) into range partitions, so a URL with any share of the records is
spread over several; inside a partition a window finds the last response, and
one row per partition carries it across partition borders.  The response found
counts only if the revisit's validators agree with it, and the headers that a
not-modified answer may change are merged into the stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import growing, materialize

# Query parameters that do not select content, and headers that describe the
# stored payload and so are never taken from a not-modified answer.
TRACKING = r"^(ref|utm_[a-z]+|fbclid|gclid|sessionid)(=|$)"
PAYLOAD_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding")


def canonical_url(url: Column) -> Column:
    """Host (lower case, without ``www.`` and default port), path (without
    slashes at its end), and the sorted parameters that are no tracking
    parameters; scheme and fragment are dropped.  Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    asked = F.array_join(F.array_sort(asked), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))


def _plain_etag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def latest_earlier(records: DataFrame) -> DataFrame:
    """Rows (record_id, url, time, full) -> (record_id, target) for every row
    that is not full and has a url and a time: the full row of the same url with
    the largest time below its own (of several, the largest record_id); null if
    there is none.  Where record_ids repeat, a column ``row`` tells rows apart
    and is returned in place of record_id."""
    told = "row" if "row" in records.columns else "record_id"
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # At equal times a revisit comes before responses, which are not earlier.
    order = ["url", "time", "full", "record_id"]
    placed = records.filter("url is not null and time is not null").select(*dict.fromkeys([*order, told]))
    placed = placed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "placed")
    answer = F.when(F.col("full"), F.struct("time", "record_id"))
    # At most one row per partition: the url that it starts with.
    starts = materialize(placed.groupBy("part").agg(F.min("url").alias("url")), "starts")
    heads = starts.select("url").distinct()
    tails = placed.filter("full").join(F.broadcast(heads), "url", "left_semi").groupBy("part", "url").agg(F.max(answer).alias("tail"))
    borders = starts.select("part", "url", F.lit(None).cast("struct<time:long,record_id:long>").alias("tail")).unionByName(tails)
    borders = borders.groupBy("part", "url").agg(F.max("tail").alias("tail"))
    earlier = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(borders.withColumn("carried", F.last("tail", ignorenulls=True).over(earlier)).select("part", "url", "carried"), "carried")
    before = Window.partitionBy("part", "url").orderBy("time", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("inside", F.last(answer, ignorenulls=True).over(before)).filter("not full")
    return inside.join(carried, ["part", "url"], "left").select(told, F.coalesce("inside", "carried")["record_id"].alias("target"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records ``record_id, url, time, kind`` ('response' or 'revisit'),
    ``etag, last_modified, digest, headers`` (map) -> one row per revisit:
    ``record_id, target, outcome, validator, digest, headers``.

    outcome: 'resolved'; 'mismatch' (the response found has other validators);
    'unverified' (no validator on both sides); 'missing' (no earlier response,
    or no url or time).  The validators are tried in the order etag (weak
    comparison), last_modified, digest; the first that both records have
    decides.  ``digest`` and ``headers`` are those of the restored record: the
    stored headers, with the revisit's for all names that do not describe the
    payload; null unless resolved.

    Null headers count as none; kinds other than the two are ignored.  Each
    revisit row is answered once, repeated ones and those without a record_id
    too; of responses that share a record_id the least by its values counts in
    the answers.  An empty table gives an empty result.  Payloads are not read,
    so their length does not matter; other columns are dropped."""
    of = ("etag", "last_modified", "digest", "headers")
    # Rows are numbered where they are written.
    rows = materialize(records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url"), F.col("time").cast("long").alias("time"), "kind", *of,
        F.monotonically_increasing_id().alias("row")), "records")
    found = latest_earlier(rows.select("row", "record_id", "url", "time", (F.col("kind") == "response").alias("full")))
    found = materialize(found, "found")
    revisits = rows.filter("kind = 'revisit'").select("row", "record_id", *of)
    old = F.struct(*[F.col(c).alias(f"old_{c}") for c in of])
    entries = F.array_sort(F.map_entries("headers"))
    stored = rows.filter("kind = 'response' and record_id is not null").groupBy(F.col("record_id").alias("target")).agg(
        F.min_by(old, F.struct("etag", "last_modified", "digest", entries)).alias("old")).select("target", "old.*")
    asked = materialize(revisits.join(growing(found), "row", "left"), "asked")
    both = asked.join(growing(stored), "target", "left")
    tests = [("etag", _plain_etag(F.col("etag")) == _plain_etag(F.col("old_etag"))),
             ("last_modified", F.col("last_modified") == F.col("old_last_modified")), ("digest", F.col("digest") == F.col("old_digest"))]
    validator = F.coalesce(*[F.when(t.isNotNull(), F.lit(n)) for n, t in tests])
    agrees = F.coalesce(*[t for _, t in tests])
    outcome = (F.when(F.col("target").isNull(), "missing").when(agrees.isNull(), "unverified")
               .when(agrees, "resolved").otherwise("mismatch"))
    none = F.create_map().cast("map<string,string>")
    lower = lambda m: F.transform_keys(F.coalesce(m, none), lambda k, _: F.lower(k))
    new = F.map_filter(lower(F.col("headers")), lambda k, _: ~k.isin(*PAYLOAD_HEADERS))
    old = F.map_filter(lower(F.col("old_headers")), lambda k, _: ~F.map_contains_key(new, k))
    done = both.withColumn("outcome", outcome).withColumn("validator", F.when(F.col("target").isNotNull(), validator))
    restored = F.col("outcome") == "resolved"
    return done.select("record_id", "target", "outcome", "validator", F.when(restored, F.col("old_digest")).alias("digest"),
                       F.when(restored, F.map_concat(old, new)).alias("headers"))


def restore(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """The resolved revisits with the payload (target, payload) they stand for."""
    return resolved.filter("outcome = 'resolved'").join(payloads, "target")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records made from the table of pages: a response per page at
    time page_id and a later revisit to another spelling of its URL, with a
    strong, weak, outdated or no etag."""
    body = F.coalesce("html", F.lit(""))
    digest = F.md5(body)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    seen = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long")
    pages = pages.select("page_id", "url", digest.alias("digest"), tag.alias("tag"), F.octet_length(body).alias("size"), seen.alias("seen"))
    text = lambda c: c.cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("time"), F.lit("response").alias("kind"),
        F.col("tag").alias("etag"), (F.col("page_id") % 1000).alias("last_modified"), "digest",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.col("size")),
                     F.lit("ETag"), F.col("tag"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    kind = F.col("seen") % 4
    etag = F.when(kind == 0, F.col("tag")).when(kind == 1, F.concat(F.lit("W/"), "tag")).when(kind == 2, F.lit('"outdated"'))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^http://", "https://"), F.lit("#again")).alias("url"),
        (F.col("page_id") + 1 + F.col("seen") % 5000).alias("time"), F.lit("revisit").alias("kind"), etag.alias("etag"),
        F.when(kind == 3, F.col("page_id") % 1000).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"),
                     F.lit("date"), text(F.col("page_id") + F.col("seen") % 5000)).alias("headers"))
    return response.unionByName(revisit)


REVISIT_SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
         CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) AS seen FROM pages),
spelled AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM base),
canon AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(ref|utm_[a-z]+|fbclid|gclid|sessionid)(=|$)'))) AS asked
  FROM spelled),
keyed AS (
  SELECT *, '"' || substr(digest, 1, 16) || '"' AS tag,
         host || CASE WHEN path = '' THEN '/' ELSE path END
              || CASE WHEN len(asked) = 0 THEN '' ELSE '?' || array_to_string(asked, '&') END AS curl
  FROM canon),
found AS (
  SELECT v.page_id, v.seen, v.page_id + 1 + v.seen % 5000 AS moment, v.tag, r.page_id AS target, r.tag AS old_tag, r.digest, r.size
  FROM keyed v ASOF LEFT JOIN keyed r ON v.curl = r.curl AND v.page_id + 1 + v.seen % 5000 > r.page_id),
judged AS (
  SELECT *, CASE WHEN target IS NULL THEN 'missing'
                 WHEN CASE seen % 4 WHEN 2 THEN false WHEN 3 THEN page_id % 1000 = target % 1000 ELSE tag = old_tag END
                 THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found)
SELECT page_id, outcome, target AS target_page,
       CASE WHEN outcome = 'missing' THEN NULL WHEN seen % 4 = 3 THEN 'last_modified' ELSE 'etag' END AS validator,
       CASE WHEN outcome = 'resolved' THEN digest END AS payload_md5,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || size || chr(10)
            || 'content-type: text/html' || chr(10) || 'date: ' || (moment - 1) || chr(10) || 'etag: ' || old_tag END AS headers
FROM judged"""
