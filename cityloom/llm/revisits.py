"""Resolving WARC revisit records whose server answered "not modified".

A revisit takes its content from the latest earlier full response with the same canonical URL (an as-of join). The
validators must agree: entity tags by weak comparison where the revisit has one, else the last-modified dates. The
headers of the result are those of the response, updated by the ones that a not-modified answer may carry; headers
that describe the stored bytes stay.

Records of a URL are cut into time buckets: each bucket is walked apart, and what a bucket passes on is one record, so
a URL with a third of all records is no single task. Payloads do not travel through the join; ``payload_id`` names
the record that holds them.

Columns read: record_id, url, captured_at (long), kind ("response" or "revisit"), status (int), headers (raw lines
"name: value"). A full response has status 200. Null urls match nothing. Records at the same time: a response does not
count as earlier than a revisit of its time; among responses of one time the largest record_id is the latest. Null headers are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scale import materialise

#: Headers that a 304 answer may update (fixed values).
UPDATED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
BUCKET_RECORDS = 1 << 16
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref|sessionid|sid|phpsessid|jsessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www., m. or the default port, no scheme, fragment, tracking parameters, index page or
    trailing slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^(?:www\d*|m)\.|:(?:80|443)$", "")
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"(?:/index\.[a-z]+)?/*$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(u, r"\?(.*)$", 1)), rf"(?i)&{TRACKING}=[^&]*", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def header_map(raw: Column) -> Column:
    """Raw header lines as a map with lower-case names; the last of repeated names counts."""
    lines = F.filter(F.split(F.coalesce(raw, F.lit("")), r"\r?\n"), lambda s: F.instr(s, ":") > 1)
    pairs = F.transform(lines, lambda s: F.struct(F.lower(F.trim(F.substring_index(s, ":", 1))).alias("k"), F.trim(F.substr(s, F.instr(s, ":") + 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def strong(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, outcome ("resolved", "changed" or "unmatched"), payload_id (the
    response, when resolved) and headers (merged when resolved, else the revisit's own)."""
    rows = records.select("record_id", "captured_at", canonical_url(F.col("url")).alias("canonical_url"),
                          ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"), (F.col("kind") == "revisit").alias("revisit"), header_map(F.col("headers")).alias("headers"))
    rows = materialise(rows.where("full OR revisit"), "records")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("captured_at"), F.max("captured_at")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, -(-n // BUCKET_RECORDS))))
    rows = rows.withColumn("bucket", F.floor((F.col("captured_at") - F.lit(low or 0)) / width))
    response = F.when(F.col("full"), F.struct("captured_at", "record_id"))
    ends = rows.where("full AND canonical_url IS NOT NULL").groupBy("canonical_url", "bucket").agg(F.max(F.struct("captured_at", "record_id")).alias("last"))
    passed = F.last("last", True).over(W.partitionBy("canonical_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    slots = rows.where("canonical_url IS NOT NULL").select("canonical_url", "bucket").distinct().join(ends, ["canonical_url", "bucket"], "left")
    slots = slots.select("canonical_url", "bucket", passed.alias("before"))
    earlier = F.max(response).over(W.partitionBy("canonical_url", "bucket").orderBy("captured_at").rangeBetween(W.unboundedPreceding, -1))
    found = (rows.withColumn("here", earlier).where("revisit").join(slots, ["canonical_url", "bucket"], "left")
             .select("record_id", "canonical_url", "headers", F.when(F.col("canonical_url").isNotNull(), F.coalesce("here", "before"))["record_id"].alias("full_id")))
    responses = rows.where("full").select(F.col("record_id").alias("full_id"), F.col("headers").alias("stored"))
    joined = found.join(responses, "full_id", "left")
    tag, old = strong(F.try_element_at("headers", F.lit("etag"))), strong(F.try_element_at("stored", F.lit("etag")))
    date, was = F.try_element_at("headers", F.lit("last-modified")), F.try_element_at("stored", F.lit("last-modified"))
    agrees = F.when(tag.isNotNull() & old.isNotNull(), tag == old).otherwise(F.when(date.isNotNull() & was.isNotNull(), date == was).otherwise(F.lit(False)))
    outcome = F.when(F.col("full_id").isNull(), "unmatched").when(agrees, "resolved").otherwise("changed")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*UPDATED))
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(allowed, k))
    return (joined.withColumn("outcome", outcome)
            .select("record_id", "canonical_url", "outcome", F.when(F.col("outcome") == "resolved", F.col("full_id")).alias("payload_id"),
                    F.when(F.col("outcome") == "resolved", F.map_concat(kept, allowed)).otherwise(F.col("headers")).alias("headers")))


def crawl(pages: DataFrame) -> DataFrame:
    """Crawl records of the pages: each page was fetched in full and asked for again later. Every seventh answer names
    another entity tag, every fifth has only a date, and the fetch of every eleventh page failed."""
    k = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), (k % 28).cast("string"))
    first = F.concat_ws("\r\n", F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), F.lit("Cache-Control: max-age=60"),
                        F.concat(F.lit("ETag: "), tag), F.concat(F.lit("Last-Modified: "), day))
    said = F.when(k % 7 == 0, F.lit('ETag: "other"')).when(k % 5 == 0, F.concat(F.lit("Last-Modified: "), day)).otherwise(F.concat(F.lit("ETag: W/"), tag))
    again = F.concat_ws("\r\n", said, F.lit("Cache-Control: max-age=3600"), F.lit("Content-Length: 0"))
    full = pages.select((k * 2).alias("record_id"), "url", (k * 10).alias("captured_at"), F.lit("response").alias("kind"), F.when(k % 11 == 0, 503).otherwise(200).alias("status"), first.alias("headers"))
    later = pages.select((k * 2 + 1).alias("record_id"), "url", (k * 10 + 5).alias("captured_at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("headers"))
    return full.unionByName(later)
