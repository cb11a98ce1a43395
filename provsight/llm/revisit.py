"""Not-modified revisits resolved: an as-of join by canonical URL to the latest earlier full response.

A hot URL is not gathered in one task: distinct (url, time) points are range-partitioned, each piece of a URL is
filled forward on its own, and only the last response of each piece is carried to the pieces after it. Validators are
then compared (strong entity tags, else last-modified, else the payload digest) and headers merged: those of the
revisit replace the stored ones, except those that describe the stored body or the connection.

Defined cases: a revisit needs an earlier response (a smaller time; the same time does not count), else its status is
no_earlier_response; of several responses at one time the smallest record_id counts; a validator missing on either
side does not decide, and with none at all the status is no_validator; null url or time never resolves; null header
maps are empty; repeated rows each give their row; other record types are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Header names that a revisit does not replace (body description and connection headers).
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
_RESPONSE = "record_id string, headers map<string,string>, etag string, last_modified string, digest string"


def canonical_url(url: Column) -> Column:
    """Scheme and a leading www. dropped, host lower-cased, default port, fragment, tracking parameters and final slash gone, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^(?i:https?)://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?i:utm_[a-z]*|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_headers(headers: Column) -> Column:
    """Header names lower-cased; of names equal then, the last in name order wins."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("at"))), lambda e: ~F.array_contains(F.slice(names, e["at"] + 2, F.size(names)), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """fresh over stored, without the names of KEPT_HEADERS in fresh."""
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records(record_id, type, url, ts, headers, digest) -> one row per revisit.

    Columns: record_id, url_key, ts, status (resolved, validator_mismatch, no_validator, no_earlier_response),
    response_id (the response to use, null unless resolved), candidate_id (the latest earlier one), headers (merged).
    """
    lowered = records.select("record_id", "type", canonical_url(F.col("url")).alias("url_key"), "ts", lower_headers(F.col("headers")).alias("headers"), "digest").where(F.col("type").isin("response", "revisit"))
    lowered = lowered.withColumns({"etag": F.col("headers")["etag"], "last_modified": F.col("headers")["last-modified"]})
    body = F.struct("record_id", F.map_entries("headers").alias("headers"), "etag", "last_modified", "digest")
    points = lowered.where("url_key IS NOT NULL AND ts IS NOT NULL").groupBy("url_key", "ts").agg(F.min(F.when(F.col("type") == "response", body)).alias("own"), F.max(F.col("type") == "revisit").alias("asked"))
    points = cut(points.repartitionByRange("url_key", "ts").withColumn("piece", F.spark_partition_id()))
    tails = points.where("own IS NOT NULL").groupBy("url_key", "piece").agg(F.max_by("own", "ts").alias("tail"))
    pieces = points.groupBy("url_key").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high")
    span = points.join(pieces, "url_key", "left_semi").select("url_key", "piece").distinct().join(tails, ["url_key", "piece"], "left")
    carried = span.withColumn("carried", F.last("tail", ignorenulls=True).over(W.partitionBy("url_key").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))).drop("tail")
    within = W.partitionBy("url_key", "piece").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    filled = points.withColumn("local", F.last("own", ignorenulls=True).over(within)).where("asked").join(carried, ["url_key", "piece"], "left")
    found = filled.select("url_key", "ts", F.coalesce("local", "carried").alias("before"))
    asked = lowered.where(F.col("type") == "revisit").alias("r").join(found.alias("f"), ["url_key", "ts"], "left")
    weak = lambda tag: F.regexp_replace(F.trim(tag), "^W/", "")
    verdict = F.coalesce(weak(F.col("etag")) == weak(F.col("before.etag")), F.col("last_modified") == F.col("before.last_modified"), F.col("r.digest") == F.col("before.digest"))
    status = F.when(F.col("before").isNull(), "no_earlier_response").when(verdict.isNull(), "no_validator").when(verdict, "resolved").otherwise("validator_mismatch")
    out = asked.withColumn("status", status)
    good = F.col("status") == "resolved"
    return out.select("record_id", "url_key", "ts", "status", F.when(good, F.col("before.record_id")).alias("response_id"), F.col("before.record_id").alias("candidate_id"),
                      F.when(good, merge_headers(F.map_from_entries("before.headers"), F.col("r.headers"))).alias("headers"))


def capture_records(pages: DataFrame) -> DataFrame:
    """Capture records of a pages table crawled twice: a full response for each page, and later a revisit for each.

    Every ninth page was captured by a revisit before its response; every fifth page had changed its tag by then;
    every seventh server sends no tag but a date. Digests, not pages, travel on.
    """
    tag, changed = F.md5(F.coalesce("html", F.lit(""))), F.col("page_id") % 5 == 0
    p = pages.select("page_id", "url", tag.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), changed.alias("changed"))
    dated = F.col("page_id") % 7 == 0
    validator = lambda value: F.when(dated, F.create_map(F.lit("Last-Modified"), value)).otherwise(F.create_map(F.lit("ETag"), value))
    response = p.select(F.concat(F.lit("resp-"), "page_id").alias("record_id"), F.lit("response").alias("type"), "url", (F.col("page_id") * 10).alias("ts"),
                        F.map_concat(validator(F.col("digest")), F.create_map(F.lit("Content-Length"), F.col("size").cast("string"), F.lit("Server"), F.lit("one"))).alias("headers"), "digest")
    fresh = F.when(F.col("changed"), F.concat(F.lit("new-"), "digest")).otherwise(F.col("digest"))
    at = F.when(F.col("page_id") % 9 == 0, F.col("page_id") * 10 - 5).otherwise(F.col("page_id") * 10 + 1_000_000_005)
    revisit = p.select(F.concat(F.lit("revi-"), "page_id").alias("record_id"), F.lit("revisit").alias("type"), "url", at.alias("ts"),
                       F.map_concat(validator(fresh), F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Server"), F.lit("two"))).alias("headers"), fresh.alias("digest"))
    return response.unionByName(revisit)
