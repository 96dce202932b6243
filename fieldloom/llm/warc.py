"""Operator 9: not-modified revisits in web archives, resolved to the response they stand for.

A revisit record says that a page had not changed: it has no body, but validators (ETag, Last-Modified) of
the version that the crawler held.  It is joined as of its date to the latest earlier full response of the
same canonical URL.  If the validators agree it is resolved, and the response's headers are updated by the
revisit's, as RFC 9111 (3.2) and RFC 9110 permit: not those that describe the message's body or connection.

The as-of join needs no task to sort all captures of one URL: URLs are cut into date ranges (between quantiles of
all dates, so that a stray date doesn't widen them); the latest response of each range (one row, with what it
brings) is carried to the ranges after it, and only a range's captures are ordered.

Edge cases: a response of the same date isn't earlier; of several responses with one date the largest
record_id counts, of those that share it too the one with the largest validators, digest and headers; a revisit without validators is ``unverified``, one whose validators differ ``mismatch``,
one without an earlier response ``unresolved``; URLs that are null match nothing; records without a date are
``unresolved`` and aren't matched; header names are compared in lower case, of spellings that differ in case the one
that sorts last counts, and null headers are empty;
repeated records are resolved each; extra columns of records are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 response that don't replace stored ones (RFC 9111 3.2; hop-by-hop fields of RFC 9110 7.6.1).
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
CHUNK_ROWS = 4096
RECORD_COLUMNS = ["record_id", "url", "date", "type", "etag", "last_modified", "digest", "headers"]


def canonical_url(url: Column) -> Column:
    """Host and path by which captures are the same page.

    Scheme, user, ``www.``, default ports, fragment, trailing slashes, session and utm parameters go; the
    host is lower-cased and the other parameters are sorted.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"^www\.", ""), r":(80|443)$", "")
    rest = F.substring(bare, F.length(authority) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|sessionid|phpsessid|jsessionid)="))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with the permitted fresh ones in their place."""
    empty = F.create_map().cast("map<string,string>")
    permitted = F.map_filter(F.coalesce(fresh, empty), lambda k, _: ~k.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(F.coalesce(stored, empty), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(permitted), k), F.lit(False))), permitted)


def lower_names(headers: Column) -> Column:
    """Headers by lower-case names; of those that differ in case only, the one that sorts last. Null headers are empty."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, last))


def date_chunk(records: DataFrame) -> Column:
    """Number of a date's range: ranges between quantiles of all dates, each cut evenly, of about CHUNK_ROWS rows."""
    shares = [0.0, 0.0001, 0.001, *[k / 64 for k in range(1, 64)], 0.999, 0.9999]
    cuts, n = records.agg(F.percentile_approx("date", shares, 100_000), F.count("date")).first()
    cuts = sorted(set(cuts or [0]))
    parts = max(1, -(-n // len(cuts) // CHUNK_ROWS))
    level = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("date")))
    low = F.element_at(F.array(*[F.lit(c).cast("long") for c in cuts]), F.greatest(level, F.lit(1)))
    width = F.element_at(F.array(*[F.lit(max(1, -(-(b - a) // parts))).cast("long") for a, b in zip(cuts, [*cuts[1:], cuts[-1] + parts])]), F.greatest(level, F.lit(1)))
    # dates below the smallest or beyond the largest quantile lie in the outermost parts
    return level.cast("long") * (parts + 2) + F.greatest(F.lit(-1), F.least(F.lit(parts), F.floor((F.col("date") - low) / width)))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, key, response_id, status, digest and merged headers (null unless resolved)."""
    records = records.select(*RECORD_COLUMNS[:-1], lower_names(F.col("headers")).alias("headers")).withColumn("key", canonical_url(F.col("url")))
    records = records.withColumn("date", F.col("date").cast("long"))
    keyed = records.filter("key is not null and date is not null").withColumn("chunk", date_chunk(records))
    # what a response is later than, and what it brings; of equal dates and ids, the largest content counts
    entries = F.array_sort(F.map_entries("headers"))
    stand = F.when(F.col("type") == "response", F.struct("date", "record_id", "etag", "last_modified", "digest", entries.alias("entries")))
    marks = keyed.withColumn("stand", stand)
    ends = marks.groupBy("key", "chunk").agg(F.max("stand").alias("own"))
    carried = ends.select("key", "chunk", F.max("own").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = Window.partitionBy("key", "chunk").orderBy("date").rangeBetween(Window.unboundedPreceding, -1)
    found = marks.withColumn("near", F.max("stand").over(within)).filter("type = 'revisit'").join(carried, ["key", "chunk"])
    out = found.withColumn("r", F.coalesce("near", "carried")).select("record_id", "key", "etag", "last_modified", "headers", "r")
    apart = records.filter("type = 'revisit' and (key is null or date is null)").select("record_id", "key", "etag", "last_modified", "headers", F.lit(None).cast(out.schema["r"].dataType).alias("r"))
    out = out.unionByName(apart)
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    agrees = F.when(F.col("etag").isNotNull(), F.coalesce(weak(F.col("etag")) == weak(F.col("r.etag")), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("r.last_modified"), F.lit(False)))
    status = F.when(F.col("r").isNull(), "unresolved").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    out = out.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    merged = merged_headers(F.map_from_entries("r.entries"), F.col("headers"))
    return out.select("record_id", "key", F.col("r.record_id").alias("response_id"), "status", F.when(resolved, F.col("r.digest")).alias("digest"), F.when(resolved, merged).alias("headers"))


def header_text(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as the archive of a crawl that visits each page and then visits it again.

    A page's visit at date 2 * page_id brings a full response, unless page_id is divisible by 10; the second
    visit, at 2 * page_id + 1 + 20 * (page_id modulo 7), brings a revisit with the page's ETag; where page_id
    divided by 5 leaves 1, 2 or 3 it has instead another ETag, only a Last-Modified date, or no validator.
    """
    digest, date = F.md5(F.coalesce("html", F.lit(""))), (2 * F.col("page_id")).cast("long")
    modified = F.concat(F.lit("day "), (F.col("page_id") % 100).cast("string"))
    base = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("ETag"), digest, F.lit("Cache-Control"), F.lit("max-age=60"))
    full = pages.filter("page_id % 10 <> 0").select((2 * F.col("page_id")).cast("long").alias("record_id"), "url", date.alias("date"), F.lit("response").alias("type"), digest.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), base.alias("headers"))
    case = F.col("page_id") % 5
    etag = F.when(case == 1, F.lit("other")).when(case.isin(2, 3), F.lit(None)).otherwise(digest)
    fresh = F.create_map(F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), F.col("page_id").cast("string"))
    again = pages.select((2 * F.col("page_id") + 1).cast("long").alias("record_id"), "url", (date + 1 + 20 * (F.col("page_id") % 7)).cast("long").alias("date"), F.lit("revisit").alias("type"), etag.alias("etag"), F.when(case != 3, modified).alias("last_modified"), F.lit(None).cast("string").alias("digest"), fresh.alias("headers"))
    return full.unionByName(again)


def op9_query(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("record_id", "key", "response_id", "status", "digest", header_text(F.col("headers")).alias("headers"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, html, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare FROM pages),
h AS (
  SELECT *, regexp_extract(bare, '^([^/?]*)', 1) AS authority FROM p),
r AS (
  SELECT *, substr(bare, length(authority) + 1) AS rest,
         regexp_replace(regexp_replace(regexp_replace(lower(authority), '^.*@', ''), '^www\.', ''), ':(80|443)$', '') AS host FROM h),
q AS (
  SELECT page_id, html, host, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|sessionid|phpsessid|jsessionid)='))) AS params FROM r),
k AS (
  SELECT page_id, html, md5(coalesce(html, '')) AS digest, 'day ' || (page_id % 100) AS modified,
         host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS key FROM q),
full_ AS (SELECT 2 * page_id AS record_id, 2 * page_id AS date, key, digest, modified, length(html) AS n FROM k WHERE page_id % 10 <> 0),
again AS (
  SELECT 2 * page_id + 1 AS record_id, 2 * page_id + 1 + 20 * (page_id % 7) AS date, key, page_id,
         CASE WHEN page_id % 5 = 1 THEN 'other' WHEN page_id % 5 IN (2, 3) THEN NULL ELSE digest END AS etag,
         CASE WHEN page_id % 5 <> 3 THEN modified END AS modified FROM k),
m AS (
  SELECT a.*, f.record_id AS response_id, f.digest AS r_digest, f.modified AS r_modified, f.n,
         row_number() OVER (PARTITION BY a.record_id ORDER BY f.date DESC NULLS LAST, f.record_id DESC) AS place
  FROM again a LEFT JOIN full_ f ON f.key = a.key AND f.date < a.date),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'unresolved' WHEN etag IS NULL AND modified IS NULL THEN 'unverified'
                 WHEN etag IS NOT NULL AND etag = r_digest THEN 'resolved' WHEN etag IS NULL AND modified = r_modified THEN 'resolved'
                 ELSE 'mismatch' END AS status
  FROM m WHERE place = 1)
SELECT CAST(record_id AS BIGINT) AS record_id, key, CAST(response_id AS BIGINT) AS response_id, status,
       CASE WHEN status = 'resolved' THEN r_digest END AS digest,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || n || chr(10) ||
            'content-type: text/html' || chr(10) || 'date: ' || page_id || chr(10) || 'etag: ' || r_digest END AS headers
FROM s
"""
