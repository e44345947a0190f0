"""Resolution of not-modified revisit records of a web archive.

A revisit record stands for a server's 304 answer and holds no payload. It is resolved by an
as-of join: the latest earlier full response of the same canonical URL. The revisit's
validators (ETag, Last-Modified) must agree with that response's; then the response's payload
stands for the revisit's, and of the revisit's headers those that a 304 may update replace the
stored ones.

The as-of join copes with a URL that holds a third of all records: records are dealt by URL
and slice of time, each slice looks back within itself, and what it has not seen comes from
the last response of the slices before, of which a URL has ``slices`` at most. Slices hold
about equally many records, so a burst is cut into many.

Defined cases: null or empty URLs tell no resource, so their revisits have no response; null
times sort first; records of one time follow one another by
record id, so a response is earlier only if its (time, id) is; repeated rows are each resolved;
a validator that one side lacks is not compared, and a revisit with no validator in common
with the response is unresolved ('no_validator'); an empty table gives no rows; other columns
of the input are not read."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .url_filter import LOWER, UPPER

#: Headers of a stored response that a 304 answer never replaces.
KEPT = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a final slash or
    .html, parameters sorted without those that only track; no scheme, no fragment."""
    u = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.translate(F.regexp_extract(rest, r"^[^/?]*", 0), UPPER, LOWER), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"(/|\.html)$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def merged_headers(stored: Column, update: Column) -> Column:
    """Header maps in lower case: the stored ones, updated by what a 304 may change."""
    fresh = F.map_filter(update, lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    return F.when(stored.isNull(), fresh).when(fresh.isNull(), stored).otherwise(F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k)), fresh))


def resolve_revisits(records: DataFrame, slices: int = 64) -> DataFrame:
    """Revisit records with their response.

    ``records``: record_id long, kind 'response' or 'revisit', url, fetched timestamp or
    number, headers map (names in lower case), digest and length of the payload. Result:
    record_id, canonical, fetched, status (resolved, mismatch, no_validator, no_response),
    response_id, response_fetched, headers (merged), digest, length of the response."""
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), F.col("fetched").cast("double").alias("at"), "fetched", "headers", "digest", "length")
    unknown = rows.where("canonical = '' and kind = 'revisit'")
    rows = rows.where("canonical <> ''")
    cuts = sorted(set(rows.where("at is not null").approxQuantile("at", [k / slices for k in range(1, slices)], 0.25 / slices)))
    past = [F.when(F.col("at") >= c, 1).otherwise(0) for c in cuts]
    rows = rows.withColumn("slice", F.when(F.col("at").isNull(), -1).otherwise(functools.reduce(lambda x, y: x + y, past, F.lit(0))))
    rows = rows.withColumn("place", F.struct(F.coalesce("at", F.lit(float("-inf"))).alias("at"), F.col("record_id").alias("id")))
    response = F.when(F.col("kind") == "response", F.struct("record_id", "fetched", "headers", "digest", "length"))
    rows = rows.withColumn("response", response)
    # The last response of each slice, carried on to the slices after it.
    last = rows.where("kind = 'response'").groupBy("canonical", "slice").agg(F.max_by("response", "place").alias("own"))
    seen = rows.select("canonical", "slice").groupBy("canonical", "slice").agg(F.count("*").alias("n"))
    by = W.partitionBy("canonical").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = seen.join(last, ["canonical", "slice"], "left").select("canonical", "slice", F.last("own", ignorenulls=True).over(by).alias("carried"))
    within = W.partitionBy("canonical", "slice").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    looked = rows.withColumn("within", F.last("response", ignorenulls=True).over(within)).where("kind = 'revisit'")
    found = looked.join(carried, ["canonical", "slice"], "left").withColumn("r", F.coalesce("within", "carried"))
    etag = F.col("headers")["etag"], F.col("r.headers")["etag"]
    since = F.col("headers")["last-modified"], F.col("r.headers")["last-modified"]
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    differ = (both(etag) & (etag[0] != etag[1])) | (both(since) & (since[0] != since[1]))
    status = F.when(F.col("r").isNull(), "no_response").when(~(both(etag) | both(since)), "no_validator").when(differ, "mismatch").otherwise("resolved")
    good = F.col("status") == "resolved"
    none = unknown.select("record_id", "canonical", "fetched", F.lit("no_response").alias("status"))
    found = found.withColumn("status", status).select(
        "record_id", "canonical", "fetched", "status",
        F.when(good, F.col("r.record_id")).alias("response_id"), F.when(good, F.col("r.fetched")).alias("response_fetched"),
        F.when(good, merged_headers(F.col("r.headers"), F.col("headers"))).alias("headers"),
        F.when(good, F.col("r.digest")).alias("digest"), F.when(good, F.col("r.length")).alias("length"),
    )
    return found.unionByName(none, allowMissingColumns=True)


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl made of pages: each is fetched in full at second 4 * page_id, and asked for
    again, with its own validators, at second 4 * page_id + 4 * (20 + page_id mod 400) + 2;
    the server says 304. Where another capture of the URL came in between, validators differ."""
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", F.md5(body).alias("digest"), F.octet_length(body).cast("bigint").alias("length"), (F.col("page_id") * 4).alias("t"))
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    at = lambda s: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv[::2]]), F.array(*kv[1::2]))
    full = base.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("t").alias("fetched"), header("content-length", F.col("length").cast("string"), "content-type", F.lit("text/html"), "date", at(F.col("t")), "etag", etag).alias("headers"), "digest", "length")
    later = F.col("t") + 4 * (20 + F.pmod(F.col("page_id"), F.lit(400))) + 2
    again = base.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("fetched"), header("content-length", F.lit("0"), "date", at(later), "etag", etag, "x-cache", F.lit("revalidated")).alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("length"))
    return full.unionByName(again)


def op10_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.select("record_id", "canonical", "fetched", "status", "response_id", "response_fetched", text.alias("headers"), "digest", "length")


ORACLE = f"""
WITH u AS (SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '') AS u, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS length, page_id * 4 AS t FROM pages),
v AS (SELECT *, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u),
w AS (SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?]*', 0), '{UPPER}', '{LOWER}'), '^www\\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(/|\\.html)$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS kept FROM v),
c AS MATERIALIZED (SELECT page_id, digest, length, t, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical, '"' || substr(digest, 1, 16) || '"' AS etag FROM w),
q AS (SELECT *, t + 4 * (20 + page_id % 400) + 2 AS f FROM c),
j AS (SELECT q.page_id, q.canonical, q.f, q.etag AS e, r.page_id AS rid, r.t AS rt, r.digest, r.length, r.etag AS re FROM q ASOF LEFT JOIN (SELECT * FROM c WHERE canonical <> '') r ON q.canonical = r.canonical AND q.f >= r.t),
k AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN e <> re THEN 'mismatch' ELSE 'resolved' END AS status FROM j)
SELECT page_id * 2 + 1 AS record_id, canonical, f AS fetched, status,
  CASE WHEN status = 'resolved' THEN rid * 2 END AS response_id, CASE WHEN status = 'resolved' THEN rt END AS response_fetched,
  CASE WHEN status = 'resolved' THEN 'content-length: ' || length || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || strftime(make_timestamp((1700000000 + f) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'etag: ' || e || chr(10) || 'x-cache: revalidated' END AS headers,
  CASE WHEN status = 'resolved' THEN digest END AS digest, CASE WHEN status = 'resolved' THEN length END AS length FROM k"""

QUERIES = {"op10_warc_revisits": op10_warc_revisits}
ORACLE_SQL = {"op10_warc_revisits": ORACLE}
