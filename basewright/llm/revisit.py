"""WARC not-modified revisits, resolved to the latest earlier full response of the same canonical URL.

The as-of join is a window at each time level: within a (URL, ten minutes) the last response before each record,
within a (URL, day) that of any earlier ten minutes, and within a URL that of any earlier day. A URL captured very
often is spread over its times; the later windows have one row per URL and time block in which it was captured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewright.llm.common import table

#: Time levels, each a multiple of the one before it.
BLOCK_SECONDS = (600, 86_400)
#: Header fields that a 304 response may carry for the stored response (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Host without "www." and default port, and path and query without fragment or final slash; host lower-cased.
    Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"(?is)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"(?s)^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1), r"/$", ""))


def _bare_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")  # weak comparison, as a 304 needs


def resolve(records: DataFrame, block_seconds: Sequence[int] = BLOCK_SECONDS) -> DataFrame:
    """One row per revisit of ``records(record_id, url, ts, kind, etag, last_modified, headers)``.

    record_id, url_key, status, response_id, headers (of the response, with the permitted fields of the revisit over
    them, lower-cased and in order). kind is "response" or "revisit"; others and null are ignored. status:
    "resolved"; "mismatch" if the revisit's ETag, or without one its Last-Modified, differs from the response's or the
    response has none; "no_validator" if the revisit has neither; "no_earlier" without a response of strictly lesser
    ts. Of responses at one ts the greatest record_id is the latest. Records without a ts resolve nothing and to
    nothing; so do those without a URL. Null headers are none. Only resolved rows have headers. Repeated
    revisits give repeated rows; other columns are ignored.
    """
    response = F.col("kind") == "response"
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", response.alias("full"), "etag", "last_modified", headers.alias("headers")
    )
    timed = rows.where("ts IS NOT NULL AND url_key IS NOT NULL")
    for i, seconds in enumerate(block_seconds):
        timed = timed.withColumn(f"block{i}", F.floor(F.col("ts").cast("double") / seconds))
    timed = timed.withColumn("own", F.when(F.col("full"), F.struct("ts", "record_id", "etag", "last_modified", "headers")))
    blocks = [f"block{i}" for i in range(len(block_seconds))]
    within = Window.partitionBy("url_key", blocks[0]).orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    revisits = timed.withColumn("found", F.last("own", ignorenulls=True).over(within)).where("NOT full").drop("own")
    for i, block in enumerate(blocks):
        above = blocks[i + 1 :]  # coarser blocks, which a block lies in
        latest = timed.groupBy("url_key", block, *above).agg(F.max_by("own", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last"))
        earlier = Window.partitionBy("url_key", *above[:1]).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        latest = latest.select("url_key", block, F.last("last", ignorenulls=True).over(earlier).alias("far"))
        revisits = revisits.join(latest, ["url_key", block], "left").withColumn("found", F.coalesce("found", "far")).drop("far")
    lost = rows.where("NOT full AND (ts IS NULL OR url_key IS NULL)")
    revisits = revisits.drop(*blocks).unionByName(lost, allowMissingColumns=True)
    by_tag, by_date = F.col("etag").isNotNull(), F.col("last_modified").isNotNull()
    same = F.when(by_tag, F.coalesce(_bare_tag(F.col("etag")) == _bare_tag(F.col("found.etag")), F.lit(False))).otherwise(F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False)))
    status = F.when(F.col("found").isNull(), "no_earlier").when(~by_tag & ~by_date, "no_validator").when(same, "resolved").otherwise("mismatch")

    fresh = F.map_filter(F.col("headers"), lambda k, v: F.lower(k).isin(*PERMITTED))
    both = F.concat(
        F.filter(F.map_entries(F.col("found.headers")), lambda e: ~F.array_contains(F.transform(F.map_keys(fresh), F.lower), F.lower(e["key"]))),
        F.map_entries(fresh),
    )
    lines = F.array_sort(F.transform(both, lambda e: F.concat(F.lower(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit("")))))
    return revisits.select(
        "record_id", "url_key", status.alias("status"), F.when(status == "resolved", F.col("found.record_id")).alias("response_id"),
        F.when(status == "resolved", F.array_join(lines, "\n")).alias("headers"),
    )


def capture_records(pages: DataFrame) -> DataFrame:
    """Captures derived from ``pages``: of each page a full response and a revisit.

    Four pages of five share their URL with up to six others and have one of two validators; times lie within 40
    days. The revisit comes one to 96 hours later, or, for each eleventh page, an hour earlier; its validators are
    those of its own page, stale, absent or a date, by page_id.
    """
    p = F.col("page_id")
    shared = F.pmod(p, F.lit(5)) != 0
    url = F.when(shared, F.concat(F.lit("https://captures.example.net/p/"), F.floor(p / 7).cast("string"))).otherwise(F.col("url"))
    tag = F.when(shared, F.concat(F.lit('"v'), F.pmod(F.floor(p / 3), F.lit(2)).cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"'), F.left(F.md5(F.coalesce("html", F.lit(""))), F.lit(12)), F.lit('"')))
    date = F.concat(F.lit("day "), F.pmod(p, F.lit(2)).cast("string"))
    start = F.pmod(p * 7919 * 61, F.lit(40 * 86_400))
    full = pages.select(
        (p * 2).alias("record_id"), url.alias("url"), start.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), start.cast("string")).alias("headers"),
    )
    later = F.when(F.pmod(p, F.lit(11)) == 0, start - 3600).otherwise(start + 3600 * (1 + F.pmod(p, F.lit(96))))
    kind = F.pmod(p, F.lit(8))
    own = F.when(kind == 6, F.lit('"stale"')).when(kind < 5, F.when(kind < 2, F.concat(F.lit("W/"), tag)).otherwise(tag))
    again = pages.select(
        (p * 2 + 1).alias("record_id"), F.concat(url, F.lit("#again")).alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), own.alias("etag"), F.when(kind == 5, date).alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("DATE"), later.cast("string"), F.lit("Set-Cookie"), F.lit("a=b")).alias("headers"),
    )
    return full.unionByName(again)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(capture_records(table(spark, sf_dir, "pages")))


ORACLE_SQL = r"""
WITH c AS (
  SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'https://captures.example.net/p/' || (page_id // 7) ELSE url END AS url,
         CASE WHEN page_id % 5 <> 0 THEN '"v' || ((page_id // 3) % 2) || '"' ELSE '"' || left(md5(coalesce(html, '')), 12) || '"' END AS tag,
         'day ' || (page_id % 2) AS day, (page_id * 7919 * 61) % (40 * 86400) AS t0
  FROM pages
), p AS (
  SELECT *, lower(regexp_extract(regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[a-z][a-z0-9+.-]*://', '', 'is'), '^([^/?]*)', 1, 's')) AS h,
         regexp_extract(regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[a-z][a-z0-9+.-]*://', '', 'is'), '^[^/?]*(.*)$', 1, 's') AS rest
  FROM c
), k AS (SELECT *, regexp_replace(regexp_replace(h, '^www\.', ''), ':(80|443)$', '') || regexp_replace(rest, '/$', '') AS url_key FROM p
), v AS (
  SELECT page_id * 2 + 1 AS record_id, url_key, CASE WHEN page_id % 11 = 0 THEN t0 - 3600 ELSE t0 + 3600 * (1 + page_id % 96) END AS ts,
         CASE WHEN page_id % 8 = 6 THEN '"stale"' WHEN page_id % 8 < 5 THEN tag END AS etag, CASE WHEN page_id % 8 = 5 THEN day END AS last_modified FROM k
), j AS (
  SELECT v.*, (SELECT max(struct_pack(t := r.t0, i := r.page_id)) FROM k r WHERE r.url_key = v.url_key AND r.t0 < v.ts) AS m FROM v
), s AS (
  SELECT j.*, k.tag, k.day, k.t0, CASE WHEN m IS NULL THEN 'no_earlier' WHEN j.etag IS NULL AND j.last_modified IS NULL THEN 'no_validator'
         WHEN coalesce(j.etag = k.tag, j.last_modified = k.day) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM j LEFT JOIN k ON k.page_id = m.i
)
SELECT record_id, url_key, status, CASE WHEN status = 'resolved' THEN m.i * 2 END AS response_id,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || tag END AS headers
FROM s
"""
