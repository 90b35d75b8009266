"""Operator 10, WARC not-modified revisit resolution.

A revisit record holds no body: it says that what a URL gave is what an earlier response gave. Each revisit is joined
as of its time to the latest earlier full response of the same canonical URL; its validators are checked (an entity
tag, by weak comparison, before a modification date), and where they hold, the stored headers are updated by those of
the revisit, except the ones that describe the body or the connection.

The as-of join is two windows: within (URL, stretch of ``STRETCH`` seconds) each row looks back to the last full
response, and what no row of its own stretch precedes takes the last one of the stretches before, of which there is
one row each. So a URL that holds a large part of all records is split by time.

Records: record_id, url, ts (seconds), kind ('response' or 'revisit'), etag, last_modified, headers (map, names in any
case), digest. Verdicts: resolved, mismatch (validators differ), unverified (the revisit has no validator, or the
response lacks that one), no_response. Defined results: a null url or ts never matches; of responses at one time the one
with the largest record_id counts, and one at the revisit's own time is not earlier; every revisit row gives a row,
repeated ones too; null headers count as none; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termweave.llm._spark import table

STRETCH = 30 * 86_400
# Headers of a not-modified answer that do not replace stored ones.
KEPT = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
# Query parameters that say where a visitor came from.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """The URL without scheme, fragment, www, default port, tracking parameters and last slash; host in lower case,
    parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    query = F.array_join(F.array_sort(asked), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def lowered(headers: Column) -> Column:
    """Names in lower case; of names that differ by case alone the last in sorted order counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"])))


def resolve(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """record_id, url_key, ts, verdict, refers_to, headers (merged where resolved) and digest of every revisit row."""
    rows = records.select(
        "record_id", canonical(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("full"), "etag", "last_modified", lowered(F.col("headers")).alias("headers"), "digest"
    ).withColumn("stretch", F.floor(F.col("ts") / stretch))
    held = rows.where("full and url_key is not null and ts is not null").withColumn("response", F.struct("ts", "record_id", "etag", "last_modified", "headers", "digest"))
    # a revisit sorts before what was stored at its own time
    last = F.last("response", ignorenulls=True).over(Window.partitionBy("url_key", "stretch").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = rows.where("not full").withColumn("response", F.lit(None).cast(held.schema["response"].dataType)).unionByName(held).withColumn("near", last).where("not full")
    ends = held.groupBy("url_key", "stretch").agg(F.max_by("response", F.struct("ts", "record_id")).alias("end"))
    here = seen.select("url_key", "stretch").where("url_key is not null and ts is not null").distinct()
    steps = ends.unionByName(here, allowMissingColumns=True).groupBy("url_key", "stretch").agg(F.first("end", ignorenulls=True).alias("end"))
    before = steps.select("url_key", "stretch", F.last("end", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    both = seen.join(before, ["url_key", "stretch"], "left").withColumn("found", F.when(F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "carried")))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.when(F.col("etag").isNotNull(), weak(F.col("etag")) == weak(F.col("found.etag"))).otherwise(F.col("last_modified") == F.col("found.last_modified"))
    verdict = F.when(F.col("found").isNull(), "no_response").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    new = F.map_filter("headers", lambda k, v: ~k.isin(KEPT))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    judged = both.withColumn("verdict", verdict)
    ok = F.col("verdict") == "resolved"
    return judged.select("record_id", "url_key", "ts", "verdict", F.col("found.record_id").alias("refers_to"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("found.digest")).alias("digest"))


def records(pages: DataFrame) -> DataFrame:
    """A crawl of four visits to each page, as WARC records: what is stored, what is found unmodified, and validators
    that match, differ or are missing all follow from the page's id and body."""
    visits = pages.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("body"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    full = "((v = 0 and page_id % 11 <> 0) or (v > 0 and (page_id + v) % 5 = 0))"
    last = "case when v >= 3 and (page_id + 3) % 5 = 0 then 3 when v >= 2 and (page_id + 2) % 5 = 0 then 2 when v >= 1 and (page_id + 1) % 5 = 0 then 1 else 0 end"
    made = visits.selectExpr(
        "page_id * 4 + v as record_id",
        "case when v = 2 then concat(url, '#again') else url end as url",
        "1700000000 + v * 1728000 + (page_id * 7919) % 86400 as ts",
        f"case when {full} then 'response' else 'revisit' end as kind",
        f"case when not {full} and page_id % 3 = 1 then null when not {full} and page_id % 7 = 0 then 'W/\"old\"' else concat(case when v % 2 = 1 then 'W/' else '' end, '\"', substr(body, 1, 12), '-', {last}, '\"') end as etag",
        f"case when not {full} and page_id % 13 = 5 then null else concat('day ', {last}) end as last_modified",
        f"case when {full} then map('Content-Type', 'text/html', 'content-length', substr(body, 1, 4), 'cache-control', 'max-age=60', 'x-visit', cast(v as string)) else map('Content-Length', '0', 'Cache-Control', 'max-age=120', 'Date', cast(v as string), 'Connection', 'close') end as headers",
        f"case when {full} then body end as digest",
    )
    return made


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resolve(records(table(spark, sf_dir, "pages")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return made.withColumn("headers", text)


OP10_SQL = r"""
with visits as (
  select page_id, url, sha256(coalesce(html, '')) as body, unnest([0, 1, 2, 3]) as v from pages
), flagged as (
  select *, (v = 0 and page_id % 11 <> 0) or (v > 0 and (page_id + v) % 5 = 0) as is_full,
    case when v >= 3 and (page_id + 3) % 5 = 0 then 3 when v >= 2 and (page_id + 2) % 5 = 0 then 2 when v >= 1 and (page_id + 1) % 5 = 0 then 1 else 0 end as ver
  from visits
), parts as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from flagged
), keyed as (
  select *, page_id * 4 + v as record_id, 1700000000 + v * 1728000 + (page_id * 7919) % 86400 as ts,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') as query,
    case when not is_full and page_id % 3 = 1 then null when not is_full and page_id % 7 = 0 then '"old"' else '"' || substr(body, 1, 12) || '-' || ver || '"' end as tag,
    case when not is_full and page_id % 13 = 5 then null else 'day ' || ver end as modified
  from parts
), recs as (
  select *, base || case when coalesce(query, '') <> '' then '?' || query else '' end as url_key from keyed
), latest as (
  select r.*, f.record_id as refers_to, f.tag as f_tag, f.modified as f_modified, f.body as f_body, f.v as f_v
  from (select * from recs where not is_full) r left join (select url_key, ts, max(record_id) as rid from recs where is_full group by all) g
    on g.url_key = r.url_key and g.ts = (select max(x.ts) from recs x where x.is_full and x.url_key = r.url_key and x.ts < r.ts)
    left join recs f on f.record_id = g.rid
), judged as (
  select *, case when refers_to is null then 'no_response'
    when coalesce(tag = f_tag, tag is null and modified = f_modified) then 'resolved'
    when tag is not null or modified is not null then 'mismatch' else 'unverified' end as verdict
  from latest
)
select record_id, url_key, ts, verdict, refers_to,
  case when verdict = 'resolved' then 'cache-control: max-age=120; content-length: ' || substr(f_body, 1, 4) || '; content-type: text/html; date: ' || v || '; x-visit: ' || f_v end as headers,
  case when verdict = 'resolved' then f_body end as digest
from judged
"""
