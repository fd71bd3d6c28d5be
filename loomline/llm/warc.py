"""Resolution of not-modified revisits in web archive records.

A revisit carries no body. It stands for the latest earlier full response of its canonical URL,
provided the validators agree; the response's headers are then updated by those that a 304 may
change. The as-of join is one window over (url, time bin) plus a carry between bins, so that a hot
URL is spread over many tasks; headers and bodies are joined at the end, by the record found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table

# Header fields that describe the stored body or one connection, which a 304 does
# not update (RFC 9110 and RFC 9111).
KEPT_FIELDS = [
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-connection",
    "set-cookie",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
]
TIME_BINS = 64


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port, ``www.``, fragment and trailing slash gone, query sorted.

    Null stays null; a string without scheme and host is only trimmed.
    """
    trimmed = F.regexp_replace(F.trim(url), r"#.*$", "")
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\??.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(trimmed, parts, 2)), r"(:80|:443)?$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(trimmed, parts, 3), r"/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_replace(F.regexp_extract(trimmed, parts, 4), r"^\?", ""), "&")), "&")
    built = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(trimmed.rlike(parts), built).otherwise(trimmed)


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then agree the last stands. Null counts as no headers."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(lowered, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(lowered, lambda e: e["key"] == n), -1)["value"])
    return F.map_from_arrays(names, last)


def merge_headers(stored: Column, update: Column) -> Column:
    """Stored headers, with those of a 304 put in place except the ones it may not change."""
    fixed = F.array(*[F.lit(x) for x in KEPT_FIELDS])
    allowed = F.map_filter(update, lambda k, _: ~F.array_contains(fixed, k))
    rest = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^[Ww]/", "")


def validator_outcome(stored: Column, update: Column) -> Column:
    """'resolved' where entity tags agree weakly or, lacking either tag, the modification dates do not differ."""
    tag, was = update["etag"], stored["etag"]
    date, dated = update["last-modified"], stored["last-modified"]
    by_tag = F.when(_weak(tag) == _weak(was), "resolved").otherwise("validator_mismatch")
    by_date = F.when(date.isNull() | dated.isNull() | (date == dated), "resolved").otherwise("validator_mismatch")
    return F.when(tag.isNotNull() & was.isNotNull(), by_tag).otherwise(by_date)


def resolve(records: DataFrame, *, bins: int = TIME_BINS) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts long, kind, headers map, body).

    Returns record_id, url_key, source_id, outcome, headers, body. ``kind`` is 'response' or
    'revisit'; rows of another or null kind, and responses without url or time, serve nobody. The source is the
    latest response with a smaller ``ts``, the greatest record_id among equal times. ``outcome``
    is 'resolved', 'validator_mismatch' (source_id is told, the revisit's own headers stand, no
    body) or 'no_prior' (also where the revisit's url or ts is null). Null headers count as none
    and a null body stays null. Repeated revisits are resolved one by one; of repeated responses,
    equal in record_id, url and ts, the greatest by headers and then body stands, both from one
    row; a null record_id is an id like any other. An empty table gives no rows. Other columns
    are not read.
    """
    keyed = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        F.col("ts").cast("long").alias("ts"),
        F.col("kind"),
        F.map_entries(lower_keys(F.col("headers"))).alias("headers"),
        "body",
    )
    light = checkpoint(keyed.select("record_id", "url_key", "ts", "kind", F.when(F.col("kind") == "revisit", F.col("headers")).alias("headers")))
    known = light.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    low, high = known.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, ((high or 0) - (low or 0)) // bins + 1)
    known = known.withColumn("_bin", F.floor((F.col("ts").cast("double") - float(low or 0)) / float(width)))

    newest = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    at = Window.partitionBy("url_key", "_bin").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = known.withColumn("_in", F.max(newest).over(at)).where(F.col("kind") == "revisit")
    per_bin = known.groupBy("url_key", "_bin").agg(F.max(newest).alias("_last"))
    before = Window.partitionBy("url_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bin.select(
        F.col("url_key").alias("_u"), F.col("_bin").alias("_b"), F.max("_last").over(before).alias("_carried")
    )
    found = found.join(carried, (F.col("url_key") == F.col("_u")) & (F.col("_bin") == F.col("_b")), "left")
    found = found.select("record_id", "url_key", "headers", F.coalesce("_in", "_carried").alias("_source"))
    astray = light.where((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("ts").isNull()))
    found = found.unionByName(astray.select("record_id", "url_key", "headers", F.lit(None).cast(found.schema["_source"].dataType).alias("_source")))

    stored = keyed.where((F.col("kind") == "response") & F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    stored = stored.groupBy(F.struct("ts", "record_id").alias("_of"), F.col("url_key").alias("_url")).agg(F.max(F.struct("headers", "body")).alias("_stored"))
    joined = found.join(stored, (F.col("_source") == F.col("_of")) & (F.col("url_key") == F.col("_url")), "left")
    own, was = F.map_from_entries("headers"), F.map_from_entries(F.col("_stored.headers"))
    outcome = F.when(F.col("_source").isNull(), "no_prior").otherwise(validator_outcome(was, own))
    judged = joined.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return judged.select(
        "record_id",
        "url_key",
        F.col("_source.record_id").alias("source_id"),
        "outcome",
        F.when(resolved, merge_headers(was, own)).otherwise(own).alias("headers"),
        F.when(resolved, F.col("_stored.body")).alias("body"),
    )


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive records from ``pages``: each page is a full response, and its URL is asked again at another time.

    The pages of a host are captures of two items, under several spellings of the URL, so a common
    host has URLs of many captures. Page p is fetched at 10 (37 p mod 1009), so that captures tie,
    and revisited at 10 (101 p mod 1009), or 5 later if p is odd; every thirteenth revisit comes
    before all captures. A URL's version changes every 3000; it is the tag and the date of the
    response (every eleventh sends no tag). The revisit sends the version of its own time as a weak
    tag; every seventh a changed tag, every fifth a date alone.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    page = F.col("page_id")
    site, query = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1), F.regexp_extract("url", r"(\?[^#]*)", 1)
    slash = F.when((page % 3 == 0) & (query == ""), "/").otherwise("")
    url = F.when(site == "", F.col("url")).otherwise(F.concat(site, F.lit("/item/"), (page % 2).cast("string"), slash, query))
    tag = lambda ts: F.concat(F.lit('"v'), F.floor(ts / 3000).cast("string"), F.lit('"'))
    day = lambda ts: F.concat(F.lit("day "), F.floor(ts / 3000).cast("string"))
    sent = lambda **fields: F.map_filter(
        F.create_map(*[x for k, v in fields.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda _, v: v.isNotNull()
    )
    fetched = (page * 37) % 1009 * 10
    response = pages.select(
        (page * 2).alias("record_id"),
        url.alias("url"),
        fetched.alias("ts"),
        F.lit("response").alias("kind"),
        sent(
            ETag=F.when(page % 11 != 0, tag(fetched)),
            Last_Modified=day(fetched),
            Content_Length=F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
            Cache_Control=F.lit("max-age=60"),
        ).alias("headers"),
        F.col("html").alias("body"),
    )
    asked = F.when(page % 13 == 0, F.lit(-5).cast("long")).otherwise((page * 101) % 1009 * 10 + page % 2 * 5)
    own_tag = F.when(page % 7 == 0, F.lit('"changed"')).when(page % 5 != 0, F.concat(F.lit("W/"), tag(asked)))
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"),
        F.concat(url, F.lit("#again")).alias("url"),
        asked.alias("ts"),
        F.lit("revisit").alias("kind"),
        sent(
            etag=own_tag, last_modified=day(asked), content_length=F.lit("0"), cache_control=F.concat(F.lit("max-age="), page.cast("string"))
        ).alias("headers"),
        F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(revisit)


def revisit_digest(resolved: DataFrame) -> DataFrame:
    return resolved.select(
        F.col("record_id").alias("revisit_id"),
        "url_key",
        "source_id",
        "outcome",
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["cache-control"].alias("cache_control"),
        F.col("headers")["content-length"].alias("content_length"),
        F.md5(F.col("body").cast("binary")).alias("body_md5"),
    )


#: DuckDB SQL for the rows of the query on ``pages``.
REVISIT_SQL = r"""
WITH p AS (
  SELECT page_id, html, strlen(coalesce(html, ''))::VARCHAR AS len,
         regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS site, regexp_extract(url, '(\?[^#]*)', 1) AS query, url,
         (page_id * 37) % 1009 * 10 AS sts,
         CASE WHEN page_id % 13 = 0 THEN -5 ELSE (page_id * 101) % 1009 * 10 + page_id % 2 * 5 END AS vts
  FROM pages
), a AS (
  SELECT *, regexp_replace(trim(CASE WHEN site = '' THEN url
                           ELSE site || '/item/' || (page_id % 2) || CASE WHEN page_id % 3 = 0 AND query = '' THEN '/' ELSE '' END || query END), '#.*$', '') AS u
  FROM p
), k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\??.*)$', 2)), '(:80|:443)?$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\??.*)$', 3), '/+$', '') AS path,
         array_to_string(list_sort(string_split(regexp_replace(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\??.*)$', 4), '^\?', ''), '&')), '&') AS q
  FROM a
), r AS (
  SELECT page_id, html, len, sts, vts, CASE WHEN host = '' THEN u ELSE host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url_key,
         CASE WHEN page_id % 11 <> 0 THEN '"v' || floor(sts / 3000)::BIGINT || '"' END AS stag, 'day ' || floor(sts / 3000)::BIGINT AS sday,
         CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 5 <> 0 THEN 'W/"v' || floor(vts / 3000)::BIGINT || '"' END AS vtag,
         'day ' || floor(vts / 3000)::BIGINT AS vday
  FROM k
), j AS (
  SELECT v.page_id, v.url_key, v.vtag, v.vday, s.page_id AS sid, s.stag, s.sday, s.len, s.html
  FROM r v ASOF LEFT JOIN (SELECT *, sts * 1000000000 + page_id AS place FROM r) s ON v.url_key = s.url_key AND v.vts * 1000000000 > s.place
), o AS (
  SELECT *, CASE WHEN sid IS NULL THEN 'no_prior'
                 WHEN vtag IS NOT NULL AND stag IS NOT NULL THEN CASE WHEN regexp_replace(vtag, '^[Ww]/', '') = stag THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN vday = sday THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM j
)
SELECT page_id * 2 + 1 AS revisit_id, url_key, sid * 2 AS source_id, outcome, coalesce(vtag, CASE WHEN outcome = 'resolved' THEN stag END) AS etag,
       'max-age=' || page_id AS cache_control, CASE WHEN outcome = 'resolved' THEN len ELSE '0' END AS content_length,
       CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5
FROM o
"""
