"""Web archives: not-modified revisits resolved to the latest earlier full response.

Records are joined as of their time, by canonical URL. A revisit's validators are checked against
the response found, and the header fields that a not-modified answer may renew are merged into
the response's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that don't change what is served.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Header fields that a 304 answer renews.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Width, in units of the records' time, of the stretches in which a URL's records are ordered.
STRETCH = 4096


def canonical_url(url: Column) -> Column:
    """Host and path that name a resource, with sorted query parameters.

    Scheme, fragment, user, default port, a leading ``www.``, tracking parameters, ``index.html`` and
    trailing slashes go; the host is lower-cased. A text without ``://`` is trimmed only; null stays.
    """
    bare = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    rest = F.regexp_replace(bare, "(?s)^.*?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^(.*@)?(www\\.)?", "")
    host = F.regexp_replace(host, ":(80|443)?$", "")
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/index\\.html?$", "/"), "/+$", "")
    query = F.regexp_extract(rest, "(?s)\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(bare.contains("://"), F.concat(host, path, tail)).otherwise(bare)


def lower_names(headers: Column) -> Column:
    """A map with its names trimmed and A-Z lower-cased; of names that fall together the last value stays."""
    named = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    later = lambda e, i: F.exists(F.slice(named, i + 2, F.size(named)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(named, lambda e, i: ~later(e, i)))


def resolve_revisits(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row for each revisit: ``record_id, canonical_url, resolved_id, status, headers``.

    ``records``: ``record_id, url, ts`` (a number), ``kind`` (response or revisit; others are
    ignored), ``etag``, ``last_modified``, ``digest``, ``headers`` (a map; names are lower-cased).
    Order is by ``ts``, then ``record_id``; null times come first. ``status`` is

    * ``resolved``: the first of etag, last_modified and digest that both have is equal, etags by the
      weak comparison that a 304 asks for (``W/"a"`` is ``"a"``);
    * ``mismatch``: it differs; ``resolved_id`` names the response, headers stay the revisit's;
    * ``unverified``: no validator is on both sides; headers are merged;
    * ``unresolved``: no earlier response, or no URL.

    A URL's records are ordered within stretches of time; each stretch starts from the last response
    of those before it, so a URL with a third of all records spreads over many tasks. Repeated
    rows each get a row; other columns are ignored.
    """
    base = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts"), "kind", "etag", "last_modified", "digest", lower_names(F.col("headers")).alias("headers")
    )
    rows = base.withColumns(
        {
            "stretch": F.coalesce(F.floor(F.col("ts") / F.lit(stretch)), F.lit(-(1 << 62))),
            "full": F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "digest", "headers")),
        }
    )
    order = [F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first()]
    inside = Window.partitionBy("canonical_url", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last("full", ignorenulls=True).over(inside))
    latest = Window.partitionBy("canonical_url", "stretch").orderBy(*[F.col(c).desc_nulls_last() for c in ("ts", "record_id")])
    ends = rows.where("kind = 'response'").withColumn("_n", F.row_number().over(latest))
    ends = ends.where("_n = 1").select("canonical_url", "stretch", "full")
    slots = rows.select("canonical_url", "stretch").distinct().join(ends, ["canonical_url", "stretch"], "left")
    before = Window.partitionBy("canonical_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("far", F.last("full", ignorenulls=True).over(before)).select("canonical_url", "stretch", "far").where("far is not null")
    found = rows.where("kind = 'revisit'").join(slots, ["canonical_url", "stretch"], "left")
    found = found.withColumn("hit", F.when(F.col("canonical_url").isNotNull(), F.coalesce("near", "far")))

    def agrees(name: str, shown=lambda v: v) -> Column:
        return F.when(F.col(name).isNotNull() & F.col(f"hit.{name}").isNotNull(), shown(F.col(name)) == shown(F.col(f"hit.{name}")))

    weak = lambda v: F.regexp_replace(F.trim(v), "^W/", "")
    same = F.coalesce(agrees("etag", weak), agrees("last_modified"), agrees("digest"))
    status = (
        F.when(F.col("hit").isNull(), "unresolved").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    )
    none = F.expr("cast(map() as map<string,string>)")
    own, old = F.coalesce("headers", none), F.coalesce("hit.headers", none)
    new = F.map_filter(own, lambda k, _: k.isin(*RENEWED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return found.withColumn("status", status).select(
        "record_id",
        "canonical_url",
        F.col("hit.record_id").alias("resolved_id"),
        "status",
        F.when(F.col("status").isin("resolved", "unverified"), merged).otherwise(own).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records from ``(page_id, url, html)``, three captures of each page in the order of their ids.

    The first is a full response, but for one page in 11; the others answered that the page hadn't
    changed. The html's MD5 is the digest and, in quotes, the etag. The second capture has the same
    validators, some etags weak; the third another etag, or none of them, or the month alone. One in
    four pages names its header ``ETag``. A record's id is its page and capture.
    """
    size = F.length(F.coalesce("html", F.lit("")).cast("binary")).cast("string")
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("md5"), size.alias("size"))
    captures = F.when(F.col("page_id") % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    base = base.withColumn("capture", F.explode(captures))
    n, k = F.coalesce("page_id", F.lit(0)), F.col("capture")
    third, none = k == 2, F.expr("cast(map() as map<string,string>)")
    etag = F.when(~third & (n % 5 != 0), F.concat(F.when((k == 1) & (n % 4 == 1), "W/").otherwise(""), F.lit('"'), "md5", F.lit('"'))).when(third & (n % 3 == 0), F.lit('"new"'))
    own = F.when(etag.isNotNull(), F.create_map(F.when(n % 4 == 2, "ETag").otherwise("etag"), etag)).otherwise(none)
    length = F.create_map(F.lit("content-length"), F.when(k == 0, F.col("size")).otherwise("0"), F.lit("date"), F.concat(F.lit("day "), (3 * n + k).cast("string")))
    kind = F.when(k == 0, F.create_map(F.lit("content-type"), F.lit("text/html"))).otherwise(none)
    return base.select(
        F.struct("page_id", "capture").alias("record_id"),
        "url",
        F.col("page_id").alias("ts"),
        F.when(k == 0, "response").otherwise("revisit").alias("kind"),
        etag.alias("etag"),
        F.when(~third | (n % 3 == 2), F.when(n % 2 == 0, "month")).alias("last_modified"),
        F.when(~third & (n % 7 < 4), F.col("md5")).alias("digest"),
        F.map_concat(own, length, kind).alias("headers"),
    )


def page_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, capture, canonical_url, resolved_id, status, headers)`` of each revisit, headers as sorted lines; ``resolved_id`` is the response's page."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    found = resolve_revisits(page_records(pages))
    return found.select("record_id.page_id", "record_id.capture", "canonical_url", F.col("resolved_id.page_id").alias("resolved_id"), "status", lines.alias("headers"))


SQL = r"""
WITH cut AS (
  SELECT page_id, html, regexp_replace(trim(url), '#.*$', '', 's') AS bare FROM pages),
part AS (SELECT *, regexp_replace(bare, '^.*?://', '', 's') AS rest FROM cut),
named AS (
  SELECT page_id, md5(coalesce(html, '')) AS md5, octet_length(encode(coalesce(html, '')))::VARCHAR AS size, bare,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^(.*@)?(www\.)?', ''), ':(80|443)?$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1, 's'), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS kept
  FROM part),
records AS (
  SELECT page_id, k AS capture, 3 * page_id + k AS place, size,
    CASE WHEN k < 2 AND page_id % 5 <> 0 THEN '"' || md5 || '"' WHEN k = 2 AND page_id % 3 = 0 THEN '"new"' END AS etag, k = 1 AND page_id % 4 = 1 AS weak,
    (k < 2 OR page_id % 3 = 2) AND page_id % 2 = 0 AS month, CASE WHEN k < 2 AND page_id % 7 < 4 THEN md5 END AS digest,
    CASE WHEN contains(bare, '://') THEN host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
         ELSE bare END AS canonical_url
  FROM named, (VALUES (0), (1), (2)) AS c(k) WHERE k > 0 OR page_id % 11 <> 0),
joined AS (
  SELECT r.*, o.page_id AS resolved_id, o.etag AS old_etag, o.month AS old_month, o.digest AS old_digest, o.size AS old_size
  FROM (SELECT * FROM records WHERE capture > 0) r
  ASOF LEFT JOIN (SELECT * FROM records WHERE capture = 0) o ON r.canonical_url = o.canonical_url AND r.place > o.place),
judged AS (
  SELECT *, CASE WHEN resolved_id IS NULL THEN 'unresolved'
    WHEN etag IS NOT NULL AND old_etag IS NOT NULL THEN CASE WHEN etag = old_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN month AND old_month THEN 'resolved'
    WHEN digest IS NOT NULL AND old_digest IS NOT NULL THEN CASE WHEN digest = old_digest THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS status, CASE WHEN weak THEN 'W/' ELSE '' END || etag AS shown FROM joined)
SELECT page_id, capture, canonical_url, resolved_id, status,
  CASE WHEN status IN ('resolved', 'unverified') THEN 'content-length: ' || old_size || chr(10) || 'content-type: text/html' ELSE 'content-length: 0' END
  || chr(10) || 'date: day ' || place::VARCHAR
  || coalesce(chr(10) || 'etag: ' || CASE WHEN status IN ('resolved', 'unverified') THEN coalesce(shown, old_etag) ELSE shown END, '') AS headers
FROM judged
"""
