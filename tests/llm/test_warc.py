"""Revisit resolution against a plain loop, and canonical addresses."""

import random

from compare import assert_same, database
from pyspark.sql import functions as F

from tracewright.llm import queries, warc

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def brute(records):
    out = []
    for r in records:
        if r["kind"] != "revisit":
            continue
        place = lambda x: (x["ts"] is not None, x["ts"] or 0, x["record_id"])
        earlier = [x for x in records if x["kind"] == "response" and x["url"] == r["url"] and r["url"] is not None and place(x) < place(r)]
        hit = max(earlier, key=place, default=None)
        own, status = r["headers"] or {}, "unresolved"
        headers = own
        if hit:
            both = [n for n in ("etag", "last_modified", "digest") if r[n] is not None and hit[n] is not None]
            status = "unverified" if not both else "resolved" if r[both[0]] == hit[both[0]] else "mismatch"
            if status != "mismatch":
                headers = (hit["headers"] or {}) | {k: v for k, v in own.items() if k in warc.RENEWED}
        out.append((r["record_id"], hit and hit["record_id"], status, tuple(sorted(headers.items()))))
    return sorted(out)


def test_revisits_equal_a_plain_loop(spark):
    rng = random.Random(6)
    records = []
    for i in range(600):
        pick = lambda *v: rng.choice(v)
        records.append({
            "record_id": i, "url": pick("http://a/x", "http://a/x", "http://b/y", f"http://c/{rng.randrange(9)}", None), "ts": pick(None, rng.randrange(60), rng.randrange(60)), "kind": pick("response", "revisit", "revisit", "other"),
            "etag": pick(None, "1", "2"), "last_modified": pick(None, "m"), "digest": pick(None, "d", "e"), "headers": pick(None, {"date": str(i), "content-type": "t", "x": "y"}, {"etag": "z"}),
        })
    df = spark.createDataFrame(records, SCHEMA).withColumns({c: F.lit(1) for c in ("stretch", "full", "near", "far", "status")})
    want = brute(records)
    for stretch in (3, 1000):
        got = warc.resolve_revisits(df, stretch).collect()
        assert sorted((r.record_id, r.resolved_id, r.status, tuple(sorted(r.headers.items()))) for r in got) == want


def test_canonical_addresses(spark):
    cases = {
        "HTTP://User@WWW.Example.ORG:80/a/b/?utm_source=x&b=2&a=1#top": "example.org/a/b?a=1&b=2",
        "https://example.org/a/index.html": "example.org/a", "https://example.org": "example.org", "https://example.org/?ref=1": "example.org", "http://x:8080/Path": "x:8080/Path",
        "no scheme ": "no scheme", "": "", None: None, "http://h/p?q=http://z/": "h/p?q=http://z/",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_query_equals_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert_same(queries.op5_revisits(spark, sf).toPandas(), database(sf).execute(warc.SQL).df())


def test_odd_and_empty_tables(spark):
    pages = spark.createDataFrame([(2, None, None), (None, "http://a", "x"), (5, "", ""), (8, "http://a", "x" * 2_000_000), (8, "http://a", "y"), (7, "http://a", "y")], "page_id long, url string, html string")
    got = warc.page_revisits(pages.withColumn("headers", F.lit(1)).withColumn("kind", F.lit(2))).collect()
    assert len(got) == 12 and {r.capture for r in got} == {1, 2}
    by = {(r.page_id, r.capture): (r.resolved_id, r.status) for r in got if r.page_id in (2, 5, 7)}
    assert by == {(2, 1): (None, "unresolved"), (2, 2): (None, "unresolved"), (5, 1): (5, "unverified"), (5, 2): (5, "unverified"), (7, 1): (7, "resolved"), (7, 2): (7, "unverified")}
    assert warc.page_revisits(pages.where("false")).count() == 0


def test_weak_etags_and_header_names(spark):
    rows = [
        (1, "http://a/", 1, "response", '"v1"', None, None, {"ETag": '"v1"', "Content-Type": "t", "etag ": '"v1"', "Date": "1"}),
        (2, "http://a/", 2, "revisit", 'W/"v1"', None, None, {"DATE": "2", "X-Own": "n"}),
        (3, "http://a/", 3, "revisit", 'W/"v2"', None, None, {"Date": "3"}),
        (4, "http://a/", 4, "revisit", None, "m", None, {"Last-Modified": "m"}),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2].status, got[2].headers) == ("resolved", {"etag": '"v1"', "content-type": "t", "date": "2"})
    assert (got[3].status, got[3].headers) == ("mismatch", {"date": "3"})
    assert (got[4].status, got[4].headers["last-modified"], got[4].headers["date"]) == ("unverified", "m", "1")


def test_query_reaches_every_status(spark):
    got = {r.status for r in queries.op5_revisits(spark, "/root/testdata/sf0.1").select("status").distinct().collect()}
    assert got == {"resolved", "mismatch", "unverified", "unresolved"}
