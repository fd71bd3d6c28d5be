from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm.warc import KEPT_FIELDS, REVISIT_SQL, canonical_url, page_records, resolve, revisit_digest

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, body string, url_key string, _source string, outcome int"


def brute(rows):
    """A loop over all responses for each revisit; urls here differ in their fragment alone."""
    key = lambda u: None if u is None else u.split("#")[0].strip()
    lower = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    out = []
    for rid, url, ts, kind, headers, *_ in rows:
        if kind != "revisit":
            continue
        own, u = lower(headers), key(url)
        prior = [r for r in rows if r[3] == "response" and u is not None and ts is not None and r[2] is not None and key(r[1]) == u and r[2] < ts]
        if not prior:
            out.append((rid, u, None, "no_prior", own, None))
            continue
        first = lambda x: (x is not None, x if x is not None else 0)
        s = max(prior, key=lambda r: (r[2], first(r[0]), list(lower(r[4]).items()), (r[5] is not None, r[5] or "")))
        was = lower(s[4])
        weak = lambda t: t[2:] if t[:2] in ("W/", "w/") else t
        if "etag" in own and "etag" in was:
            agree = weak(own["etag"]) == weak(was["etag"])
        else:
            agree = own.get("last-modified", was.get("last-modified")) == was.get("last-modified", own.get("last-modified"))
        merged = was | {k: v for k, v in own.items() if k not in KEPT_FIELDS}
        out.append((rid, u, s[0], "resolved" if agree else "validator_mismatch", merged if agree else own, s[5] if agree else None))
    return Counter((r, u, s, o, tuple(sorted(h.items())), b) for r, u, s, o, h, b in out)


def found(records, **options):
    rows = resolve(records, **options).collect()
    return Counter((r["record_id"], r["url_key"], r["source_id"], r["outcome"], tuple(sorted(r["headers"].items())), r["body"]) for r in rows)


def many(n=600):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        url = ["hot", "hot", "a", "b", "c"][rng.integers(5)] + ["", "#x", " "][rng.integers(3)]
        tag = [None, '"1"', 'W/"1"', '"2"'][rng.integers(4)]
        headers = {k: v for k, v in {"ETag": tag, "Last-Modified": [None, "d1", "d2"][rng.integers(3)], "Content-Length": str(i), "X": f"x{i}"}.items() if v}
        kind = ["response", "revisit"][rng.integers(2)]
        rows.append((i, url, int(rng.integers(60)), kind, headers, f"body {i}" if kind == "response" else None))
    return rows


AWKWARD = [
    (900, None, 5, "revisit", {"ETag": "e"}, None),
    (901, "a", None, "revisit", None, None),
    (902, None, 1, "response", None, "lost"),
    (903, "a", None, "response", None, "lost"),
    (904, "a", 3, None, None, "no kind"),
    (905, "a", 4, "metadata", None, "another kind"),
    (906, "new", 10, "response", None, None),
    (907, "new", 11, "revisit", None, None),
    (907, "new", 11, "revisit", None, None),
    (908, "twice", 10, "response", {"A": "1"}, "one"),
    (908, "twice", 10, "response", {"A": "2"}, "two"),
    (908, "twice", 30, "response", {"A": "3"}, "three"),
    (908, "other", 10, "response", {"A": "9"}, "nine"),
    (909, "twice", 20, "revisit", {}, None),
    (910, "twice", 10, "revisit", {}, None),
    (None, "nameless", 1, "response", {"A": "1"}, "kept"),
    (None, "nameless", 2, "revisit", {"content-length": "0", "a": "2"}, None),
]


@pytest.mark.parametrize("bins", [64, 1, 7])
def test_same_as_brute_force(spark, bins):
    rows = many() + AWKWARD
    records = spark.createDataFrame([(*r, "k", "s", 1) for r in rows], SCHEMA)
    assert found(records, bins=bins) == brute(rows)
    assert found(records.repartition(7), bins=bins) == brute(rows)


def test_hot_url_over_all_bins(spark):
    rows = [(i, "hot", i // 3, ("response", "revisit", "revisit")[i % 3], {"ETag": "e"}, f"b{i}") for i in range(3000)]
    assert found(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, body string")) == brute(rows)


def test_empty_table(spark):
    assert resolve(spark.createDataFrame([], SCHEMA)).collect() == []


def test_canonical_urls(spark):
    cases = {
        "HTTPS://www.Site.org:443/a/b/?y=2&x=1#top": "site.org/a/b?x=1&y=2",
        "http://site.org": "site.org",
        "http://site.org/": "site.org",
        " ftp://Site.org/A ": "site.org/A",
        "no scheme#f": "no scheme",
        "": "",
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == cases


def test_query_meets_every_case_and_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = revisit_digest(resolve(page_records(spark, folder)))
    rows = sorted(map(str, (tuple(r) for r in got.collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    assert rows == sorted(map(str, con.sql(REVISIT_SQL).fetchall()))
    counts = Counter(r["outcome"] for r in got.collect())
    assert min(counts[k] for k in ("resolved", "validator_mismatch", "no_prior")) >= 10
    own = got.where(F.col("source_id") == F.col("revisit_id") - 1).count()
    assert own < 0.7 * got.where(F.col("source_id").isNotNull()).count()
