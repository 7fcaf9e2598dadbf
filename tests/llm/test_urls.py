import datetime as dt

import pytest

from helpers import same
from packmill.llm import urls as U

CAPTURES = "page_id bigint, url string, fetched timestamp"
T = lambda day, hour=0: dt.datetime(2024, 1, day, hour)


def brute(captures, entries):
    """Each capture against the history of every pattern, entry by entry."""
    import re

    out = []
    for page, url, at in captures:
        best = None
        m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d+)?(/[^?#]*)?", (url or "").lower())
        for name, kind, pattern in {(e[0], e[1], (e[2] or "").lower()) for e in entries if e[0] and e[2]}:
            past = sorted((e[4], e[3]) for e in entries if (e[0], e[1], (e[2] or "").lower()) == (name, kind, pattern) and e[4] and at and e[4] <= at)
            if not m or not past or past[-1][1] != "add":
                continue
            host, _, path = pattern.partition("/")
            mine, below = m[1], m[2] or "/"
            if (mine == host or mine.endswith("." + host)) and (not path or below.startswith("/" + path)):
                rank = (-len(pattern), kind != "block", name)
                best = min(best or (rank, name, pattern, kind), (rank, name, pattern, kind))
        out.append((page, url, at, *((best[1], best[2], best[3] == "block") if best else (None, None, False))))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    entries = [
        ("a", "block", "Bad.example", "add", T(2)), ("a", "block", "bad.example", "remove", T(5)), ("a", "block", "bad.example", "add", T(5)), ("a", "block", "bad.example", "add", T(7)),
        ("a", "block", "bad.example", "add", T(8)), ("b", "allow", "ok.bad.example/x/", "add", T(3)), ("b", "block", "ok.bad.example/x/", "add", T(9)), ("c", "block", "never.example", "remove", T(1)),
        ("c", "block", "bad.example", "add", T(4)), (None, "block", "bad.example", "add", T(1)), ("d", "block", None, "add", T(1)), ("d", "block", "bad.example", None, T(1)), ("d", "block", "bad.example", "add", None),
    ]
    urls = ["http://bad.example/", "https://www.BAD.example/a?q=1", "http://ok.bad.example/x/y.html", "http://ok.bad.example/xy", "ftp://u@bad.example:8080/", "http://notbad.example/", "nonsense", "", None, "http://never.example/"]
    captures = [(i, u, at) for i, u in enumerate(urls) for at in (T(1), T(2), T(4, 12), T(5), T(6), T(7), T(10), None)] + [(0, urls[0], T(10))]
    lists = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at timestamp")
    got = U.judge(spark.createDataFrame(captures, CAPTURES), lists)
    assert sorted((tuple(r) for r in got.select("page_id", "url", "fetched", "list", "pattern", "blocked").collect()), key=repr) == brute(captures, [e for e in entries if e[3]])


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], CAPTURES), U.entries(spark)).count() == 0
    none = U.judge(spark.createDataFrame([(1, "http://a.example/", T(1))], CAPTURES), U.entries(spark, []))
    assert [r["blocked"] for r in none.collect()] == [False]


def test_very_long_url_and_extra_columns(spark):
    from pyspark.sql import functions as F

    url = "http://" + "a." * 200 + "bad.example/" + "d/" * 200
    captures = spark.createDataFrame([(1, url, T(3))], CAPTURES).withColumns({c: F.lit("own") for c in ("key", "list", "pattern", "times", "blocked")})
    lists = U.entries(spark, [("a", "block", "bad.example/d/", "add", "2024-01-02 00:00:00")])
    (r,) = U.judge(captures, lists).collect()
    assert r["blocked"] and r["pattern"] == "bad.example/d/"


@pytest.mark.parametrize("name", ["op4_urls"])
def test_sql(spark, duck, name):
    from packmill.llm.registry import QUERIES, SQL

    got, want = same(QUERIES[name](spark, "/root/testdata/sf0.001"), duck.sql(SQL[name]))
    assert got == want
