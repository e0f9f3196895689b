import duckdb
from pyspark.sql import functions as F

from sparkrec.llm import urlfilter
from sparkrec.llm.q_urlfilter import ORACLES, op7_url_filters

COLS = ["page_id", "url", "day", "verdict", "rule", "since", "by_list"]


def oracle(path, glob=""):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet{glob}')")
    rel = con.execute(ORACLES["op7_url_filters"])
    names = [d[0] for d in rel.description]
    return sorted((tuple(r[names.index(c)] for c in COLS) for r in rel.fetchall()), key=str)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, op7_url_filters(spark, sf).select(*COLS).collect()), key=str)
    assert got == oracle(sf)
    assert {r[3] for r in got} == {"block", "allow", "none"}


def test_odd_rows_equal_sql(spark, tables):
    rows = [(1, None), (2, ""), (3, "no url"), (4, "HTTP://User@WWW.Example.COM.:80/A//b/?q#f"), (5, "//cdn.example.com/x/y/z/" + "s/" * 300), (6, "https://h"), (None, "https://h/p"),
            (5, "https://h"), (5, "https://h"), (400, "https://a.b.c.example.org/p#x")]
    path = tables(pages=("page_id long, url string, verdict string, day string, rule int", [(*r, "x", "y", 1) for r in rows]))
    assert sorted(map(tuple, op7_url_filters(spark, path).select(*COLS).collect()), key=str) == oracle(path, "/*.parquet")


def test_empty(spark, tables):
    assert op7_url_filters(spark, tables(pages=("page_id long, url string", []))).collect() == []


def test_intervals_and_precedence(spark):
    entries = spark.createDataFrame([
        ("l", "d:example.com", "block", 10), ("l", "d:example.com", "remove", 20), ("l", "d:example.com", "block", 30), ("l", "d:example.com", "block", 30),
        ("l", "h:www.example.com", "allow", 15), ("m", "h:www.example.com", "block", 15), ("l", "p:www.example.com/a/b", "block", 12), ("l", "p:www.example.com/a", "allow", 40),
        ("l", None, "block", 1), ("l", "d:com", None, 1), ("l", "d:com", "block", None)], "list string, pattern string, action string, day int")
    asked = [("http://x.example.com/", 9), ("http://x.example.com/", 10), ("http://x.example.com/", 20), ("http://x.example.com/", 30), ("http://www.example.com/", 15), ("http://www.example.com/a/b/c", 14),
             ("http://www.example.com/a/b/c", 50), ("http://www.example.com/a/x", 50), ("http://notexample.com/", 50), (None, 50), ("http://x.example.com/", None)]
    got = urlfilter.judge(spark.createDataFrame([(*a, "kept", "x") for a in asked], "url string, day int, list string, verdict string"), entries)
    assert got.columns == ["url", "day", "list", "verdict", "rule", "since", "by_list"]
    by = {(r["url"], r["day"]): r["verdict"] for r in got.collect()}
    assert [by[a] for a in asked] == ["none", "block", "none", "block", "allow", "block", "block", "allow", "none", "none", "none"]
    none = urlfilter.judge(spark.createDataFrame([asked[1]], "url string, day int"), entries.filter(F.lit(False)))
    assert [r["verdict"] for r in none.collect()] == ["none"]
