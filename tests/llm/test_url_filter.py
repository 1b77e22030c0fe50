import duckdb
import pytest
from pyspark.sql import functions as F

from laborcast.llm import url_filter
from laborcast.llm.queries_url_filter import RULES, op4_url_filter
from laborcast.llm.registry import ORACLES
from laborcast.llm.url_filter import bloom_blocks, judge

ROOT = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{ROOT}/pages.parquet'")
    got = sorted(tuple(str(x) for x in r) for r in op4_url_filter(spark, ROOT).collect())
    assert got == sorted(tuple(str(x) for x in r) for r in con.execute(ORACLES["op4_url_filter"]).fetchall())
    assert {r[-1] for r in got} == {"allow", "block"}


def reference(url, listed):
    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        tail = rest[len(host):].split("?")[0].split("#")[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail

    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if url in listed else "allow"


@pytest.mark.parametrize("broadcast", [1 << 16, 0])
def test_rules_and_list(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", broadcast)
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en", "http://example.net", "https://net/", "http://xnet/",
            "http://shop.example.com/de/1", "http://example.com/den", "ftp://a.b.org/fr/", "http://org?x=/fr/", "http://bad.example.com/p#://q", "http://a://b.net/c", "http://bad.example.com/q"]
    listed = ["http://bad.example.com/p", "http://bad.example.com/p", None, "x"]
    frame = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id int, url string, verdict string, w0 int")
    out = judge(frame, spark.createDataFrame([(u,) for u in listed], "url string"), RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.columns[:4] == ["page_id", "url", "w0", "host"]
    for i, u in enumerate(urls):
        assert got[i] == reference(u, {"http://bad.example.com/p#://q"}), u


def test_false_hits_are_removed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PER_BLOCK", 100_000)  # one overfull block: nearly everything is a possible hit
    listed = spark.range(3000).select(F.concat(F.lit("http://l.com/"), "id").alias("url"))
    pages = spark.range(6000).select("id", F.concat(F.lit("http://l.com/"), "id").alias("url"))
    assert bloom_blocks(listed.select(F.col("url").alias("canonical")), 1).count() == 1
    out = judge(pages, listed, [])
    assert out.where("verdict = 'block'").agg(F.min("id"), F.max("id"), F.count("*")).first() == (0, 2999, 3000)


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([(1, "http://a/b"), (1, "http://a/b")], "id int, url string")
    none = spark.createDataFrame([], "url string")
    assert [r.verdict for r in judge(pages, none, RULES).collect()] == ["allow", "allow"]
    assert judge(pages.limit(0), none, RULES).count() == 0
    assert judge(pages, pages.select("url"), []).where("verdict = 'block'").count() == 2
