import re

import pytest
from lexiforge.llm import urls

from lexiforge.llm.urls import RULES, blocked_bloom, may_be_listed, op3_url_filter, url_verdicts

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "https://a.b.net/x?y=/z", "ftp://xnet/", "http://example.net/en/1",
    "http://m.Example.net/en/1#f", "http://example.net/en", "http://example.net?u=/en/", "http://example.net#x", "http://example.com/de/1", "http://wexample.com/de/1",
    "http://a.example.com/de/", "http://a.org/fr/x", "http://a.org/en/x", "http://u@example.com/de/", "http://example.com:80/de/", "http://net./", "://net/", "a://b://net/",
    "http://" + "x." * 20000 + "net/" + "y" * 50000, "http://é.net/ü/\n/x", "http://a.net/x", "http://a.net/x",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


def test_query(spark, tmp_path):
    rows = [(i, u, "h", "host") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in op3_url_filter(spark, str(tmp_path)).collect()}
    assert got == {(i, *brute(u)) for i, u, *_ in rows}
    df.limit(0).write.parquet(f"{tmp_path}/e/pages.parquet")
    assert op3_url_filter(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_many_rules_and_none(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", limit)
    rules = spark.createDataFrame([("block", f"h{i}.example.com", "/") for i in range(3000)] + [("allow", "h7.example.com", "/ok/")], "action string, host string, path string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.example.com/ok/x") for i in range(0, 6000, 7)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_verdicts(pages, rules).collect()}
    assert all(v == (("allow", "h7.example.com/ok/") if i == 7 else ("block", f"h{i}.example.com/") if i < 3000 else ("allow", None)) for i, v in got.items())
    assert url_verdicts(pages, rules.limit(0)).where("verdict = 'allow'").count() == pages.count()


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) as key")
    bloom, n = blocked_bloom(keys, "key", 5000)
    assert may_be_listed(keys, "key", bloom, n).count() == 5000
    assert may_be_listed(spark.range(10**6, 10**6 + 20000).selectExpr("cast(id as string) as key"), "key", bloom, n).count() < 600


@pytest.mark.parametrize("sf", ["0.001"])
def test_plan_is_native(spark, sf):
    plan = op3_url_filter(spark, f"/root/testdata/sf{sf}")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_possible_hits_are_shuffled(spark, tmp_path):
    """URLs that no key of passes are in no exchange: there is one of possible hits, by row."""
    spark.createDataFrame([(i, None if i % 3 else f"http://h{i}.net/") for i in range(300)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    out = op3_url_filter(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__row" in plan and "hashpartitioning(__host" not in plan
    assert out.where("verdict = 'block'").count() == 100
