from quernel.llm import urlgraph
from quernel.llm.queries import RULES


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_rules(spark):
    urls = [None, "", "no scheme", "http://X.Example.ORG/es/1", "https://example.org/en/12?q#f", "https://example.org/en/2", "https://notexample.org/es/", "http://a.com/fr/x", "http://a.com/fr", "http://a.com#/fr/", "x://com/de/", "http://org", "http://org/", "http://ÉA.com/de/é", "http:///p", "a://b://c/d", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(urls)] + [(0, None, None, "r")], "page_id long, url string, html string, rule string")
    got = urlgraph.judge(pages, urlgraph.rules_table(spark, RULES)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, (rule, verdict) = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)


def test_propagation(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}:80/x">y</a>' for h in hosts)
    rows = [(1, "http://good.org/a", link("near.net", "near.net")), (2, "http://near.net/a", link("far.net")), (3, "http://far.net/a", ""), (4, "http://bad.com/de/", link("near.net")), (5, "http://farm.net/a", link("bad.com", "farm.net")), (6, "http://farm2.net/", link("farm.net")), (7, "http://alone.net/", "<a href=/x>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = urlgraph.judge(pages, urlgraph.rules_table(spark, RULES))
    got = {r.host: r for r in judged.collect()}
    assert {h: r.verdict for h, r in got.items()} == {"good.org": "allow", "near.net": "allow", "far.net": "allow", "bad.com": "block", "farm.net": "block", "farm2.net": "block", "alone.net": "allow"}
    # by hand: half of the ruled pages seed each side, damping 0.85
    assert abs(got["near.net"].trust - 0.5 * 0.15 * 0.85) < 1e-9 and abs(got["farm.net"].distrust - 0.5 * 0.15 * 0.85) < 1e-9
    assert abs(got["far.net"].trust - 0.5 * 0.15 * 0.85**2) < 1e-9 and got["alone.net"].trust == 0
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_propagation_reaches_hosts_far_from_seeds(spark):
    hosts = ["bad.com", *(f"farm{i}.net" for i in range(1, 16))]
    rows = [(0, "http://bad.com/de/", "")] + [(i, f"http://{h}/", f'<a href="http://{hosts[i - 1]}/">') for i, h in enumerate(hosts) if i]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlgraph.judge(pages, urlgraph.rules_table(spark, RULES)).collect()}
    assert {r.verdict for r in got.values()} == {"block"}
    assert abs(got[15].distrust - 0.15 * 0.85**15) < 1e-9


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlgraph.judge(none, urlgraph.rules_table(spark, RULES)).count() == 0
    some = spark.createDataFrame([(1, "http://a.org/", "")], "page_id long, url string, html string")
    assert [r.verdict for r in urlgraph.judge(some, urlgraph.rules_table(spark, [])).collect()] == ["allow"]
