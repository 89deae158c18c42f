import re

import pytest

from cellframe.llm import url_rules as U

URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.NET/x", "http://xnet/y", "ftp://example.net/en/1",
        "http://www.example.net/en/1?q=1", "http://example.net/EN/1", "http://example.net/en", "http://example.com/de/",
        "http://example.com/den/", "http://x.org/fr/a#b", "http://org/fr/", "http://x.org/fr?x", "http://m.adult-x.example.com/en/1",
        "http://cheap-pills.example.org/", "http://a.com/cheap_pills", "http://a.com/cheappills", "http://a.com/spam-farm/x",
        "http://adult-x.org/fr/1", "http://u@h.net:80/x", "a://b://c.net/d", "http://A.Example.NET/en/?a=/de/", "http://q.com#/net/",
        "http://x.net\n/en/", "http://adulte.com/", "http://ex.com/Casino", "http://net/"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
        path = re.split("[?#]", rest[cut:])[0]
    fit = [r for r in U.SITE_RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(
        *(r.name.partition("/")[0], "/" + r.name.partition("/")[2]))]
    best = max(fit, key=lambda r: len(r.name), default=None)
    pattern = sorted(r.name for r in U.PATTERN_RULES if re.search(r.pattern, host + path))
    verdict = best.verdict if best else "block" if pattern else "allow"
    return host, path, best and best.name, verdict


@pytest.mark.parametrize("literal", [U.MAX_LITERAL_RULES, 0])
def test_equals_brute_force(spark, monkeypatch, literal):
    monkeypatch.setattr(U, "MAX_LITERAL_RULES", literal)
    rows = [(i if i != 4 else None, u, "h", "v") for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, _id string").repartition(3)
    got = sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in U.judge(df).collect())
    want = sorted((i is None, i or 0, *(x or "" for x in brute(u))) for i, u, *_ in rows)
    assert got == want


def test_rules_are_stored_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "token string")
    rules = [U.Rule("r", "block", "a.*b", ("b", "a")), U.Rule("s", "block", "b.*c", ("c", "b")),
             U.Rule("t", "block", "z", ("z", "a")), U.Rule("u", "block", "a|c", ("c", "a"))]
    got = {r["name"]: r["token"] for r in U.rarest_token_index(urls, U.rule_table(spark, rules), True).collect()}
    assert got == {"r": "a", "s": "c", "t": "z", "u": "a"}


def test_only_fetched_rules_run(spark):
    df = spark.createDataFrame([(1, "http://nothing.example.xyz/q")], "page_id long, url string")
    assert U.judge(df).first().n_candidates == 0


def test_no_python_in_the_plan_and_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none).count() == 0
    df = U.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert U.judge(none, rules=()).count() == 0
