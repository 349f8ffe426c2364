from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from check_oracle import compare, database
from tollbook.llm import registered
from tollbook.llm import url_templates as u

SCHEMA = "page_id long, url string, host string, path string, purity string, html string"


def frame(spark, urls):
    return spark.createDataFrame([(n, x, "h", "p", "q", None) for n, x in enumerate(urls)], SCHEMA)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in rest[:at]), rest[at:end]


def test_parse_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://example.org/en/12", "x://notexample.org/es/", "a://b://c/d",
        "http://É.com/FR/", "http://com/fr/1", "http://sub.com/de/\nline", "http://x.org", "http://h?a/b", "http://h#/fr/",
    ]
    got = {r["page_id"]: r for r in u.judge(frame(spark, urls), registered.URL_RULES).collect()}
    assert len(got) == len(urls)
    for n, url in enumerate(urls):
        host, path = split(url)
        fits = [r for r in registered.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert (got[n]["host"], got[n]["path"]) == (host, path)
        assert got[n]["rule"] == (rule.host + rule.path if rule else None)
        if rule:
            assert got[n]["verdict"] == rule.verdict
        assert got[n]["verdict"] in ("allow", "block")


def test_templates_block_what_no_rule_names(spark):
    rules = (u.Rule("block", "shop.net", "/deals/2"), u.Rule("allow", "shop.net", "/guide/"))
    urls = [f"http://shop.net/deals/2{n:03}" for n in range(40)] + [f"http://shop.net/guide/{n}" for n in range(40)]
    urls += ["http://shop.net/deals/9001", "http://shop.net/other/9001", "http://else.net/deals/1"]
    got = {r["page_id"]: r for r in u.judge(frame(spark, urls), rules).collect()}
    assert got[80]["verdict"] == "block" and got[80]["rule"] is None and got[80]["template"] == "shop.net/deals/*"
    assert got[81]["verdict"] == got[82]["verdict"] == "allow"


def test_similar_branches_merge(spark):
    rules = (u.Rule("block", "h.net", "/c/"), u.Rule("allow", "h.net", "/a/"), u.Rule("allow", "h.net", "/b/"))
    urls = [f"http://h.net/{part}/p{n}q" for part in "abc" for n in range(30)]
    found = {r["path"]: r["template"] for r in u.judge(frame(spark, urls), rules).collect()}
    assert found["/c/p1q"].startswith("h.net/c/")


def test_empty(spark):
    assert u.judge(frame(spark, []), registered.URL_RULES).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_its_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert compare(spark, database(folder), folder, registered.op9_url_templates, registered.llm_oracles()["op9_url_templates"]) == []


@given(st.text(alphabet="aB/:?#.", max_size=20))
def test_split_is_the_pattern(text):
    import re

    found = re.match(u.URL, text)
    own = found.groups() if found else ("", "")
    assert ("".join(c.lower() for c in own[0]), own[1]) == split(text)
