"""URL filters against a plain loop over the rules."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import urlfilter as U


def slow(rules, host, path):
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((h.count("."), len(p), verdict == "block", rule, verdict))
    return max(fits)[3:] if fits else (None, "allow")


hosts = st.lists(st.sampled_from(["a", "b", "com", ""]), min_size=1, max_size=4).map(".".join)
paths = st.lists(st.sampled_from(["", "x", "xy", "y"]), max_size=4).map(lambda p: "".join("/" + s for s in p))


@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), hosts.filter(bool), paths), max_size=8), hosts, paths)
def test_longest_rule_wins(rules, host, path):
    rules = [(v, h + (p or "/")) for v, h, p in rules]
    assert U.UrlTrie(rules).judge(host, path) == slow(rules, host, path)


@pytest.mark.parametrize(("url", "want"), [
    (None, ("", "")), ("", ("", "")), ("nothing", ("", "")), ("http://A.b/C?d#e", ("a.b", "/C")), ("x://h", ("h", "")), ("x://h?q=/y", ("h", "")),
    ("x://h#f/y", ("h", "")), ("a://b://c", ("b:", "//c")), ("http://ÀB.com/", ("Àb.com", "/")), ("://h/p", ("h", "/p")), ("x://", ("", "")), ("x://h/" + "a" * 100_000, ("h", "/" + "a" * 100_000)),
])
def test_splitting(url, want):
    assert U.split_url(url) == want


def test_rules_are_checked():
    for bad in (("deny", "a/"), ("block", "/x")):
        with pytest.raises(ValueError):
            U.UrlTrie([bad])
    assert U.UrlTrie([("allow", "a/x"), ("block", "a/x")]).judge("a", "/x") == ("a/x", "block")
    assert U.UrlTrie([], default="block").judge("a", "/") == (None, "block")


def test_building_takes_time_in_proportion(monkeypatch):
    import time

    rules = [("block", f"one.example/{'a' * (i % 50)}{i}") for i in range(60_000)]
    began = time.perf_counter()
    trie = U.UrlTrie(rules)
    assert time.perf_counter() - began < 10  # minutes, where every rule sorts those before it again
    assert trie.judge("one.example", f"/{'a' * 7}59957x") == (f"one.example/{'a' * 7}59957", "block")
    monkeypatch.setattr(U, "MAX_CHARACTERS", 1000)
    with pytest.raises(ValueError):
        U.UrlTrie(rules)


def test_frame(spark):
    rows = [(1, "http://www.example.com/en/7", "h"), (None, None, None), (1, "http://www.example.com/en/7", "h"), (2, "http://z.example.net/de/81", "h")]
    dotted = U.judge_urls(spark.createDataFrame([("a://b/c", {"k": 1})], "`the.url` string, m map<string,int>"), U.RULES, url_col="the.url")
    assert dotted.columns == ["the.url", "m", "host", "path", "rule", "verdict"] and dotted.first().host == "b"
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = U.judge_urls(pages, U.RULES)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(((r.page_id or 0), r.host, r.rule, r.verdict) for r in out.collect()) == [
        (0, "", None, "allow"), (1, "www.example.com", "example.com/en/7", "allow"), (1, "www.example.com", "example.com/en/7", "allow"), (2, "z.example.net", "example.net/de/8", "block"),
    ]
    assert U.judge_urls(pages.limit(0), U.RULES).count() == 0
