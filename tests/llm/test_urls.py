import pytest

from spanwise.llm import urls


@pytest.mark.parametrize("url,host,path", [(None, "", ""), ("no scheme/x", "", ""), ("HTTP://A.Com", "a.com", ""), ("x://É.com/a?b#c", "É.com", "/a"), ("x://h#f/y", "h", ""), ("x://h?q/y", "h", ""), ("x:///p", "", "/p"), ("x://h/a://b", "h", "/a://b")])
def test_split(url, host, path):
    assert urls.split_url(url) == (host, path)


def brute(host, path, rules=urls.RULES):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def test_trie_against_all_rules():
    import itertools

    rules = (*urls.RULES, ("allow", "", "/x"), ("block", "a.b", ""), ("allow", "b", "/s/t/"), ("block", "b", "/s/t"), ("allow", "a.b", "/s"))
    trie = urls.Trie(rules)
    hosts = ["", "com", "example.com", "m.example.com", "badexample.com", "net", "x.example.net", "org", "b", "a.b", "c.a.b", ".com", "com."]
    paths = ["", "/", "/en/", "/en/7", "/en/71/a", "/en", "/de/8", "/de/9", "/es/", "/x", "/xy/", "/s/t", "/s/t/", "/s/tu", "/s", "//"]
    for host, path in itertools.product(hosts, paths):
        assert trie.match(host, path) == brute(host, path, rules), (host, path)


def test_table(spark):
    rows = [(1, "https://m.example.com/en/7?x"), (2, "http://a.com/en/1"), (2, "http://a.com/en/1"), (3, None), (None, "x://example.net/de/81"), (4, "x://n.net/de/" + "y" * 100_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, host string")
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()]
    assert got == [(1, "example.com/en/7", "allow"), (2, "com/en/", "block"), (2, "com/en/", "block"), (3, None, "allow"), (None, "example.net/de/8", "block"), (4, "net/de/", "allow")]
    assert urls.judge(pages.limit(0)).collect() == []
    with pytest.raises(ValueError):
        urls.Trie([("maybe", "a", "/")])


def test_many_and_deep_rules(spark):
    deep = "/" + "a/" * 3000
    rules = [("block", "deep.org", deep), *(("block" if k % 2 else "allow", f"h{k}.com", "/x") for k in range(20_000))]
    pages = spark.createDataFrame([(1, f"x://deep.org{deep}y"), (2, "x://a.h7.com/xy"), (3, "x://h8.com/x"), (4, "x://h8.com/y")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"] and r["rule"][:8], r["verdict"]) for r in urls.judge(pages, rules, "allow").collect()}
    assert got == {1: ("deep.org", "block"), 2: ("h7.com/x", "block"), 3: ("h8.com/x", "allow"), 4: (None, "allow")}
