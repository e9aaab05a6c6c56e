import random

from tendril.llm import urls

RULES = [*urls.RULES, ("a.example.net", "/en/x", "block"), ("net", "/e", "allow"), ("com", "", "block"), ("x.com", "/", "allow"), ("x.com", "/", "block")]


def plain(url, rules, otherwise="allow"):
    """The contract, letter by letter."""
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    ends = lambda s, marks: min([s.index(m) for m in marks if m in s], default=len(s))
    host = rest[: ends(rest, "/?#")]
    path = rest[len(host) :]
    path = path[: ends(path, "?#")]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, otherwise)))


def test_equals_plain_matching(spark):
    rng = random.Random(5)
    hosts = ["net", "example.net", "A.Example.NET", "b.a.example.net", "xexample.net", "example.com", "x.com", "y.x.com", "org", "k.org", "net.", ".net", "a..net", "u@h.net", "h.net:80", "", "Ünet", "example.net.evil"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/xy/z", "/e", "/english", "//en/", "/de/1.html", "/fr/a//b/", "/EN/", "/en\n/x"]
    tails = ["", "?a=/b", "#top", "?x://y", "/"]
    made = [rng.choice(["http://", "https://", "", "x:/", "HTTP://a://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(600)]
    made += [None, "", "://", "http://" + "a." * 5000 + "net" + "/e" * 5000, "http://" + "n" * 100_000]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x", "y") for i, u in enumerate(made)], "page_id long, url string, host string, rule string")
    for rules in (RULES, urls.RULES):
        got = sorted(((x.host, x.path, x.rule, x.verdict) for x in urls.judge(pages, urls.rule_table(spark, rules)).collect()), key=str)
        assert got == sorted((plain(u, rules) for u in made), key=str)


def test_rows_and_rules(spark):
    pages = spark.createDataFrame([(7, "http://a.net/"), (7, "http://a.net/"), (8, "http://a.net/"), (9, "http://a.org/")], "page_id long, url string")
    got = urls.judge(pages, urls.rule_table(spark))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((x.page_id, x.rule, x.verdict) for x in got.collect() if x.rule) == [(7, "net/", "block"), (7, "net/", "block"), (8, "net/", "block")]
    none = urls.rule_table(spark).limit(0)
    assert {x.verdict for x in urls.judge(pages, none, "block").collect()} == {"block"} and urls.judge(pages.limit(0), urls.rule_table(spark)).collect() == []
    for bad in (("", "/", "block"), ("a", "/", "deny")):
        try:
            urls.judge(pages, urls.rule_table(spark, [bad])).collect()
        except Exception as e:
            assert "a rule needs" in str(e)
        else:
            raise AssertionError(bad)
