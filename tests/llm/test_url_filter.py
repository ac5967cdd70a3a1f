from framespan.llm.boosting import fit
from framespan.llm.url_filter import RULES, op3


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best or (None, None)


URLS = [None, "", "no scheme", "http://", "http://A.COM/x", "http://a.com", "https://example.com/en/1", "http://www.example.com/en/1?x=1", "http://m.www.EXAMPLE.com/en/", "http://badexample.com/en/2", "http://a.net/fr/x#y", "http://net/es/", "http://netnet/es/",
        "http://a.net?u=/es/", "x://y://z/en/", "ftp://Ü.NET/es/\nq", "http://u:p@h.net:80/fr/", "//a.com/", "http://a.com#/", "http://example.com/EN/"]


def check(pages, urls):
    got = op3(pages).collect()
    assert len(got) == len(urls)
    want = sorted((str(i), *parts(u), str(rule_of(*parts(u))[1])) for i, u in urls)
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"])) for r in got) == want
    for r in got:
        assert r["verdict"] == rule_of(r["host"], r["path"])[0] if r["rule"] else r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")


def test_edges(spark):
    rows = [(k, u, "h", "p") for k, u in enumerate(URLS)] + [(3, URLS[6], None, "p"), (None, URLS[7], "h", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    check(pages, [(r[0], r[1]) for r in rows])
    assert op3(pages.limit(0)).count() == 0


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    check(pages, [(r["page_id"], r["url"]) for r in pages.collect()])


def test_learned_from_labelled_urls():
    import numpy as np

    from framespan.llm.url_filter import lexical

    bad = [f"http://free-{k}-pills{k * 7919}.example.info/p?id={k}&a=1&b=2" for k in range(400)]
    good = [f"https://www.paper.example.org/articles/{k}/about-the-town" for k in range(400)]
    x = np.array([lexical(u, *parts(u), 0.5, 0.5) for u in bad + good])
    y = np.array([1.0] * 400 + [0.0] * 400)
    train = np.arange(800) % 4 != 0
    p = fit(x[train], y[train], depth=3, trees=40).probability(x[~train])
    assert ((p >= 0.5) == y[~train]).all()
