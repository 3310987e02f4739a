from vecloom.llm import url_rules as U


def judged(spark, urls, links=(), rules=U.RULES):
    pages = spark.createDataFrame([(i, u, None, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, node string, verdict string")
    ends = spark.createDataFrame(list(links), "src string, dst string")
    return {r.page_id: r for r in U.judge_urls(pages, rules, ends, ["page_id"]).collect()}


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule, verdict in U.RULES:
        h, p = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


URLS = [None, "", "nothing", "http://A.Example.COM/en/71?x#y", "http://a.com/en/1", "https://notexample.com/en/7", "x://net/de/8", "http://b.example.net/de/88", "http://com", "http://com?q=/en/", "http://É.com/en/",
        "http://a.org/es/../", "a://b://c.com/en/", "http://example.com/en/7#z", "://org/es/", "http://user@com/en/\nline", "http://com/en/" + "z" * 50_000]


def test_hosts_paths_and_rules(spark):
    got = judged(spark, URLS)
    for i, u in enumerate(URLS):
        host, path, best = by_hand(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "allow")


def test_aliases_take_blocks_and_allows(spark):
    urls = ["http://q.io/a", "http://q.io/b", "http://com/en/x", "http://z.io/1", "http://example.com/en/7", "http://z.io/2", "http://alone.io/", "http://r.io/#frag", "http://r.io"]
    links = [("q.io/a", "q.io/b"), ("q.io/b", "com/en/x"), ("z.io/1", "example.com/en/7"), ("z.io/1", "org/es/q"), ("z.io/2", "z.io/1"), (None, "q.io/a"), ("alone.io/", "alone.io/"), ("r.io/", "com/en/gone")]
    got = judged(spark, urls, links)
    assert [got[i].verdict for i in range(9)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "block"]
    assert got[0].alias_of == got[2].alias_of == "com/en/x" and got[6].alias_of is None


def test_long_chain(spark):
    n = 60
    links = [(f"h.io/{i}", f"h.io/{i + 1}") for i in range(n)] + [(f"h.io/{n}", "com/en/1")]
    got = judged(spark, [f"http://h.io/{i}" for i in range(n)], links)
    assert {r.verdict for r in got.values()} == {"block"}


def test_links_in_html(spark):
    html = [
        '<html><link href="https://com/en/1" rel="canonical"></html>', "<LINK REL=canonical HREF='/en/2'>", '<meta http-equiv="refresh" content="0; url=//org/es/3">',
        '<link rel="stylesheet" href="http://com/en/4">', None, '<meta http-equiv="refresh" content="5">']
    pages = spark.createDataFrame([(i, f"http://x.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in U.html_links(pages).collect() if r.src and r.dst}
    assert got == {("x.com/0", "com/en/1"), ("x.com/1", "x.com/en/2"), ("x.com/2", "org/es/3")}
    out = {r.page_id: r.verdict for r in U.judge_urls(pages, U.RULES, U.html_links(pages), ["page_id"]).collect()}
    assert out == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_empty_and_repeated(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://com/en/"), (1, "http://com/en/")], "page_id long, url string")
    none = spark.createDataFrame([], "src string, dst string")
    assert U.judge_urls(pages, U.RULES, none, ["page_id"]).count() == 2


BASE = "http://b.com/b/c/d;p?q#f"
#: Target and node that it means on BASE (RFC 3986, 5.4).
TARGETS = {
    "g": "b.com/b/c/g", "./g": "b.com/b/c/g", "g/": "b.com/b/c/g/", "/g": "b.com/g", "//g": "g/", "?y": "b.com/b/c/d;p?y", "g?y": "b.com/b/c/g?y", "#s": "b.com/b/c/d;p?q", "g;x=1/../y": "b.com/b/c/y",
    ".": "b.com/b/c/", "..": "b.com/b/", "../g": "b.com/b/g", "../..": "b.com/", "../../../g": "b.com/g", "/./g": "b.com/g", "/../g": "b.com/g", "g..": "b.com/b/c/g..", "./../g": "b.com/b/g", "": None,
    "mailto:a@x.com": None, "javascript:go('http://com/')": None, "g?u=http://com/en/1": "b.com/b/c/g?u=http://com/en/1", " \n/g\t": "b.com/g", "HTTP://Com/en/../x": "com/en/../x",
}


def test_targets_are_resolved(spark):
    got = spark.createDataFrame([(t,) for t in TARGETS], "t string").select("t", U.node_of(U.resolved(U.F.lit(BASE), U.F.col("t"))).alias("node"))
    assert {r.t: r.node for r in got.collect()} == TARGETS
    assert spark.range(1).select(U.node_of(U.resolved(U.F.lit("http://b.com"), U.F.lit("g")))).first()[0] == "b.com/g"


def test_relative_escaped_and_repeated_tags(spark):
    html = [
        '<meta http-equiv="refresh" content="0; url=page2.html">', "<meta http-equiv=refresh content='0;URL=\"?id=3&amp;x=&#x41;&#66;\"'>", '<link rel="canonical" href="../x?a=1&amp;amp;b=&eacute;&unknown;&">',
        '<link rel=canonical href=one><link rel=canonical data-href=no href=two><meta http-equiv="refresh" content="1;url=three"><META HTTP-EQUIV="refresh" CONTENT="1;url=\'four\'">',
        '<base href="//org/es/"><link rel="canonical" href="y">', '<meta http-equiv="refresh" content="0;url=&#1114112;&#xD800;">', '<meta http-equiv="refresh" content="5">']
    pages = spark.createDataFrame([(i, f"http://x.com/d/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {(r.src[-1], r.dst) for r in U.html_links(pages).collect() if r.dst}
    assert got == {("0", "x.com/d/page2.html"), ("1", "x.com/d/1?id=3&x=AB"), ("2", "x.com/x?a=1&amp;b=é&unknown;&"), ("4", "org/es/y"), ("5", "x.com/d/\ufffd\ufffd")} | {("3", f"x.com/d/{n}") for n in ("one", "two", "three", "four")}
    pages = spark.createDataFrame([(0, "http://com/en/a/", '<meta http-equiv="refresh" content="0; url=../b?x=1&amp;y=2">'), (1, "http://x.io/1", '<link rel="canonical" href="p"><link rel="canonical" href="//com/en/b?x=1&amp;y=2">'), (2, "http://x.io/p", None)], pages.schema)
    assert {r.verdict for r in U.judge_urls(pages, U.RULES, U.html_links(pages), ["page_id"]).collect()} == {"block"}
