"""Rules and propagation against plain versions."""

import pytest

from waymerge.llm.urlfilter import RULES, judge, propagate


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    end = next((i for i, c in enumerate(rest) if c in "?#" and i >= at), len(rest))
    return "".join(c.lower() if c.isascii() else c for c in rest[:at]), rest[at:end]


def ruled(host, path):
    fits = [(len(n), n, v) for v, n in RULES for h, _, p in [n.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def power(links, good, rounds=60, d=0.85):
    rank = {h: (1 - d) * v for h, v in good.items()}
    out = {}
    for (a, _), n in links.items():
        out[a] = out.get(a, 0) + n
    base = dict(rank)
    for _ in range(rounds):
        new = dict(base)
        for (a, b), n in links.items():
            new[b] = new.get(b, 0) + d * rank.get(a, 0) * n / out[a]
        rank = new
    return rank


URLS = [None, "", "no scheme", "http://Blog.ORG/x", "https://a.example.org/es/1?u=http://x.com/de/", "http://example.org/en/12#t", "http://example.org/en/21",
        "https://b.com/fr/", "https://b.com/fr", "https://c.com/de/é\n2", "x://host", "http://org", "http://notorg/", "://", "http://spam.net/a", "http://fine.net?b/c", "http://É.Net/"]


def test_judge(spark):
    html = ["<a href='http://c.com/x'>", '<a HREF=" x"><img src=//fine.net/y>', '<a href="https://b.com/q"> <a href=http://c.com>', None]
    rows = [(i // 2 or None, u, html[2] if u and "spam" in u else html[1] if u and ("Blog" in u or "fine" in u) else html[i % 4], "k") for i, u in enumerate(URLS)]
    rows += [(99, "http://spam.net/a", html[0], "k")] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").selectExpr("*", "1 good")
    got = judge(pages).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((i, *split(u), ruled(*split(u))[0]) for i, u, _, _ in rows), key=key)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == want
    for r in got:
        if r.rule:
            assert r.verdict == ruled(r.host, r.path)[1]
        elif r.host in ("spam.net", "fine.net", ""):
            assert r.verdict == ("block" if r.host == "spam.net" else "allow")
    assert judge(pages.limit(0)).count() == 0


def test_propagation(spark):
    links = {("a", "b"): 3, ("b", "c"): 1, ("a", "c"): 1, ("c", "a"): 2, ("d", "e"): 5, ("e", "b"): 1, ("z", "d"): 1}
    good, bad = {"a": 3, "d": 1}, {"e": 2, "a": 2}
    frame = spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n bigint")
    seeds = spark.createDataFrame([(h, good.get(h, 0), bad.get(h, 0)) for h in "ade"], "host string, good bigint, bad bigint")
    got = {r.host: r for r in propagate(frame, seeds, rounds=60, tolerance=0).collect()}
    trust = power(links, {h: v / 4 for h, v in good.items()})
    distrust = power({(b, a): n for (a, b), n in links.items()}, {h: v / 4 for h, v in bad.items()})
    for h in "abcdez":
        assert got[h].trust == pytest.approx(trust.get(h, 0)) and got[h].distrust == pytest.approx(distrust.get(h, 0))
