"""Address parts, rules and vocabulary by plain Python."""

import random
import re

import pytest

from dosegrid.llm.url_filter import LIMIT, RULES, VOCABULARY, filter_urls


def plain(url, vocabulary=VOCABULARY, limit=LIMIT):
    host = path = ""
    if url and "://" in url:
        place = re.split("[?#]", url.split("://", 1)[1])[0]
        host, slash, rest = place.partition("/")
        path = slash + rest
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rule = verdict = None
    for says, name in RULES:
        own, _, start = name.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            if rule is None or len(name) > len(rule):
                rule, verdict = name, says
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    met = [w for t, w in vocabulary.items() if re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)]
    own = "block" if sum(met) >= limit else "allow"
    return host, path, rule, verdict or own


@pytest.fixture
def make_pages(spark):
    return lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")


def test_equals_plain_version(make_pages):
    rng = random.Random(2)
    hosts = ["com", "Example.COM", "www.example.com", "a.www.example.com", "notexample.com", "x.net", "net",
             "free-bets.org", "win-cheap.org", "casino-win.io", "xcasino.io", "bet.bet.org", "user@h.org:80", ""]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/", "/fr?x", "//en/", "/a#b/c?d", "?q=/es/", "#/fr/", "/ads/pills\n"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "://") for h in hosts for p in paths]
    urls += [None, "", "example.com/en/", "casino", "http:/x", "a://b://c/en/", "İ://porn.org/"]
    rows = list(enumerate(rng.sample(urls, len(urls))))
    got = filter_urls(make_pages([(i, u, "") for i, u in rows])).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u) for i, u in rows}
    own = {"win": 0.5, "cheap": 1.0, "casino": 3.0, "free-bets": 1.5}
    got = filter_urls(make_pages([(i, u, "") for i, u in rows]), vocabulary=own, limit=1.5).collect()
    assert {r.page_id: r.verdict for r in got} == {i: plain(u, own, 1.5)[3] for i, u in rows}


def test_clashing_columns(make_pages, clashing):
    rows = [(1, "http://x.org/casino", ""), (2, "http://a.net/fr/", "")]
    got = filter_urls(clashing(make_pages(rows))).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: (None, "block"), 2: ("net/fr/", "block")}


def test_edges(make_pages):
    rows = [(1, "http://a.org/", None), (1, "http://a.org/", None), (None, None, None), (2, "http://x.org/" + "win" * 100_000, "")]
    got = filter_urls(make_pages(rows)).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}
    assert filter_urls(make_pages([])).count() == 0
    bare = filter_urls(make_pages([(1, "http://porn.org/", "")]), rules=(), vocabulary={})
    assert bare.first().verdict == "allow"
