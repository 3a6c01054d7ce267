"""Redirect equivalence against a plain union-find over random chains, cycles and conflicts."""

import random

import pytest

from sequor.llm import url_filters

RULES = [("block", "com/bad/"), ("allow", "example.com/bad/ok/"), ("block", "spam.org/"), ("allow", "help.spam.org/"), ("block", "com/bad/ok/never/")]


def longest(host, path):
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (0,), (len(rule), verdict == "allow", rule, verdict))
    return best and best[2:]


def split(url):
    rest = url.split("://", 1)[1]
    host = rest.split("/", 1)[0].split("?")[0].split("#")[0]
    return host.lower(), rest[len(host) :].split("?")[0].split("#")[0]


def key(url):
    host, path = split(url)
    query = url.split("#")[0].partition("?")
    return host + path.rstrip("/") + query[1] + query[2]


def plain(urls, edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(key(a))] = root(key(b))
    says = {}
    for u in [*urls, *(x for e in edges for x in e)]:
        found = longest(*split(u))
        if found:
            says.setdefault(root(key(u)), set()).add(found[1])
    out = {}
    for u in urls:
        found, told = longest(*split(u)), says.get(root(key(u)), set())
        out[u] = (found[0] if found else None, found[1] if found else "block" if told == {"block"} else "allow")
    return out


@pytest.mark.parametrize("seed,hot", [(1, 2_000), (5, 2_000), (3, 3)])
def test_random_redirects(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(url_filters, "hot_limit", lambda rows: hot)
    rng = random.Random(seed)
    hosts, paths = ["example.com", "a.example.com", "Other.com", "spam.org", "help.spam.org", "x.net", "y.net"], ["/", "/bad/1", "/bad/ok/2", "/bad/ok/never/3", "/p", "/p/", "/q?a=1", "/q?a=2", "/r#f", "/r"]
    urls = sorted({f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(90)})
    edges = [(a, b) for a, b in zip(urls, urls[1:]) if rng.random() < 0.15]
    edges += [(rng.choice(urls), rng.choice(urls)) for _ in range(6)] + [(urls[0], urls[5]), (urls[5], urls[9]), (urls[9], urls[0])]
    edges += [(rng.choice(urls), f"http://gone.net/{i % 3}") for i in range(6)]
    pages = [(i, u, "<p>x</p>") for i, u in enumerate(urls)] + [(500 + i, urls[3], None) for i in range(20)] + [(900, None, ""), (901, "no scheme", None)]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, key string, at string")
    got = url_filters.judge(df, url_filters.rule_table(spark, RULES), spark.createDataFrame(edges, "src string, dst string")).collect()
    want = plain(urls, edges)
    assert len(got) == len(pages)
    for r in got:
        assert (r.rule, r.verdict) == (want[r.url] if r.url in want else (None, "allow")), r
    # aliases without a rule of their own are decided both ways
    assert {v for u, (rule, v) in want.items() if rule is None} == {"allow", "block"}
