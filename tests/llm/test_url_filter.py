import random

import pytest

from millrace.llm import url_filter as U

S = "page_id long, url string, html string, h string, score double"


def brute_rule(host, path):
    best = None
    for r, v in U.RULES:
        rh, rp = r.split("/", 1)
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return best


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:k].translate({c: c + 32 for c in range(65, 91)})
    tail = rest[k:]
    k = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return host, tail[:k]


URLS = [None, "", "no scheme/x", "http://NET/", "http://net", "https://a.b.net/x?y=/en/", "http://Example.NET/en/1#top", "http://m.example.net/en", "ftp://example.com/de/1", "http://example.com/DE/1", "http://x.org/fr/", "http://x.org/fr", "http://myorg/fr/", "http://a://b/c", "HTTP://É.org/fr/é", "http://?q", "x://h#f", "http://a.net\n/x"]


def test_rules_and_parts(make):
    got = {g.page_id: g for g in U.judge(make([(i, u, None) for i, u in enumerate(URLS)], S)).collect()}
    for i, u in enumerate(URLS):
        h, p = split(u)
        r = brute_rule(h, p)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, r and r[0]), u
        seed = brute_rule(h, "/")  # a host that is blocked whole distrusts itself
        assert got[i].verdict == (r[1] if r else "block" if seed and seed[1] == "block" else "allow")


def power(edges, seeds, rounds=200):
    out = {}
    for (a, b), n in edges.items():
        out.setdefault(a, {})[b] = n
    rank = {h: 0.15 * s for h, s in seeds.items()}
    for _ in range(rounds):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for a, to in out.items():
            for b, n in to.items():
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * n / sum(to.values())
        rank = new
    return rank


def test_propagation_against_brute_force(make):
    r = random.Random(3)
    hosts = [f"h{i}.com" for i in range(12)] + ["good.org", "bad.net"]
    rows, edges, good, bad = [], {}, {}, {}
    for i in range(120):
        h = r.choice(hosts)
        to = [r.choice(hosts) for _ in range(r.randint(0, 4))]
        p = r.choice(["/fr/", "/x"])
        rows.append((i, f"http://{h}{p}", "".join(r.choice([f'<a href="http://{t}/y">', f"<A class=x HREF='//{t}'>", f"<a href=https://{t}?q>"]) for t in to) + '<a href="/local">'))
        for t in to:
            if t != h:
                edges[h, t] = edges.get((h, t), 0) + 1
        if h == "bad.net":
            bad[h] = bad.get(h, 0) + 1
        elif p == "/fr/" and h.endswith("org"):
            good[h] = good.get(h, 0) + 1
    norm = lambda d: {k: v / sum(d.values()) for k, v in d.items()}
    trust = power(edges, norm(good))
    distrust = power({(b, a): n for (a, b), n in edges.items()}, norm(bad))
    for g in U.judge(make(rows, S)).collect():
        t, d = trust.get(g.host, 0), distrust.get(g.host, 0)
        assert g.trust == pytest.approx(t, abs=1e-5) and g.distrust == pytest.approx(d, abs=1e-5)
        if not g.rule and abs(d - t) > 1e-4:
            assert g.verdict == ("block" if d > t else "allow")


def test_no_pages_and_no_rules(make):
    assert U.judge(make([], S)).count() == 0
    assert [g.verdict for g in U.judge(make([(1, "http://net/", ""), (1, "http://net/", "")], S), rules=[]).collect()] == ["allow"] * 2


def test_a_long_chain_is_followed_to_its_end(make):
    """Distrust reaches hosts 40 links away from the blocked one, and nothing trusts them."""
    rows = [(i, f"http://c{i}.com/x", f'<a href="http://c{i + 1}.com/">') for i in range(39)] + [(39, "http://c39.com/x", '<a href="http://bad.net/">'), (40, "http://bad.net/", ""), (41, "http://lone.com/", "")]
    got = {g.page_id: g.verdict for g in U.judge(make(rows, S)).collect()}
    assert [got[i] for i in range(41)] == ["block"] * 41 and got[41] == "allow"
