import random

from millrace.llm import licenses as L

SETS = {k: (t := L.Text(v)).shingles(0, len(t.hash)) for k, v in L.TEMPLATES.items()}


def documents(n=250, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(r.randint(0, 400))]
        for name in r.sample(list(L.TEMPLATES), r.randint(0, 2)):
            t = L.TEMPLATES[name].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = word()
            at = r.randint(0, len(w))
            w[at:at] = t if r.random() < 0.8 else [x.upper() for x in t]
        out.append(" ".join(w))
    return out


def contained(text):
    """The best share of each template in any run of its scale's length, by trying all of them."""
    t, out = L.Text(text), {}
    for name, s in SETS.items():
        m = 1 << (len(s) - 1).bit_length()
        step = max(m // 4, 1)
        best = max((len(s & t.shingles(i, i + m + step)) / len(s) for i in range(0, max(len(t.hash), 1), step)), default=0) if t.n else 0
        if best >= L.CONTAINMENT - 1e-9:
            out[name] = best
    return out


def test_against_brute_force(make):
    rows = list(enumerate(documents())) + [(1000, None), (1001, ""), (None, L.TEMPLATES["MIT"]), (1002, "x " * 200_000 + L.TEMPLATES["GPL-3.0"]), (1002, "only")]
    got = sorted((str(g.id), g.license, round(g.containment, 9)) for g in L.scan(make(rows)).collect())
    assert got == sorted((str(i), n, round(c, 9)) for i, t in rows for n, c in contained(t).items())


def test_band_settings_hold_their_promise():
    for own in SETS.values():
        scale = 1 << (len(own) - 1).bit_length()
        j = L.least_jaccard(scale, len(own))
        assert (1 - j) ** L.bands(j) <= L.MISS


def test_empty_and_clashing(make):
    assert L.scan(make([])).count() == 0
    odd = make([(1, L.TEMPLATES["MIT"])]).selectExpr("doc_id", "text", "1 as id", "2 as license")
    assert [g.license for g in L.scan(odd).collect()] == ["MIT"]
