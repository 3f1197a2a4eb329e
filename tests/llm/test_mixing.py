import random

import numpy as np
import pytest

from millrace.llm import mixing as M

LABELS = "doc_id long, domain string"


def corpus(n=300, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        d = r.choices(["clean", "low", "toxic"], [0.7, 0.2, 0.1])[0]
        w = [word() for _ in range(r.randint(10, 80))]
        if d == "low":
            w = [x + "!!" for x in w]
        if d == "toxic":
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["grrr", "bah"])
        rows.append((i, " ".join(w)))
        if r.random() < 0.6:
            labels.append((i, d))
    return rows, labels


def test_totals_meet_targets_and_match_a_plain_solver(make):
    rows, labels = corpus()
    docs = make(rows)
    fitted = M.fit(docs, make(labels, LABELS), M.TARGETS, M.HEADROOM)
    got = M.mix(docs, fitted).selectExpr("row.doc_id", "tokens", "p", "rate", "copies").collect()
    t = np.array([g.tokens for g in got], float)
    p = np.array([g.p for g in got])
    r = np.array([g.rate for g in got])
    assert np.allclose(p.sum(1), 1) and (r >= 0).all() and {g.doc_id: g.tokens for g in got} == {i: len(x.split()) for i, x in rows}
    assert fitted.reached["converged"] and np.allclose(fitted.reached["tokens"], (t * r) @ p)
    share = np.array(list(M.TARGETS.values()))
    want = share / share.sum() * M.HEADROOM * (t * p[:, 0]).sum() / (share[0] / share.sum())
    reached = (t * r) @ p
    assert np.abs(reached - want).max() / want.sum() < 2e-4
    plain = np.ones(len(t))  # brute force: projected gradient over single documents
    for _ in range(20_000):
        plain = np.maximum(0, plain - p @ ((t * plain) @ p - want) / t.sum())
    assert np.abs((t * plain) @ p - want).max() / want.sum() < 5e-3
    # a copy count is the whole part of the rate, or one more
    assert all(np.floor(x) <= g.copies <= np.floor(x) + 1 for x, g in zip(r, got))


def test_posteriors_follow_labels(make):
    rows, labels = corpus(seed=5)
    docs, truth = make(rows), dict(labels)
    tables = M.train(docs, make([x for x in labels if x[0] % 4], LABELS), list(M.TARGETS))
    held = [(truth[g.doc_id], g.p) for g in M.members(docs, tables).select("row.doc_id", "p").collect() if g.doc_id in truth and g.doc_id % 4 == 0]
    assert np.mean([list(M.TARGETS)[int(np.argmax(p))] == d for d, p in held]) > 0.85


def test_posteriors_are_naive_bayes(make):
    """Each posterior from the tables by hand, word by word."""
    rows, labels = corpus(120, seed=6)
    tables = M.train(make(rows), make(labels, LABELS), list(M.TARGETS))
    for g in M.members(make(rows), tables).select("row.text", "tokens", "p").collect():
        w = g.text.split()
        score = tables.base.copy()
        for x in set(w) & set(tables.words):
            score = score + tables.words[x]
        odd, distinct = sum(x[-1] in M.MARKS for x in w) / len(w), len(set(w)) / len(w)
        for table, edges, x in zip(tables.bins, (M.MARK_EDGES, M.DISTINCT_EDGES, M.LENGTH_EDGES), (odd, distinct, len(w))):
            score = score + table[sum(x >= e for e in edges)]
        want = np.exp(score - score.max())
        assert g.p == pytest.approx(list(want / want.sum()), abs=1e-9)


def test_targets_that_cannot_be_met(make):
    """With posteriors fixed, a domain that no document belongs to can't grow: the nearest totals are found and said."""
    rows = make([(float(i), [1.0, 0.0]) for i in range(1, 9)], "tokens double, p array<double>")
    steps, reached = M.fit_rates(rows, [0.5, 0.5])
    assert not reached["converged"] and reached["tokens"][1] == 0 and reached["tokens"][0] == pytest.approx(18.0, rel=1e-3)


def test_odd_inputs(make):
    rows, labels = corpus(60)
    odd = rows + [(None, "x y"), (1000, None), (1001, ""), (1, rows[1][1]), (1002, "w " * 100_000)]
    docs = make(odd).selectExpr("*", "1 as m", "2 as row", "3 as rate", "4 as copies", "5 as p", "6 as tokens", "7 as _m")
    out = M.mixed(docs, make(labels + [(None, "clean"), (2, None)], LABELS), M.TARGETS, M.HEADROOM)
    assert out.schema == docs.schema and out.count() > 0
    got = {str(g.row.doc_id): g for g in M.mix(docs, M.fit(docs, make([], LABELS), M.TARGETS)).collect()}
    assert len(got) == len(rows) + 4 and got["1000"].tokens == got["1001"].tokens == 0
    assert M.mixed(make([]), make([], LABELS), M.TARGETS, M.HEADROOM).count() == 0


def test_domain_labels(make):
    lab = make([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {g.doc_id: g.domain for g in M.domain_labels(lab).collect()} == {1: "low", 2: "toxic", 3: "clean", 4: None}
