import random
import zlib

import numpy as np

from millrace.llm import quality


def corpus(n=600, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeinrstlo") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 120))]
        good = r.random() < 0.8
        if not good:
            k = r.randrange(3)
            w = [x + r.choice(["***", "%%%"]) for x in w] if k == 0 else [x.upper() + "!!" for x in w] if k == 1 else [x for x in w[:8] for _ in range(12)]
        rows.append((i, " ".join(w) + "."))
        if r.random() < 0.6:
            labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(make):
    rows, labels = corpus()
    docs, lab = make(rows), make(labels, "doc_id long, quality int")
    got = {g.id: g.score for g in quality.score(docs, quality.train(docs, lab)).collect()}
    held = [(got[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == (q == 1) for s, q in held]) > 0.93
    assert all(0 <= s <= 1 for s in got.values())


def test_held_out_labels_change_nothing(make):
    rows, labels = corpus(200)
    docs = make(rows)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a, b = (quality.train(docs, make(x, "doc_id long, quality int")) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias and a.prior == b.prior


def test_prior_is_near_the_truth():
    r = np.random.default_rng(0)
    p, n = r.normal(2, 1, 4000), r.normal(-2, 1, 4000)
    u = np.concatenate([p[:3000], n[:1000]])
    assert abs(quality.estimate_prior(r.normal(2, 1, 4000), u) - 0.75) < 0.06


def test_odd_inputs(make):
    rows, labels = corpus(100)
    docs = make(rows + [(None, "x"), (1000, None), (1001, ""), (1, rows[1][1]), (1002, "w " * 300_000)])
    model = quality.train(docs, make(labels + [(None, 1), (5, None), (1, 0), (1, 1)], "doc_id long, quality int"))
    assert quality.score(docs, model).count() == 105
    assert quality.score(make([]), model).count() == 0
    assert set(quality.keep_good(docs, model).columns) == set(docs.columns)
    none = quality.train(docs, make([], "doc_id long, quality int"))
    assert {g.score for g in quality.score(docs, none).collect()} == {0.5}
    odd = docs.selectExpr("doc_id", "text", "1 as id", "2 as score", "3 as kind")
    assert quality.score(odd, quality.train(odd, make(labels, "doc_id long, quality int"))).count() == 105


def test_large_ids_beside_null_ids_stay_exact(make):
    from millrace.llm import licenses

    big = 2**60 + 1
    docs = make([(big, licenses.TEMPLATES["MIT"]), (None, "x")])
    model = quality.fit(np.zeros((3, len(quality.FEATURES))), np.ones((3, len(quality.FEATURES))))
    assert {r.id for r in quality.score(docs, model).collect()} == {big, None}
    assert {r.doc_id for r in quality.keep_good(docs, model, 0.0).collect()} == {big, None}
    assert [r.id for r in licenses.scan(docs).collect()] == [big]
