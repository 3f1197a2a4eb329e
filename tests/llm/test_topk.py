import math
import random

import pytest

from millrace.llm import topk

S = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=8, sparse=False):
    r = random.Random(4)
    f = lambda: 0.0 if sparse and r.random() < 0.7 else round(r.gauss(0, 0.2), 3)
    out = [(i, [f() for _ in range(d)]) for i in range(n)]
    out += [(1000 + i, out[50][1]) for i in range(20)]  # copies of a query tie
    return out + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * d), (2050, [float("inf")] * d), (None, [0.5] * d), (7, [9.0] * d), (100, out[100][1]), (2100, []), (2150, [0.3, -0.2])]


def brute(rows, k):
    import numpy as np

    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for q, v in ok:
        if q % 50 or (q, tuple(v)) in done:
            continue
        done.add((q, tuple(v)))
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("pass_bytes", [200, 1 << 20])
def test_against_brute_force(make, sparse, pass_bytes):
    rows = vectors(sparse=sparse)
    df = make(rows, S)
    got = topk.exact_top_k(df, df.where("vec_id % 50 = 0"), pass_bytes=pass_bytes).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_few_candidates_and_empty(make):
    df = make([(0, [1.0]), (50, [2.0])], S)
    assert sorted(map(tuple, topk.exact_top_k(df, df).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.exact_top_k(make([], S), make([], S)).count() == 0
    odd = df.selectExpr("vec_id", "embedding", "1 as id", "2 as v", "3 as row", "4 as score")
    assert topk.exact_top_k(odd, odd).count() == 2
