import random

import numpy as np
import pytest

from millrace.llm.common import BitFilter, components


def test_components_against_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(1, 1), (None, 2), (3, None)]
    up = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((up[a], up[b]))
            up = {k: x if v == y else v for k, v in up.items()}
    ends = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, up[x]) for x in ends)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = [random.Random(2).getrandbits(64) - 2**63 for _ in range(500)] + [-1, 0, 2**63 - 1, -(2**63)]
    f = BitFilter.of(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert f.might_contain(np.array(keys, np.int64)).all()
    assert f.might_contain(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)).mean() < 0.05


def test_a_filter_reaches_the_driver_as_bytes(spark, monkeypatch):
    """Rows of a word each would fill the driver: 4.5 million keys took over 500 MB of its Python."""
    frame, sent = type(spark.range(1)), []
    monkeypatch.setattr(frame, "toPandas", lambda self: pytest.fail("rows are gathered"))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sent.append(len(got := collect(self))) or got)
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS k")
    f = BitFilter.of(keys, "k")
    assert sum(sent) < 100
    assert f.might_contain(np.array([r.k for r in collect(keys)], np.int64)).all()
    assert f.might_contain(np.arange(1 << 62, (1 << 62) + 1000)).mean() < 0.5
