"""Stable colours and ambiguous parts in blocks, against the operators that join tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graphs, lp
from millrace.plans import registry


def classes(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), set()).add(r.node)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_are_the_tables(spark, monkeypatch, seed):
    """Leaves, twins, pairs apart, loops, two edges of one pair, nodes alone and rows that repeat."""
    r = random.Random(seed)
    edges, nodes = set(), {}
    for model in (1, 2):
        own = [model * 1000 + i for i in range(70)]
        nodes |= {n: (r.choice([3, 4]), model) for n in own}
        for _ in range(55):
            a, b, w = r.choice(own[:60]), r.choice(own[:60]), r.choice([7, 8])
            edges |= {(a, b, w), (b, a, w)}
    near = [(a, b, w) for a, b, w in edges]
    rows = [(n, *c, None, None) for n, c in nodes.items()] + 2 * [(a, *nodes[a], b, w) for a, b, w in near]
    r.shuffle(rows)
    monkeypatch.setattr(graphs, "ROWS", 60)
    got = graphs.ambiguous_parts(spark.createDataFrame(rows, "node long, color long, model long, other long, w long")).collect()
    n, g = spark.createDataFrame([(k, str(c), m) for k, (c, m) in nodes.items()], "node long, color string, model long"), spark.createDataFrame([(a, b, str(w)) for a, b, w in near], "a long, b long, w string")
    want = lp.ambiguous_components(n.select("node", "model").join(lp.stable_colors(n.select("node", "color"), g), "node"), g).collect()
    assert len(got) == len({x.node for x in got}) and {(x.model, x.node) for x in got} == {(x.model, x.node) for x in want}
    assert classes(got, lambda x: (x.model, bytes(x.color))) == classes(want, lambda x: (x.model, x.color))
    assert classes(got, lambda x: (x.model, x.component)) == classes(want, lambda x: (x.model, x.component))


def test_no_rows(spark):
    assert graphs.ambiguous_parts(spark.createDataFrame([], "node long, color long, model long, other long, w long")).collect() == []


def test_keys_of_any_size(spark):
    """Keys that don't fit beside their line number are counted out; nulls make no edge."""
    at = [(1, 1, 1, "A"), (1, 2, 1, "N"), (2, 3, 1, "A"), (3, 3, 2, "A"), (4, 4, 2, None), (5, None, 2, "A"), (None, 4, 2, "A"), (6, 5, None, "A")]
    make = lambda f: spark.createDataFrame([(o and f(o), p and f(p), m, w) for o, p, m, w in at], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string")
    answer = lambda f: sorted(map(tuple, registry.ambiguous_components(make(f)).collect()))
    large = answer(lambda x: (1 << 62) + x)
    assert answer(lambda x: x) == large == answer(lambda x: -(1 << 63) + x)


def test_tables_of_past_rounds_go(spark):
    """What the query leaves in the shared folder is less than it read twice over."""
    path = "/root/testdata/sf0.01"
    folder = lambda: (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
    size = lambda top: sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(top) for x in names) if top else 0
    before = size(folder())
    assert registry.QUERIES["ambiguous_components"](spark, path).agg(F.count("*")).first()[0] == 7
    assert size(folder()) - before < 2 * os.path.getsize(f"{path}/lineitem.parquet")
