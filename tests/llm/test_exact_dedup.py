import hashlib
import random

import pytest

from millrace.llm.exact_dedup import MergeIndex, exact_groups


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def expect(rows, largest):
    pick = max if largest else min
    out = []
    for i, t in rows:
        same = [j for j, u in rows if lower(u) == lower(t)]
        ids = [j for j in same if j is not None]
        keep = pick(ids) if ids else None
        out.append((str(i), str(keep), len(same), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out)


def rows():
    r = random.Random(1)
    t = [None, "", "A", "a", "É", "é", "Straße", "STRASSE", "x" * 200_000, "X" * 200_000, " a", "a\x00", "a"]
    out = [(i, r.choice(t)) for i in range(80)] + [(i, f"only {i}") for i in range(80, 120)]
    return out + [(5, out[5][1]), (6, "another text for 6"), (None, "A"), (None, "nobody"), (None, "nobody")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digits", [64, 1])
def test_against_brute_force(make, keep, digits):
    got = exact_groups(make(rows()), keep=keep, digest_digits=digits, memtable_rows=7).collect()
    assert sorted((str(g.id), str(g.keep_id), g.group_size, g.kept, g.text_sha256) for g in got) == expect(rows(), keep == "largest")


def test_empty_table_and_clashing_columns(make):
    assert exact_groups(make([])).count() == 0
    odd = make([(1, "a"), (2, "A")]).selectExpr("doc_id", "text", "'x' as sha", "'y' as digest", "1 as ord", "2 as n", "3 as keep")
    assert [g.keep_id for g in exact_groups(odd).collect()] == [1, 1]


def test_merge_index():
    r = random.Random(2)
    index, want = MergeIndex(memtable_rows=5, fanout=3), {}
    for _ in range(2000):
        d, k = b"%03d" % r.randrange(300), r.randrange(10**6)
        index.put(d, k)
        a, n = want.get(d, (k, 0))
        want[d] = (min(a, k), n + 1)
    run = index.close()
    assert run.digest.tolist() == sorted(want)
    assert dict(zip(run.digest.tolist(), zip(run.least.tolist(), run.n.tolist()))) == want
    assert MergeIndex().close() is None
