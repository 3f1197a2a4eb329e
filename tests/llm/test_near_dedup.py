import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import near_dedup
from millrace.llm.blocks import block_keys, linked
from millrace.llm.hamming import finer, links, masks, pairs_within


def slow_fingerprint(text, shingle=3):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    sh = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(items, linked):
    up = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    return up


def texts(n=120, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉß") for _ in range(r.randint(1, 5)))
    out = [None, "", "  \n", "One", "one TWO", "É é"]
    for _ in range(n):
        if r.random() < 0.5 and len(out) > 8:
            w = (r.choice(out) or "").split(" ")
            w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            out.append(" ".join(word() for _ in range(r.randint(1, 200))))
    return out + out[:10] + ["w " * 40_000]


def test_fingerprint_is_the_definition():
    for t in texts():
        assert near_dedup.fingerprint(t) == slow_fingerprint(t)
    assert near_dedup.fingerprint("a\x1cb c") == slow_fingerprint("a\x1cb c")


def test_groups_against_brute_force(make):
    t = texts()
    rows = [(i, x) for i, x in enumerate(t)] + [(None, "One"), (3, "One"), (None, "no other text is like this one at all")]
    got = near_dedup.simhash_groups(make(rows)).collect()
    f = [slow_fingerprint(x) for _, x in rows]
    up = classes(f, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for (i, _), c in zip(rows, up):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted((str(i), fp, str(least[c])) for (i, _), fp, c in zip(rows, f, up))
    assert sorted((str(g.id), g.fp & (1 << 64) - 1, str(g.component)) for g in got) == want


def test_empty_table_and_clashing_columns(make, spark):
    assert near_dedup.simhash_groups(make([])).count() == 0
    odd = make([(1, "a b c"), (2, "a b c")]).selectExpr("doc_id", "text", "1 as id", "2 as fp", "3 as component", "4 as kept_id")
    assert near_dedup.drop_near_copies(odd).count() == 1


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_pairs(radius):
    r = np.random.default_rng(radius)
    fps = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    for i in range(200, 400):
        fps[i] = fps[r.integers(0, 200)] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)))
    keys = np.sort(r.integers(0, 4, 400))
    got = {(int(i), int(j)) for a, b in pairs_within(keys, fps, radius) for i, j in zip(a, b)}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if keys[i] == keys[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius}
    assert got == want


def test_hot_buckets_are_dealt_again(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "id long, fp long")
    edges = [(e.a, e.b) for e in links(df, 2, 4, limit=20).collect()]
    up = list(range(len(fps)))
    for a, b in edges:
        assert bin(fps[a] ^ fps[b]).count("1") <= 2
        x, y = up[a], up[b]
        up = [y if z == x else z for z in up]
    want = classes(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert len({(a, b) for a, b in zip(up, want)}) == len(set(up)) == len(set(want))


def test_masks_cover_every_pair():
    for m in masks(2, 4):
        assert len(masks(2, 4)) == 6 and bin(m).count("1") == 32
        assert all(x & m == m for x in finer(m, 2))
        rest = [x & ~m for x in finer(m, 2)]
        assert sum(rest) == ~m & (1 << 64) - 1


def test_copies_are_dropped_at_jaccard(make):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(40):
        w = [word() for _ in range(r.choice((60, 100, 200)))]
        rows.append((2 * i, " ".join(w)))
        for k in r.sample(range(len(w)), r.choice((1, 1, 2, 3))):
            w[k] = word()
        rows.append((2 * i + 1, " ".join(w)))
    rows += [(100, None), (101, ""), (None, "a b"), (102, "A b"), (None, "no other text is like this one at all")]
    rows += [(200 + i, " ".join(["very large group of near copies that differ in one last word only and in no other word at all so it is", f"w{i}"])) for i in range(30)]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    up = classes(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    least = {}
    for (i, _), c in zip(rows, up):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    keep = set(least.values())
    got = near_dedup.drop_near_copies(make(rows)).collect()
    assert sorted(map(str, (g.doc_id for g in got))) == sorted(str(i) for i, _ in rows if i in keep)
    linked = [i for i in range(0, 80, 2) if up[i] == up[i + 1]]
    assert sum(bin(near_dedup.fingerprint(rows[i][1]) ^ near_dedup.fingerprint(rows[i + 1][1])).count("1") > 2 for i in linked) > 5


def test_copies_that_share_no_block_are_dropped(make):
    """A word of every block of a text is changed, which leaves a Jaccard similarity over 0.8 and no block."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    keys = lambda w: set(block_keys(np.zeros(len(w), np.int64), near_dedup.shingles(" ".join(w), 1), np.ones(len(w)), near_dedup.BLOCKS, near_dedup.PER_BLOCK)[1].tolist())
    first = [word() for _ in range(400)]
    other, apart = list(first), 0
    while keys(first) & keys(other):
        k = r.randrange(400)
        changed = other[:k] + [word()] + other[k + 1 :]
        if other[k] == first[k] and len(keys(first) & keys(changed)) < len(keys(first) & keys(other)):
            other, apart = changed, apart + 1
    assert 400 - apart >= 0.8 * (400 + apart)
    rows = [(1, " ".join(first)), (2, " ".join(other)), (3, " ".join(word() for _ in range(400)))]
    assert sorted(g.doc_id for g in near_dedup.drop_near_copies(make(rows), shingle=1).collect()) == [1, 3]


def test_rarest_shingles_meet():
    r = np.random.default_rng(9)
    counts = r.integers(0, 3, 1 << near_dedup.SLOTS).astype(np.uint32)
    for n in [1, 2, 4, 5, 6, 9, 10, 45, 400] * 20:
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        gone = r.integers(0, n // 5 + 1)
        b = np.unique(np.r_[r.permutation(a)[gone:], r.integers(0, 1 << 63, r.integers(0, n // 5 - gone + 1), dtype=np.uint64)])
        if near_dedup.jaccard(a.tobytes(), b.tobytes()) >= 0.8 - 1e-12:
            assert set(near_dedup.rarest(a, counts, 0.8)) & set(near_dedup.rarest(b, counts, 0.8))


def test_only_texts_of_near_sizes_travel(make, monkeypatch):
    """Texts that share their rarest shingles with none but texts of other sizes aren't asked for."""
    r, asked = random.Random(3), []
    words = lambda n: [" ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))]
    monkeypatch.setattr(near_dedup, "linked", lambda keyed, values, *a, **kw: linked(keyed, lambda wanted: asked.append(wanted.count()) or values(wanted), *a, **kw))
    shared, common, copied = words(30), words(60), words(90)
    rows = [(1, shared), (2, shared + common), (3, copied), (4, copied + words(1)), *((k, common + words(200)) for k in range(5, 10))]
    assert {g.doc_id for g in near_dedup.drop_near_copies(make([(k, " ".join(t)) for k, t in rows])).collect()} == {1, 2, 3, *range(5, 10)}
    assert asked == [2]
