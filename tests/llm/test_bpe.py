import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

PATH, PATTERN = bpe.vocabulary()
RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
WANT = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENC = bpe.Encoder(PATH, PATTERN, cache_rows=50)
ODD = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "२", "½", "\x1c", "\x85", "\xa0", " ", "!", "%%%", "the", "ñ", "\r\n", "🙂", "漢字", "'ll", "<|endoftext|>", "x" * 70, "é"]


def ids(t):
    return np.array(WANT.encode_ordinary(t), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=5).filter(lambda s: s.isprintable())), max_size=25).map("".join))
def test_as_the_library(t):
    assert ENC.encode([t]) == [ids(t)]
    assert ENC.decode(ids(t)) == t.encode()


def test_both_ways_of_merging_agree():
    r = random.Random(0)
    pieces = [bytes(r.choice(b"aeinrst\xc3\xa9") for _ in range(r.randint(2, 60))) for _ in range(500)]
    for p in pieces:
        assert ENC.merge_alone(p) == ENC.merge_in_step([p], max(2, 1 << (len(p) - 1).bit_length()))[0]


def test_long_piece():
    t = "ab" * 30_000
    assert ENC.encode([t]) == [ids(t)]


def test_operator(make):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "Hello  world \n the\n end"), (3, "Hello  world \n the\n end"), (4, "word " * 50_000)]
    got = bpe.encode(make(rows), digests=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(str(i), len(ids(t or "")) // 4, sha(ids(t or "")), sha((t or "").encode())) for i, t in rows]
    assert sorted((str(g.id), *g[1:]) for g in got) == sorted(want)
    back = bpe.decode(bpe.encode(make(rows))).collect()
    assert sorted((str(b.id), bytes(b.bytes)) for b in back) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert bpe.encode(make([]), digests=True).count() == 0


@pytest.mark.parametrize("clash", ["id", "ids", "n_tokens"])
def test_clashing_columns(make, clash):
    df = make([(1, "a")]).withColumnRenamed("lang", clash)
    assert bpe.encode(df, digests=True).first().n_tokens == 1
