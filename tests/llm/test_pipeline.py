"""Every stage of the pipeline against a plain version over the rows that the stage before kept."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as P
from millrace.llm import mixing, quality
from tests.llm.test_bpe import PATTERN, RANKS
from tests.llm.test_line_dedup import brute
from tests.llm.test_near_dedup import classes
from tests.llm.test_quality import corpus


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(9)
    rows, labels = corpus(150, seed=4)
    shared = "a passage that many of the documents share and that is long enough to be seen as one"
    docs = [(i, "\n".join([t, shared] if i % 5 == 0 else [t]), "en", f"src{i % 3}", len(t)) for i, t in rows]
    docs += [(200 + i, docs[i][1], "fr", "src0", 1) for i in range(20)]
    docs += [(300 + i, docs[i][1].replace("e", "a", 1), "fr", "src0", 1) for i in range(20)]
    docs += [(400, None, None, None, None), (401, "", "de", "src1", 0), (None, "no id " * 20, None, None, None), docs[3], (402, "w " * 60_000, "en", "src1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, int(r.random() < 0.1)) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows of the documents and of what each stage made of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{sf_dir}/stage{k}")
        docs = spark.read.parquet(f"{sf_dir}/stage{k}")
        out.append(docs.collect())
    return out


def key(rows):
    return sorted(map(repr, rows))


def test_quality(stages, spark, sf_dir):
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in stages[0] if model.score(np.array([quality.features(r.text)]))[0] >= 0.3]
    assert key(stages[1]) == key(want) and 0 < len(want) < len(stages[0])


def test_line_dedup(stages):
    """All pairs compared by edit similarity; a pair that is similar but shares no block may only leave more lines."""
    rows = [(r.doc_id, r.text) for r in stages[1]]
    assert sorted((str(r.doc_id), str(r.text)) for r in stages[2]) == brute(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stages[2])


def test_near_dedup(stages):
    """All pairs compared by the Jaccard similarity of five-word shingles."""
    rows, sets = stages[2], []
    for r in rows:
        w = (r.text or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    up = classes(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    least = {}
    for r, c in zip(rows, up):
        ids = [x for x in (least.get(c), r.doc_id) if x is not None]
        least[c] = min(ids) if ids else None
    keep = set(least.values())
    assert key(stages[3]) == key([r for r in rows if r.doc_id in keep]) and len(stages[3]) < len(rows)


def test_mixing(stages, spark, sf_dir):
    """Rows stay or repeat as a whole, and the tokens by posterior, as drawn, are near the targets."""
    docs = spark.read.parquet(f"{sf_dir}/stage2")
    fitted = mixing.fit(docs, mixing.domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")), mixing.TARGETS, mixing.HEADROOM)
    p = {repr(r.row): (r.tokens, r.p, r.rate) for r in mixing.mix(docs, fitted).collect()}
    n = Counter(map(repr, stages[4]))
    assert set(n) <= set(map(repr, stages[3]))
    assert all(int(rate) <= n[row] / m <= int(rate) + 1 for row, m in Counter(map(repr, stages[3])).items() for rate in [p[row][2]])
    expected = sum(m * p[row][0] * p[row][2] * np.array(p[row][1]) for row, m in Counter(map(repr, stages[3])).items())
    assert np.allclose(expected, fitted.reached["tokens"], rtol=1e-6)


def test_tokens_and_run(stages, spark, sf_dir):
    enc = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = []
    for r in stages[4]:
        ids = np.array(enc.encode_ordinary(r.text or ""), "<u4")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:]) for r in stages[5]) == sorted(want)
    assert key(P.run(spark, sf_dir).collect()) == key(stages[5])


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, f in P.STAGES:
        assert f(spark, docs, sf_dir).count() == 0
