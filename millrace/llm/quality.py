"""Operator 5, quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1; everything else it learns from is unlabelled web text. The share of
positives in that text (the class prior) is estimated from the two score distributions, and an additive logistic model
over binned surface features is fitted by minimising prior * R+(positives) + max(0, R-(unlabelled) - prior *
R-(positives)).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, read

#: Most labelled positives, and most unlabelled rows, that a fit looks at.
FIT_ROWS = 12_000
FEATURES = ("words", "mean word", "capital words", "capitals", "digits", "ends in mark", "marks", "odd marks", "repeat marks", "distinct words", "same word again", "distinct lines", "sentence words", "common word", "bare marks", "upper words")
_CLASS = np.zeros(256, np.uint8)  # 1 lower case, 2 upper case, 3 digit, 4 sentence mark, 5 other mark, 6 white space, 7 non-ASCII
_CLASS[list(range(97, 123))], _CLASS[list(range(65, 91))], _CLASS[list(range(48, 58))] = 1, 2, 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5
_CLASS[list(b".,;:'\"?-()")] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
_CLASS[128:] = 7
_ALNUM = frozenset(c for c in range(128) if chr(c).isalnum())
_MARKS_TWICE = re.compile(rb"([!-/:-@\[-`{-~])\1+")


def features(text: str | None) -> list[float]:
    """Surface features of a whole text, all of them shares or logarithms; an empty text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    letters = max(int(counts[1] + counts[2] + counts[7]), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = Counter(words)
    stops = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    twice = len(_MARKS_TWICE.findall(raw))
    bare = sum(k for w, k in distinct.items() if not w.isalnum() and len(w) <= 2 and w.isascii() and not any(map(_ALNUM.__contains__, w)))
    return [
        np.log1p(n),
        size / n,
        sum(k for w, k in distinct.items() if w[:1].isupper()) / n,
        counts[2] / letters,
        counts[3] / size,
        sum(k for w, k in distinct.items() if w[-1] < 128 and _CLASS[w[-1]] == 5) / n,
        counts[4] / size,
        counts[5] / size,
        twice / n,
        len(distinct) / n ** 0.9,
        sum(map(eq, words, islice(words, 1, None))) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / (stops + 1)),
        max(distinct.values()) / n,
        bare / n,
        sum(k for w, k in distinct.items() if len(w) > 2 and w.isupper()) / n,
    ]


#: Shares of the rows at which features are cut into bins.
TAILS = (0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7, 0.85, 0.92, 0.96, 0.98, 0.99)


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))


class Model:
    """Bins of each feature and an additive weight for each bin."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Column of each feature's bin in the weight vector."""
        base, out = 0, np.zeros(x.shape, np.int64)
        for k, e in enumerate(self.edges):
            out[:, k] = base + np.searchsorted(e, x[:, k], "right")
            base += len(e) + 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.cells(x)].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """The largest share of ``unlabelled`` that can be positives: over high-score tails that hold at least a share
    ``least`` of the positives, the smallest ratio of the tail's shares, with one standard error of slack."""
    cut = np.quantile(positive, np.linspace(0, 1 - least, 46))
    tp, tu = (positive[None, :] >= cut[:, None]).mean(1), (unlabelled[None, :] >= cut[:, None]).mean(1)
    slack = np.sqrt(tu * (1 - tu) / len(unlabelled) + 1e-12) + np.sqrt(tp * (1 - tp) / len(positive))
    return float(np.clip(((tu + slack) / tp).min(), 0.02, 0.98))


def _descend(p: np.ndarray, u: np.ndarray, width: int, risk, rounds: int, rate: float, ridge: float) -> tuple[np.ndarray, float]:
    """Adam on additive weights; ``risk(zp, zu)`` gives the slopes of the risk by the scores."""
    w = np.zeros(width + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        gp, gu = risk(w[p].sum(1) + w[-1], w[u].sum(1) + w[-1])
        g = ridge * w
        g[:-1] += np.bincount(p.ravel(), np.repeat(gp, p.shape[1]), width) + np.bincount(u.ravel(), np.repeat(gu, u.shape[1]), width)
        g[-1] = gp.sum() + gu.sum()
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 300, rate: float = 0.05, ridge: float = 3e-4) -> Model:
    """Fit from feature rows of trusted positives and of unlabelled texts. With no positives every score is 0.5."""
    both = np.concatenate([positive, unlabelled])
    if not len(positive) or not len(unlabelled):
        return Model([np.empty(0)] * len(FEATURES), np.zeros(len(FEATURES)), 0.0, 0.5)
    # bad text is rare and extreme: bins are finest in the tails, and the least value has its own
    edges = [np.unique([np.nextafter(both[:, k].min(), np.inf), *np.quantile(both[:, k], TAILS)]) for k in range(both.shape[1])]
    m = Model(edges, np.zeros(sum(len(e) + 1 for e in edges)), 0.0, 0.5)
    p, u, width = m.cells(positive), m.cells(unlabelled), len(m.weights)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def apart(zp, zu):  # telling positives from unlabelled, for the prior
        return (sigmoid(zp) - 1) / (2 * len(zp)), sigmoid(zu) / (2 * len(zu))

    m.weights, m.bias = _descend(p, u, width, apart, rounds, rate, ridge)
    m.prior = prior = estimate_prior(m.score(positive), m.score(unlabelled))

    def non_negative(zp, zu):  # slopes of the logistic losses
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp = prior * (sigmoid(zp) - 1) / len(zp)
        if as_negative < 0:  # the estimated risk of the negatives can't be below zero: undo what drives it there
            return prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)
        return gp - prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)

    m.weights, m.bias = _descend(p, u, width, non_negative, rounds, rate, ridge)
    return m


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` positives and as many unlabelled rows, neither held out, both taken in the order of
    a hash of the id. Conflicting labels of a document count as not positive."""
    key = F.xxhash64(F.lit("fit"), "doc_id")
    positive = labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").select("doc_id")
    ids = lambda df, kind: lowest(df, key, fit_rows).select("doc_id", F.lit(kind).alias("kind"))
    chosen = ids(positive, 1).unionByName(ids(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id"), 0))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("kind", "text")  # at most 2 * fit_rows ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"kind": b["kind"], "x": [features(t) for t in b["text"]]})

    got = rows.mapInPandas(run, "kind int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["kind"]))  # partitions come in any order
    x, kind = x[order], got["kind"].to_numpy()[order]
    return fit(x[kind == 1], x[kind == 0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every whole text, without a shuffle. Null counts as empty; repeated rows and null ids pass
    through; an empty table gives no rows; no other column is read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, as they are."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(_matrix(b.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = score(docs, train(docs, read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
