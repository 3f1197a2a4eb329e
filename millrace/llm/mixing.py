"""Operator 9 [native], mixing sources to target weights by soft membership.

A naive Bayes classifier, held as small tables counted from labelled documents, gives every document a posterior over
domains. Projected gradient descent then fits a nonnegative rate for every document so that the expected tokens of
each domain, sum of rate * tokens * posterior, meet the targets in the least-squares sense. All row work is DataFrame
expressions; the driver sees the class tables, one vector of domain totals a round, and nothing of a document's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lowest, read, table

#: Most labelled documents that the tables are counted from, and features of the classifier: the words that tell the
#: domains apart best, by chi-square over all words of those documents.
FIT_ROWS, FIT_WORDS = 20_000, 160
#: A word this many times likelier in one domain than in any other tells something by its absence too.
SPECIFIC = 3.0
#: What the query and the pipeline ask for: shares of the expected tokens; the total gives the first domain HEADROOM
#: times the tokens it has, so that documents surely of that domain have a rate of 1 or more and stay.
TARGETS, HEADROOM = {"clean": 0.975, "low": 0.005, "toxic": 0.02}, 1.1
MARK_EDGES, DISTINCT_EDGES, LENGTH_EDGES = (0.001, 0.05, 0.2, 0.5), (0.15, 0.3, 0.45, 0.6, 0.75, 0.9), (8, 32, 128, 512, 2048)
MARKS = ("!", "*", "%", "$", "&", "#", "|")


def _bin(x: Column, edges: tuple) -> Column:
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def _words(text: Column) -> Column:
    return F.split(F.trim(F.coalesce(text, F.lit(""))), "[ \\n\\t\\r]+")


def _odd(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.right(w, F.lit(1)).isin(*MARKS)))


def _surface(tokens: Column, odd: Column, distinct: Column) -> list[Column]:
    """Binned shares of words that end in an odd mark and of distinct words, and binned length."""
    n = F.greatest(tokens, F.lit(1))
    return [_bin(odd / n, MARK_EDGES), _bin(distinct / n, DISTINCT_EDGES), _bin(tokens, LENGTH_EDGES)]


def _tokens(words: Column) -> Column:
    return F.when((F.size(words) == 1) & (words[0] == ""), 0).otherwise(F.size(words)).cast("long")


def _total(keys: Column, table: Column) -> Column:
    return F.aggregate(keys, F.lit(0.0), lambda acc, key: acc + F.element_at(table, key))


@dataclass
class Tables:
    """Logarithms by domain: priors (with all specific words absent), what a word's presence adds, and shares of surface bins."""

    domains: list[str]
    base: np.ndarray
    words: dict[str, np.ndarray]
    bins: list[np.ndarray]

    def scores(self, known: Column, surface: list[Column]) -> Column:
        """Log P(domain, text) up to a constant, as an array. A word that is absent counts only if it is
        specific to a domain: common words that a text in another language lacks say nothing of its domain."""
        out = []
        for d in range(len(self.domains)):
            s = F.lit(float(self.base[d]))
            if self.words:
                s = s + _total(known, F.create_map(*[x for w, v in self.words.items() for x in (F.lit(w), F.lit(float(v[d])))]))
            for table, b in zip(self.bins, surface):
                s = s + F.element_at(F.array(*[F.lit(float(x)) for x in table[:, d]]), b + 1)
            out.append(s)
        return F.array(*out)


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], fit_rows: int = FIT_ROWS, fit_words: int = FIT_WORDS) -> Tables:
    """Count the tables from at most ``fit_rows`` rows of ``labelled(doc_id, domain)``, taken in the order of a hash of
    the id. With no labelled rows every posterior is flat."""
    k = len(domains)
    chosen = lowest(labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()), F.xxhash64(F.lit("mix"), "doc_id"), fit_rows)
    rows = docs.select("doc_id", _words(F.col("text")).alias("w")).join(F.broadcast(chosen), "doc_id").select("domain", "w")  # at most fit_rows ids
    rows = rows.select("domain", F.array_distinct("w").alias("w"), _tokens(F.col("w")).alias("n"), _odd(F.col("w")).alias("odd"))
    rows = cut(rows.select("domain", "w", *[c.alias(f"b{i}") for i, c in enumerate(_surface(F.col("n"), F.col("odd"), F.size("w")))]))
    per = [F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    n = np.array(rows.agg(*per).first(), float)
    counts = rows.select("domain", F.explode("w").alias("word")).where("word <> ''").groupBy("word").agg(*per)
    # words whose shares differ most between domains, by the chi-square statistic
    total = sum((F.col(f"n{i}") for i in range(k)), F.lit(0)) / float(max(n.sum(), 1))
    chi = sum(((F.col(f"n{i}") - total * float(n[i])) ** 2 / (total * float(n[i]) + 1.0) for i in range(k)), F.lit(0.0))
    top = counts.orderBy(chi.desc(), "word").limit(fit_words).collect()
    p = lambda c: (np.array(c, float) + 0.5) / (n + 1.0)
    words, base = {}, np.log((n + 1) / (n + 1).sum())
    for r in top:
        q = p(r[1:])
        own = q.max() > SPECIFIC * np.sort(q)[-2] if k > 1 else False
        base = base + (np.log(1 - q) if own else 0.0)
        words[r["word"]] = np.log(q) - (np.log(1 - q) if own else np.log(q.mean()))
    bins = []
    for i, edges in enumerate((MARK_EDGES, DISTINCT_EDGES, LENGTH_EDGES)):
        table = np.full((len(edges) + 1, k), 0.5)
        for r in rows.groupBy(f"b{i}").agg(*per).collect():
            table[r[0]] += r[1:]
        bins.append(np.log(table / table.sum(0)))
    return Tables(list(domains), base, words, bins)


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labels table: toxic, else low (quality 0), else clean; the worst of repeated labels."""
    worst = labels.groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    return worst.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "low").when(F.col("q") == 1, "clean").alias("domain"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def members(docs: DataFrame, tables: Tables) -> DataFrame:
    """``row`` (the columns of docs), ``tokens`` (white-space words) and ``p`` (the posteriors of the domains, summing to 1).
    The one-row generator keeps Catalyst from computing the expression anew wherever it is used."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    shares = lambda score: _let(F.transform(score, lambda x: F.exp(x - F.array_max(score))), lambda e: _let(total(e), lambda t: F.transform(e, lambda x: x / t)))
    vocabulary = F.array(*[F.lit(w) for w in tables.words]) if tables.words else F.array().cast("array<string>")

    def member(words: Column) -> Column:
        seen = F.struct(_tokens(words).alias("n"), _odd(words).alias("odd"), F.size(F.array_distinct(words)).alias("distinct"), F.array_intersect(words, vocabulary).alias("known"))
        score = lambda v: tables.scores(v.getField("known"), _surface(v.getField("n"), v.getField("odd"), v.getField("distinct")))
        return _let(seen, lambda v: F.struct(v.getField("n").alias("tokens"), _let(score(v), shares).alias("p")))

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return packed.select("row", F.explode(F.array(_let(_words(F.col("row").getField("text")), member))).alias("m")).select("row", "m.tokens", "m.p")


def rate(p: Column, steps: list[np.ndarray]) -> Column:
    """The rate of posterior ``p`` after the steps: from 1, down each step's slope, never below zero."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda q, g: sum((F.element_at(q, i + 1) * F.element_at(g, i + 1) for i in range(len(steps[0]))), F.lit(0.0))
    return _let(p, lambda q: F.aggregate(history, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(q, g))))


def fit_rates(rows: DataFrame, targets: list[float], headroom: float | None = None, rounds: int = 200, tolerance: float = 1e-4) -> tuple[list[np.ndarray], dict]:
    """Steps for ``rate`` that fit ``rows(tokens, p)`` to the target shares, and what was reached.

    Every round is one aggregation over all rows; the driver sees the totals of the domains. A step follows the
    projected gradient with the residuals weighted by the inverse Gram matrix of the rows with a rate, under which its
    Lipschitz constant is 1. Rounds end when all totals are within ``tolerance`` of the targets' sum, or when five
    rounds have brought nothing, which is the least-squares fit of targets that can't be met; ``converged`` tells which.
    If ``rounds`` are used up before either, it raises. Rows without tokens, or an empty table, keep the rate 1. The
    total is that of the rows, or gives the first domain ``headroom`` times the tokens it has."""
    k = len(targets)
    share = np.array(targets) / sum(targets)
    kept = table(rows.select(F.col("tokens").cast("double").alias("t"), "p").where("t > 0"))
    at = lambda i: F.element_at("p", i + 1)

    def state(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the Gram matrix of the rows whose rate isn't zero."""
        rated = kept.select("t", "p", F.explode(F.array(rate(F.col("p"), steps))).alias("r"))
        sums = [F.sum(F.col("t") * F.col("r") * at(i)) for i in range(k)]
        got = rated.agg(*sums, *[F.sum(F.when(F.col("r") > 0, F.col("t") * at(i) * at(j)).otherwise(0.0)) for i in range(k) for j in range(k)]).first()
        got = np.array([x or 0.0 for x in got])
        return got[:k], got[k:].reshape(k, k)

    now, gram = state([])
    want = share * (headroom * now[0] / share[0] if headroom and share[0] > 0 and now[0] > 0 else now.sum())
    steps, best, reached, least, since = [], [], now, np.inf, 0
    for _ in range(rounds if now.sum() > 0 else 0):
        miss = np.linalg.norm(now - want) / want.sum()
        since = 0 if miss < least * (1 - 1e-3) else since + 1
        if miss < least:
            best, reached, least = list(steps), now, miss
        if least <= tolerance or since >= 5:
            break
        steps.append(np.linalg.solve(gram + 1e-9 * np.trace(gram) * np.eye(k) + 1e-300 * np.eye(k), now - want))
        now, gram = state(steps)
    else:
        if now.sum() > 0:
            raise RuntimeError(f"rates not fitted in {rounds} rounds: {now} of {want}")
    return best, {"tokens": reached.tolist(), "targets": want.tolist(), "converged": bool(least <= tolerance)}


@dataclass
class Fit:
    """The classifier, the steps of the rates, and the totals that they reach."""

    tables: Tables
    steps: list[np.ndarray]
    reached: dict


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], headroom: float | None = None) -> Fit:
    tables = train(docs, labelled, list(targets))
    # only posteriors are kept for the fit; the texts are read again for the copies
    return Fit(tables, *fit_rates(members(docs, tables).select("tokens", "p"), list(targets.values()), headroom))


def mix(docs: DataFrame, fitted: Fit, seed: str = "mix") -> DataFrame:
    """``row`` (the columns of ``docs``, whatever their names), ``tokens`` and ``p`` (see members), ``rate`` and
    ``copies``, without a shuffle of the texts. A document is emitted ``copies`` times: the whole part of its rate, and
    once more with the chance of the rest, drawn from a hash of its id.

    Null and empty texts have no tokens and a posterior like any short text; rows with equal ids draw alike; a null id
    draws like any other; with no labels all posteriors are flat; an empty table gives no rows."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "row.doc_id"), F.lit(1 << 53)) / float(1 << 53)
    rated = members(docs, fitted.tables).select("row", "tokens", "p", F.explode(F.array(rate(F.col("p"), fitted.steps))).alias("rate"))
    return rated.select("*", F.floor(F.col("rate") + draw).cast("int").alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], headroom: float | None = None) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as many times as its copies say (see mix)."""
    got = mix(docs, fit(docs, labelled, targets, headroom)).where("copies > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, its tokens, posteriors by domain, rate and copies."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = mix(docs, fit(docs, domain_labels(read(spark, sf_dir, "labels")), TARGETS, HEADROOM))
    p = [F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return got.select("row.doc_id", "tokens", *p, "rate", "copies")
