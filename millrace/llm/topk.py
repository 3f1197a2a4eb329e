"""Operator 2, exact top-k search: exhaustive term-at-a-time accumulation, partition selection and merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, table

NONE = np.iinfo(np.int64).min
QUERY_ROWS, CANDIDATE_ROWS = 256, 2048
#: Bytes of query vectors that one pass over the candidates broadcasts.
PASS_BYTES = 32 << 20


def weights(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each component as integers, one row per vector; shorter vectors end in zeros (no posting). A
    component that no long holds raises; scores, too, are taken to fit."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = np.asarray(vectors.value_lengths(), np.int64)
    whole = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    if (np.abs(whole) >= 2.0**63).any():
        raise ValueError(f"a component times {scale} is beyond a long")
    flat = whole.astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
    return out


def accumulate(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Dense scores of query rows against candidates: term by term, the rows that have the term scatter its weighted
    postings into their score arrays. A full postings list is added as a whole."""
    scores, term = np.zeros((len(q), len(w)), np.int64), np.empty((len(q), len(w)), np.int64)
    for j in range(min(q.shape[1], w.shape[1])):
        rows, posts = np.flatnonzero(q[:, j]), np.flatnonzero(w[:, j])
        if len(rows) * len(posts) > 0.5 * scores.size:
            np.multiply(q[:, j, None], w[None, :, j], out=term)
            scores += term
        elif len(rows) and len(posts):
            scores[np.ix_(rows, posts)] += q[rows, j, None] * w[None, posts, j]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row, best first; ``ids`` ascend, and the first of equals is the smallest."""
    top, who, row = [], [], np.arange(len(scores))
    for _ in range(min(k, len(ids))):
        at = scores.argmax(1)
        top.append(scores[row, at])
        who.append(ids[at])
        scores[row, at] = NONE
    return np.stack(top, 1), np.stack(who, 1)


def _partition(query_ids, queries, scale: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = query_ids.value, queries.value
        best, who = np.full((len(q), k), NONE), np.zeros((len(q), k), np.int64)
        for b in batches:
            ids = b.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, w = ids[order], weights(b.column(1), scale)[order]
            for c in range(0, len(ids), CANDIDATE_ROWS):
                some, wc = ids[c : c + CANDIDATE_ROWS], np.ascontiguousarray(w[c : c + CANDIDATE_ROWS])
                for r in range(0, len(q), QUERY_ROWS):
                    s = slice(r, r + QUERY_ROWS)
                    scores = accumulate(q[s], wc)
                    lo, hi = np.searchsorted(some, qid[s], "left"), np.searchsorted(some, qid[s], "right")
                    for i in np.flatnonzero(hi > lo):  # a row isn't its own candidate
                        scores[i, lo[i] : hi[i]] = NONE
                    t, i = select(scores, some, k)
                    t, i = np.concatenate([best[s], t], 1), np.concatenate([who[s], i], 1)
                    keep = np.lexsort((i, ~t), axis=1)[:, :k]
                    best[s], who[s] = np.take_along_axis(t, keep, 1), np.take_along_axis(i, keep, 1)
        row, col = np.nonzero(best != NONE)
        for lo in range(0, len(row), 1 << 16):
            r, c = row[lo : lo + (1 << 16)], col[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(r), pa.array(qid[r]), pa.array(who[r, c]), pa.array(best[r, c])], names=["row", "query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k candidates with the highest integer inner product, every
    row of ``vectors`` but those of the query's own id being candidates; ties go to the smaller id, fewer than k
    candidates give all. No pruning: each pass sends a block of at most ``pass_bytes`` of queries, which the driver
    holds one at a time, to every partition of candidates.

    Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part. Equal query
    rows count once; equal candidate rows count each. Vectors of unequal length agree on missing terms as on zeros.
    Empty tables give no rows; other columns are ignored."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~bad)

    asked = usable(queries).distinct()
    size = asked.agg(F.count("*"), F.sum(F.size("v") + 1)).first()
    passes = max(1, -(-8 * (size[1] or 0) // pass_bytes))
    out = None
    for p in range(passes):
        block = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(passes)) == p).toArrow()
        ids, q = block.column("id").to_numpy(), weights(block.column("v"), scale)
        order = np.argsort(ids, kind="stable")
        sent = [spark.sparkContext.broadcast(x) for x in (ids[order], q[order])]
        part = usable(vectors).mapInArrow(_partition(*sent, scale, k), "row long, query_id long, vec_id long, score long")
        ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        part = ranked.select("query_id", "rank", "vec_id", "score")
        if passes > 1:  # one block of queries is held at a time
            part = table(part)
            for b in sent:
                b.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return exact_top_k(e, e.where("vec_id % 50 = 0"), k=5)


OP2_SQL = """
WITH valid AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), terms AS (
  SELECT rid, vec_id, unnest(v) AS w, unnest(range(1, len(v) + 1)) AS j FROM valid
), queries AS (
  SELECT * FROM terms WHERE vec_id % 50 = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.rid, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM queries q JOIN terms c ON q.j = c.j AND q.vec_id <> c.vec_id GROUP BY ALL
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
