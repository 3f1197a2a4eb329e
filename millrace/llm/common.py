"""Shared building blocks of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one is set only where none is (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: a lost executor costs a re-read, not the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def lowest(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows of the lowest key, a 64-bit hash of doc_id (ties by doc_id). Rows that surely are beyond leave out
    of the sort, so that what is sent to its end is about n rows, not n a partition."""
    total = df.count()
    if total > 4 * n:  # four times as many as wanted pass on average; if too few do, all are sorted
        near = df.where(key < F.lit(int(-(1 << 63) + (1 << 64) * 4 * n / total)))
        df = near if near.count() >= n else df
    return df.orderBy(key, "doc_id").limit(n)


def release(spark: SparkSession) -> None:
    """Let the driver forget plans that nothing refers to any more, so that the shuffle files of lineage that has been cut
    are deleted now and not at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def table(df: DataFrame) -> DataFrame:
    """Materialise as a Parquet table in the shared checkpoint folder: packed, and read by column."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the smallest node of its component, by chunks of edges."""

    def star(chunk: list[np.ndarray]) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(chunk, axis=1), return_inverse=True)
        f = Forest(len(nodes))
        for i, j in zip(*at.reshape(2, -1).tolist()):
            f.join(i, j)
        root = np.array([f.root(i) for i in range(len(nodes))], np.int64)
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])

    chunk, n = [], 0
    for b in batches:
        chunk.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
        n += b.num_rows
        if n >= 1 << 18:
            yield star(chunk)
            chunk, n = [], 0
    if n:
        yield star(chunk)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): one row (node, component) per node that has an edge to
    another node; component is the smallest node reachable. Null ends and self-loops are ignored.

    Every task first replaces the edges of a batch by a star for each of their components, which shortens paths. Then
    large-star and small-star contraction alternate: every round is two hash aggregations and two equi-joins with at
    most as many edges as before, and each round is checkpointed. Nothing is gathered on the driver but one count and
    one checksum a round."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    e = cut(e.mapInArrow(stars, "u long, v long").distinct())
    state = None
    while True:
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        state = new
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch as one row that has the bytes of each of its columns."""
    for b in batches:
        yield pa.record_batch([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], names=b.schema.names)


class BitFilter:
    """A Bloom filter of fixed size: two bits a key out of ``2**log2_bits``; false positives only cost work."""

    def __init__(self, words: np.ndarray, log2_bits: int):
        self.words, self.log2_bits = words, log2_bits

    @classmethod
    def of(cls, keys: DataFrame, column: str, least: int = 16, most: int = 26) -> "BitFilter":
        """Build from a long column. The bits are OR-ed by a hash aggregation; the driver gets at most
        ``2**most / 64`` words (8 MB) and their places, however many keys there are, as bytes and never as rows."""
        n = keys.count()
        log2_bits = int(np.clip(np.ceil(np.log2(max(n, 1) * 16)), least, most))
        mask = (1 << log2_bits) - 1
        bit = F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(mask)))).alias("p")
        got = keys.select(bit).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
        words = np.zeros(1 << (log2_bits - 6), np.uint64)
        for r in got.select(F.col("w").cast("int"), "m").mapInArrow(_packed, "w binary, m binary").collect():
            words[np.frombuffer(r["w"], np.int32)] = np.frombuffer(r["m"], np.uint64)
        return cls(words, log2_bits)

    def maybe(self, spark: SparkSession):
        """A function of a long column: whether the filter may contain it; false for null."""
        bits = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def maybe(h: pd.Series) -> pd.Series:
            known = h.notna().to_numpy()
            return pd.Series(bits.value.might_contain(h.fillna(0).to_numpy(np.int64)) & known)

        return maybe

    def might_contain(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64) if keys.dtype == np.int64 else keys
        out = np.ones(len(k), bool)
        for p in (k, k >> np.uint64(32)):
            p = p & np.uint64((1 << self.log2_bits) - 1)
            out &= ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << max(n - 1, 1).bit_length()
    if n not in _POWERS:
        if len(_POWERS) > 2:
            _POWERS.clear()
        with np.errstate(over="ignore"):
            up = np.full(n, _BASE, np.uint64)
            up[0] = 1
            down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            down[0] = 1
            _POWERS[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[n]


class SpanHash:
    """Polynomial hashes modulo 2**64 of any spans of a byte array, by prefix sums: one pass, then O(1) a span."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])


class Forest:
    """Union-find over 0..n-1 with path halving; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        if j < i:
            i, j = j, i
        self.up[j] = i
        return True
