"""Operator 8, exact dedup: a log-structured merge index of text digests, with byte verification of its hits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, cut, read

LAST = (1 << 63) - 1  # the order key of a null id


class Run:
    """An immutable run: sorted distinct digests, their smallest order key and row count, and a one-probe filter."""

    def __init__(self, digest: np.ndarray, least: np.ndarray, n: np.ndarray):
        self.digest, self.least, self.n = digest, least, n
        self.mask = (1 << max(6, int(len(digest) * 8).bit_length())) - 1
        self.filter = bytearray((self.mask >> 3) + 1)
        for d in digest.tolist():
            p = hash(d) & self.mask
            self.filter[p >> 3] |= 1 << (p & 7)

    def find(self, d: bytes) -> int:
        """The digest's place, or -1; the filter spares most searches for digests that aren't here."""
        p = hash(d) & self.mask
        if not self.filter[p >> 3] >> (p & 7) & 1:
            return -1
        i = int(np.searchsorted(self.digest, np.bytes_(d)))
        return i if i < len(self.digest) and self.digest[i] == d else -1


class MergeIndex:
    """Digest -> (smallest order key, rows). Puts go to a memtable, or straight into the run that already has the
    digest; a full memtable is flushed as a sorted run; ``fanout`` runs of a level are compacted into one of the next."""

    def __init__(self, memtable_rows: int = 1 << 16, fanout: int = 4):
        self.memtable_rows, self.fanout = memtable_rows, fanout
        self.memtable: dict[bytes, list[int]] = {}
        self.levels: list[list[Run]] = [[]]

    def put(self, digest: bytes, key: int, n: int = 1) -> None:
        got = self.memtable.get(digest)
        if got is not None:
            got[0] = min(got[0], key)
            got[1] += n
            return
        for level in self.levels:
            for run in reversed(level):
                i = run.find(digest)
                if i >= 0:
                    run.least[i] = min(run.least[i], key)
                    run.n[i] += n
                    return
        self.memtable[digest] = [key, n]
        if len(self.memtable) >= self.memtable_rows:
            self.flush()

    def flush(self) -> None:
        if not self.memtable:
            return
        order = sorted(self.memtable)
        least, n = np.array([self.memtable[d] for d in order], np.int64).T
        self.memtable = {}
        self.levels[0].append(Run(np.array(order, "S"), least.copy(), n.copy()))
        k = 0
        while len(self.levels[k]) >= self.fanout:
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(compact(self.levels[k]))
            self.levels[k] = []
            k += 1

    def close(self) -> Run | None:
        """Flush and compact everything into one run."""
        self.flush()
        runs = [r for level in self.levels for r in level]
        return compact(runs) if runs else None


def compact(runs: list[Run]) -> Run:
    """Merge runs: of equal digests the smallest order key stays, and rows add up."""
    if len(runs) == 1:
        return runs[0]
    digest = np.concatenate([r.digest for r in runs])
    order = np.argsort(digest, kind="stable")
    digest, least, n = digest[order], np.concatenate([r.least for r in runs])[order], np.concatenate([r.n for r in runs])[order]
    first = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]])
    return Run(digest[first], np.minimum.reduceat(least, first), np.add.reduceat(n, first))


def _index(memtable_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = MergeIndex(memtable_rows)
        for b in batches:
            for d, k, n in zip(b["digest"].str.encode("ascii"), b["ord"].tolist(), b["n"].tolist()):
                index.put(d, k, n)
        got = index.close()
        for lo in range(0, len(got.digest) if got else 0, 1 << 14):
            s = slice(lo, lo + (1 << 14))
            yield pd.DataFrame({"digest": np.char.decode(got.digest[s], "ascii"), "ord": got.least[s], "n": got.n[s]})

    return run


def _digests(digits: int, bits=None):
    """Order key and digests of each row; with ``bits``, of the rows whose digest passes, and their normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py().encode("utf-8", "surrogatepass").lower() for t in b.column(1)]  # A-Z only
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            if bits is None:
                yield pa.record_batch([b.column(0), pa.array(sha, pa.string()), pa.array([s[:digits] for s in sha], pa.string())], names=["ord", "sha", "digest"])
                continue
            hashed = np.array([xxhash.xxh64_intdigest(s[:digits], 42) for s in sha], np.uint64)  # as Spark's xxhash64
            at = np.flatnonzero(bits.value.might_contain(hashed)).tolist()
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array([sha[i] for i in at], pa.string()), pa.array([sha[i][:digits] for i in at], pa.string()), pa.array([texts[i].decode("utf-8", "surrogatepass") for i in at], pa.string())], names=["ord", "sha", "digest", "text"])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_digits: int = 64, memtable_rows: int = 1 << 16) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256``. Texts are equal when identical
    after lower-casing A-Z; null counts as empty. Of equal texts the row with the smallest (or ``largest``) id stays.

    Every task indexes its own rows before anything moves, so a text with any number of copies leaves a task once.
    The compacted index says which digests occur more than once; only rows whose digest passes a filter of those
    (of bounded size) send their text on, and each is compared byte by byte with the text that stays. Texts that
    share a digest but differ (``digest_digits`` hex digits of SHA-256 are used) become groups of their own.

    Repeated ids with equal text all count in group_size and all are kept if the id is; a null id loses to any other,
    and rows of a group with null ids only are all kept. Empty tables give no rows; other columns are ignored."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    turn = (lambda c: F.bitwise_not(c)) if keep == "largest" else (lambda c: c)
    source = docs.select(F.coalesce(turn(F.col(id_col).cast("long")), F.lit(LAST)).alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = cut(source.mapInArrow(_digests(digest_digits), "ord long, sha string, digest string"))
    schema = "digest string, ord long, n long"
    runs = rows.select("digest", "ord", F.lit(1).cast("long").alias("n")).mapInPandas(_index(memtable_rows), schema)
    repeated = cut(runs.repartition("digest").mapInPandas(_index(memtable_rows), schema).where("n > 1"))
    bits = spark.sparkContext.broadcast(BitFilter.of(repeated.select(F.xxhash64("digest").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(bits.value.might_contain(h.to_numpy(np.int64)))

    single = F.lit(1).cast("long").alias("n")
    alone = rows.where(~maybe(F.xxhash64("digest"))).select("ord", F.col("ord").alias("keep"), single, "sha")
    passed = source.mapInArrow(_digests(digest_digits, bits), "ord long, sha string, digest string, text string")
    hits = repeated.select("digest", F.col("ord").alias("least"))
    # by digest and id, so that a large group is dealt over many tasks; left: what passed the filter by chance has no partner, stands alone, and needs no text
    stays = passed.join(hits.withColumnRenamed("least", "ord"), ["digest", "ord"]).groupBy("digest").agg(F.min("text").alias("stays"))
    met = cut(passed.join(stays, "digest", "left").select("ord", "sha", "digest", F.col("stays").isNull().alias("chance"), F.when(F.col("text") != F.col("stays"), F.col("text")).alias("other")))
    groups = met.where("not chance").groupBy("digest", "other").agg(F.min("ord").alias("keep"), F.count("*").alias("n"))
    g = groups.select(F.col("digest").alias("d"), F.col("other").alias("o"), "keep", "n")
    same = (F.col("digest") == F.col("d")) & F.col("other").eqNullSafe(F.col("o"))
    grouped = met.where("not chance").join(g, same).select("ord", "keep", "n", "sha")
    chance = met.where("chance").select("ord", F.col("ord").alias("keep"), single, "sha")
    back = lambda c: F.when(F.col(c) != LAST, turn(F.col(c))).cast(kind)
    return alone.unionByName(grouped).unionByName(chance).select(back("ord").alias("id"), back("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("ord") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("id", "doc_id")


OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
