"""Links between 64-bit fingerprints within a Hamming radius: pigeonhole buckets, bit-sliced comparison.

A fingerprint is cut into blocks; two fingerprints that differ in at most ``radius`` bits agree on at least
``blocks - radius`` whole blocks, so every such choice of blocks is a bucket key and no link is lost. Inside the
buckets the bits are stored vertically, one plane per bit position: one machine word of a plane holds that bit of 64
neighbours. For each shift d the planes are compared with themselves d rows on, the differing bits of 64 pairs at a
time are added into carry-save counters, and words in which every pair has exceeded the radius are abandoned.

A bucket with more than ``limit`` members is not compared as it stands: its rows come back and are dealt again by
``radius + 1`` parts of the bits they do not yet share, of which a linked pair must agree on one. Distinct
fingerprints that share all but b bits number at most 2**b, so this ends, and nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, cut

CHUNK = 1 << 16
Pairs = Iterator[tuple[np.ndarray, np.ndarray]]
Emit = Callable[[pd.DataFrame, Pairs], tuple[np.ndarray, np.ndarray]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(part, blocks - radius)]


def finer(mask: int, radius: int) -> list[int]:
    """The mask joined with each of ``radius + 1`` parts of the bits outside it."""
    rest = [i for i in range(64) if not mask >> i & 1]
    n = radius + 1
    return [mask | sum(1 << i for i in rest[len(rest) * k // n : len(rest) * (k + 1) // n]) for k in range(n)]


def _deal(choices: list[int]) -> Column:
    return F.array(*[F.struct(F.xxhash64(F.lit(_signed(m)), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key"), F.lit(_signed(m)).alias("mask")) for m in choices])


def pairs_within(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal key whose fingerprints differ in at most ``radius`` bits, shift by shift (j - i =
    1, 2, ...), so that no more than a row's worth of pairs is held; ``keys`` is sorted."""
    n = len(fps)
    if n < 2:
        return
    run = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    longest = int(np.diff(run).max())
    words = (n + 63) // 64 + 1
    # bit planes: row b holds bit b of every fingerprint, 64 fingerprints a word
    bits = np.unpackbits(fps.astype(np.uint64).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, words * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    width = radius.bit_length() + (radius & (radius + 1) > 0)  # counters hold 0 .. 2**width - 1
    width = max(width, 1)
    for d in range(1, longest):
        valid = np.zeros(words * 8, np.uint8)
        same = np.packbits(keys[:-d] == keys[d:], bitorder="little")
        valid[: len(same)] = same
        valid = valid.view(np.uint64)
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        q, r = divmod(d, 64)
        counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
        over = ~valid[at]
        for b in range(64):
            p = planes[b]
            far = p[np.minimum(at + q, words - 1)]
            if r:
                far = (far >> np.uint64(r)) | (p[np.minimum(at + q + 1, words - 1)] << np.uint64(64 - r))
            carry = p[at] ^ far
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:  # abandon words in which all pairs have exceeded the radius
                beyond = over | exceeds(counters, radius)
                live = beyond != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not live.all():
                    at, over, counters = at[live], over[live], [c[live] for c in counters]
                    if not len(at):
                        break
        if len(at):
            hit = ~(over | exceeds(counters, radius))
            lanes = np.unpackbits(hit.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
            w, lane = np.nonzero(lanes)
            i = at[w] * 64 + lane
            if len(i):
                yield i, i + d


def exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bitwise: the counter is over ``radius``."""
    gt, eq = np.zeros_like(counters[0]), np.full_like(counters[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            eq = eq & counters[k]
        else:
            gt = gt | (eq & counters[k])
            eq = eq & ~counters[k]
    return gt


def whole_groups(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame | None]]:
    """From batches sorted by key: frames of whole groups of at most ``limit`` rows, and the rows of larger ones."""
    rest, hot = None, None

    def split(df: pd.DataFrame):
        key = df["key"].to_numpy()
        size = df.groupby("key", sort=False)["key"].transform("size").to_numpy()
        big = size > limit if hot is None else (size > limit) | (key == hot)
        return df[~big], df[big]

    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["key"].iat[-1]
        open_ = pdf["key"].to_numpy() == last
        n_open = int(open_.sum())
        if n_open > limit or last == hot:  # a hot group streams through; it is never held
            out, large = split(pdf)
            hot, rest = last, None
            yield out, large
            continue
        if len(pdf) < CHUNK // 4:
            rest = pdf
            continue
        out, large = split(pdf[~open_])
        rest = pdf[open_]
        yield out, large
    if rest is not None and len(rest):
        yield split(rest)


def _comparer(radius: int, limit: int, emit: Emit):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for small, large in whole_groups(batches, limit):
            if len(small) > 1:
                small = small.reset_index(drop=True)
                for lo, hi in _chunks(small["key"].to_numpy()):
                    part = small.iloc[lo:hi]
                    a, b = emit(part, pairs_within(part["key"].to_numpy(), part["fp"].to_numpy(), radius))
                    if len(a):
                        yield pd.DataFrame({"a": a, "b": b, "fp": np.int64(0), "mask": np.int64(0), "again": False})
            if large is not None and len(large):
                yield pd.DataFrame({"a": large["id"].to_numpy(), "b": large["id"].to_numpy(), "fp": large["fp"].to_numpy(), "mask": large["mask"].to_numpy(), "again": True})

    return compare


def _chunks(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of about CHUNK rows that end with a group."""
    edge = np.r_[np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
    lo = 0
    while lo < len(keys):
        hi = int(edge[min(np.searchsorted(edge, lo + CHUNK), len(edge) - 1)])
        yield lo, hi
        lo = hi


def forest_edges(part: pd.DataFrame, pairs: Pairs, agree: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (those that ``agree``, if given): as connected as all of them, fewer than rows.
    A pair that is connected already is not looked at again."""
    ids, f, of, kept = part["id"].to_numpy(), Forest(len(part)), np.arange(len(part)), []
    for i, j in pairs:
        new = np.flatnonzero(of[i] != of[j])
        joined = [(x, y) for x, y in zip(i[new].tolist(), j[new].tolist()) if f.root(x) != f.root(y) and (agree is None or agree(x, y)) and f.join(x, y)]
        if joined:
            kept += joined
            of = np.array(f.up)
            while (of[of] != of).any():
                of = of[of]
    x, y = (np.array([k[s] for k in kept], np.int64) for s in (0, 1))
    return ids[x], ids[y]


def touched(part: pd.DataFrame, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Only which rows have a link."""
    hit = np.zeros(len(part), bool)
    for i, j in pairs:
        hit[i] = hit[j] = True
    ids = np.unique(part["id"].to_numpy()[hit])
    return ids, ids


def links(fps: DataFrame, radius: int, blocks: int, emit: Emit = forest_edges, limit: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` between the ids of ``fps(id, fp)``, whose fp are distinct, by the rule of ``emit``: with
    forest_edges, ids are connected by edges exactly if links within the radius connect them."""
    todo = fps.select("id", "fp", F.explode(_deal(masks(radius, blocks))).alias("k"))
    level, out = masks(radius, blocks), None
    while True:
        dealt = todo.select(F.col("k.key").alias("key"), "id", "fp", F.col("k.mask").alias("mask")).repartition("key").sortWithinPartitions("key")
        found = cut(dealt.mapInPandas(_comparer(radius, limit, emit), "a long, b long, fp long, mask long, again boolean"))
        edges = found.where("not again").select("a", "b")
        out = edges if out is None else out.unionByName(edges)
        large = found.where("again")
        if large.isEmpty():
            return out
        nxt = None
        for m in level:
            case = (F.col("mask") == F.lit(_signed(m)), _deal(finer(m, radius)))
            nxt = F.when(*case) if nxt is None else nxt.when(*case)
        todo = large.select(F.col("a").alias("id"), "fp", F.explode(nxt).alias("k"))
        level = sorted({x for m in level for x in finer(m, radius)})
