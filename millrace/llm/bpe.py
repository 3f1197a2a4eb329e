"""Operator 3, byte-level BPE encoding and decoding with the ranks of a public vocabulary.

The merges of a piece are driven by a segment tree over its byte positions: a leaf holds the rank of the pair that
starts there, an inner node the smallest (rank, position) below it, so the root names the leftmost pair of least rank.
A merge changes three leaves (its own, its left live neighbour's, and the one it swallows) and their paths to the
root. Pieces of similar length are merged in step, one row of a matrix each; a long piece gets a tree of its own, so
a piece of n bytes costs O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

FAR = 1 << 24  # the rank of a pair that doesn't merge; ranks are smaller, and rank * LONG fits in 31 bits
LONG = 64  # bytes; longer pieces get a tree of their own
#: White space next to a single space is the one case in which the pattern looks past a space; see Encoder.encode.
AROUND_SPACE = re.compile(r"\s \s|\s \Z")


class Encoder:
    """``encode`` gives the ids of a text as little-endian uint32 bytes, ``decode`` the bytes of such ids."""

    def __init__(self, path: str, pattern: str, cache_rows: int = 500_000):
        self.path, self.pattern, self.cache_rows = path, pattern, cache_rows
        self.cache: dict[str, bytes] = {}

    def __reduce__(self):  # workers load the vocabulary themselves
        return Encoder, (self.path, self.pattern, self.cache_rows)

    @cached_property
    def split(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}

    @cached_property
    def tokens(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            out[i] = t
        return out

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """Every pair of tokens that joins to a token, and that token's rank, which is also its id."""
        r = self.ranks
        return {(r[t[:i]], r[t[i:]]): rank for t, rank in r.items() for i in range(1, len(t)) if t[:i] in r and t[i:] in r}

    @cached_property
    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs as an open-addressing table of keys and ranks."""
        size = 1 << (len(self.pairs) * 4).bit_length()
        keys, ranks = np.full(size, -1, np.int64), np.full(size, FAR, np.int32)
        a = np.array([(x << 32) | y for x, y in self.pairs], np.int64)
        v = np.fromiter(self.pairs.values(), np.int32, len(a))
        at = self._slot(a, size)
        while len(a):  # each round places the first comer of every free slot, and moves the others on
            free = keys[at] == -1
            first = np.unique(np.where(free, at, -1), return_index=True)
            i = first[1][first[0] >= 0]
            keys[at[i]], ranks[at[i]] = a[i], v[i]
            left = np.ones(len(a), bool)
            left[i] = False
            a, v, at = a[left], v[left], (at[left] + 1) & (size - 1)
        return keys, ranks

    @staticmethod
    def _slot(key: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (size - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self.pair_table
        size = len(keys)
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key, size)
        out, todo = np.full(len(key), FAR, np.int32), np.arange(len(key))
        while len(todo):
            got = keys[at]
            hit = got == key
            out[todo[hit]] = ranks[at[hit]]
            on = ~hit & (got != -1)
            todo, key, at = todo[on], key[on], (at[on] + 1) & (size - 1)
        return out

    def merge_in_step(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Ids of pieces of 2 to ``leaves`` bytes (a power of two)."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(leaves)[None, :] < size[:, None]
        ids = np.zeros((n, leaves), np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        live = inside.copy()
        after = np.tile(np.arange(1, leaves + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, leaves - 1, dtype=np.int32), (n, 1))
        none = (FAR + 1) * leaves
        tree = np.full((n, 2 * leaves), none, np.int32)  # (rank, position) as rank * leaves + position
        r, c = np.nonzero(inside[:, 1:])
        tree[r, leaves + c] = self.rank(ids[r, c], ids[r, c + 1]) * leaves + c
        width = leaves
        while width > 1:
            half = width // 2
            tree[:, half:width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width = half

        def put(rows: np.ndarray, at: np.ndarray, value) -> None:
            at = at + leaves
            tree[rows, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.flatnonzero(tree[:, 1] < FAR * leaves)
        while len(rows):
            top = tree[rows, 1]
            at, rank = top % leaves, top // leaves
            gone = after[rows, at]
            then = after[rows, gone]
            ids[rows, at] = rank
            live[rows, gone] = False
            after[rows, at] = then
            put(rows, gone, none)
            inner = then < size[rows]
            before[rows[inner], then[inner]] = at[inner]
            value = np.full(len(rows), none, np.int32)
            value[inner] = self.rank(rank[inner], ids[rows[inner], then[inner]]) * leaves + at[inner]
            put(rows, at, value)
            prior = before[rows, at]
            has = prior >= 0
            if has.any():
                x, p = rows[has], prior[has]
                put(x, p, self.rank(ids[x, p], rank[has]) * leaves + p)
            rows = rows[tree[rows, 1] < FAR * leaves]
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_alone(self, piece: bytes) -> bytes:
        """Ids of one piece of two bytes or more."""
        n, pairs, far = len(piece), self.pairs, int(FAR)
        leaves = 1 << (n - 1).bit_length()
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [far * leaves] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = pairs.get((ids[i], ids[i + 1]), far) * leaves + i
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, value: int) -> None:
            at += leaves
            tree[at] = value
            while at > 1:
                at >>= 1
                value = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == value:
                    return
                tree[at] = value

        while tree[1] < far * leaves:
            rank, at = divmod(tree[1], leaves)
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone] = rank, -1
            after[at] = then
            put(gone, far * leaves)
            if then < n:
                before[then] = at
                put(at, pairs.get((rank, ids[then]), far) * leaves + at)
            else:
                put(at, far * leaves)
            if (p := before[at]) >= 0:
                put(p, pairs.get((ids[p], rank), far) * leaves + p)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each distinct piece; a piece that is a token as a whole is that token."""
        out, short = {}, {}
        for p in pieces:
            b = p.encode("utf-8", "replace")
            if (whole := self.ranks.get(b)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(b) > LONG:
                out[p] = self.merge_alone(b)
            elif b:
                short.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for leaves, got in short.items():
            for lo in range(0, len(got), 1 << 13):
                some = got[lo : lo + (1 << 13)]
                out.update(zip((p for p, _ in some), self.merge_in_step([b for _, b in some], leaves)))
        return out

    def parts(self, word: str) -> list[str]:
        """The pattern's matches in a word; a word of letters, str.isalpha() being \\p{L}+, is one."""
        return [word] if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()) else self.split(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text. No match of the pattern but one of white space goes past a space that stands
        between other characters, so texts are cut at single spaces and equal words are encoded once; a text in
        which a space has white space on both sides, or ends the text after white space, is matched as a whole."""
        cut = []
        for t in texts:
            if AROUND_SPACE.search(t):
                cut.append(self.split(t))
            else:
                head, *rest = t.split(" ")
                cut.append([head, *[" " + w for w in rest]])
        if len(self.cache) > self.cache_rows:  # the older half goes
            for w in list(islice(self.cache, self.cache_rows // 2)):
                del self.cache[w]
        new = {w for c in cut for w in c}.difference(self.cache)
        parts = {w: self.parts(w) for w in new}
        made = self.pieces(list({p for c in parts.values() for p in c}))
        self.cache.update((w, b"".join([made[p] for p in c])) for w, c in parts.items())
        return [b"".join([self.cache[w] for w in c]) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_ENCODERS: dict[tuple, Encoder] = {}


def _coder(path: str, pattern: str, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.setdefault((path, pattern), Encoder(path, pattern))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):  # some MB of text at a time
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) < 2_000_000):
                    chars += len(texts[hi])
                    hi += 1
                ids = enc.encode(texts[lo:hi])
                key = b.column(0).slice(lo, hi - lo)
                if what == "ids":
                    out = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                else:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(enc.decode(x)) for x in ids], pa.string())]
                yield pa.record_batch([key, *out], names=["id", "ids"] if what == "ids" else ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                lo = hi

    return run


def vocabulary() -> tuple[str, str]:
    """Where the public multilingual vocabulary is installed, and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """``id, ids`` (array of int) of every whole text, or with ``digests`` ``id, n_tokens, ids_sha256,
    decoded_sha256``, where the ids have been decoded again. No shuffle. Special tokens are ordinary text. Null and
    empty texts have no ids; repeated rows and null ids pass through; an empty table gives no rows; other columns are
    ignored. ``path`` names a rank file that every executor can open."""
    known = vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"id {kind}, ids array<int>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_coder(path or known[0], pattern or known[1], "digests" if digests else "ids"), schema)


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id, bytes`` from ``id, ids``; null ids of a row give no bytes."""
    enc = Encoder(path or vocabulary()[0], vocabulary()[1])
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [enc.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), digests=True).withColumnRenamed("id", "doc_id")
