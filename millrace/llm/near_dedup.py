"""Operator 7, SimHash near-dedup: 64-bit SimHash of word shingles, bit-sliced comparison, connected groups; and the form
for a given Jaccard similarity, where no radius of 64 bits serves: the rarest shingles, which no link escapes, and exact
Jaccard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PACKED, linked, packed
from .common import BitFilter, SpanHash, components, cut, release, table
from .hamming import links
from .line_dedup import COUNTED, SLOTS, _slots, count_rows, slot_sums

SEED, AT_ONCE = 42, 1 << 15
SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, PER_BLOCK = 16, 3  # SimHash blocks that a test takes from a text to show that no link needs one
HELD = 1 << 25  # bytes of sets that a task holds besides its batch


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 bits fit in a byte
    out = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash, unsigned: a bit is 1 if set in over half of the XXH64 of the shingles, repeats included. A-Z are
    lower-cased, words end at ASCII white space; with fewer words than a shingle, the whole sequence is the one
    shingle; with none (null and empty texts too), 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, AT_ONCE):
        votes += _votes(np.array([digest(line[a:b], SEED) for a, b in zip(starts[lo : lo + AT_ONCE], stops[lo : lo + AT_ONCE])], np.uint64))
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["id", "fp"])

    return run


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp`` (the fingerprint, signed) and ``component`` (the smallest id whose
    fingerprint is reached over links of at most ``radius`` differing bits).

    Only distinct fingerprints are compared, so copies cost one row however many there are. Null and empty texts
    have fingerprint zero and link like any other; a null id takes part but never names a component unless the whole
    component has null ids; repeated rows stay repeated; an empty table gives no rows; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_fingerprints(shingle), f"id {kind}, fp long"))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(links(distinct.select(F.col("fp").alias("id"), "fp"), radius, radius + 2))
    # a class of one fingerprint has no edge and is its own root
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(named, "root").select("fp", "component")
    return rows.join(classes, "fp").select("id", "fp", "component")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, k = np.r_[0, ends[:-1]], max(len(words) - size + 1, 1)
    return np.unique(SpanHash(np.frombuffer(line, np.uint8))(starts[:k], ends[min(size, len(words)) - 1 :] - 1))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, words as in fingerprint; one shingle if there are fewer words, none without."""
    return _shingles(_words(text), size)


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sets of hashes, as bytes of ascending 64-bit numbers."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _node(s: np.ndarray) -> int:
    """The name of a set of shingles."""
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _shingle_counts(size: int):
    """In how many texts a task saw the shingles of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(1 << SLOTS, np.int64), 0
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                sets = [shingles(t.as_py(), size) for t in b.column(0).slice(lo, AT_ONCE)]
                counts += np.bincount(_slots(np.concatenate(sets)), minlength=1 << SLOTS)
                total += len(sets)
        yield count_rows("shingle", counts, total)

    return run


def rarest(s: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of an ascending set in the order of counts and hashes, so many that sets of at least this Jaccard
    similarity, which share that part of either's, have one in common: the first of all they share is among both's."""
    n = len(s)
    return s[np.argsort(counts[_slots(s)], kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def _named(size: int):
    """Id, row, node and number of shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingles(t.as_py(), size) for t in b.column(2))
            names = [(_node(s), len(s)) for s in sets]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([k for k, _ in names], pa.int64()), pa.array([n for _, n in names], pa.int64())], names=["id", "row", "node", "size"])

    return run


def _set_keys(size: int, similarity: float, counts, some):
    """Packed keys of the texts of rows that pass the filter: their rarest shingles, with the node; the empty set has no keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.flatnonzero(some.value.might_contain(b.column(0).to_numpy())).tolist()
            for lo in range(0, len(at), 256):
                sets = [shingles(b.column(1)[i].as_py(), size) for i in at[lo : lo + 256]]
                first = [rarest(s, counts.value, similarity) for s in sets]
                node = np.repeat(np.array([_node(s) for s in sets], np.int64), [len(k) for k in first])
                yield pa.record_batch([pa.array(np.concatenate(first).view(np.int64)), pa.array(node)], names=["key", "id"])

    return lambda batches: packed(keys(batches))


def _texts(some):
    """Row and compressed words of the texts of rows that pass the filter: a text takes a fraction of the bytes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0).to_numpy()
            at = np.flatnonzero(some.value.might_contain(row)) if len(row) else np.empty(0, np.int64)
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                yield pa.record_batch([pa.array(row[part]), pa.array([zlib.compress(b" ".join(_words(b.column(1)[i].as_py())), 1) for i in part.tolist()], pa.binary())], names=["row", "value"])

    return run


class Sets:
    """The sets of texts as _texts compresses them; those met last are held, up to HELD bytes."""

    def __init__(self, size: int):
        self.size, self.known, self.held = size, {}, 0

    def of(self, value: bytes) -> bytes:
        if value not in self.known:
            s = _shingles(zlib.decompress(value).split(), self.size).tobytes()
            self.held += len(s) + len(value)
            if self.held > HELD:
                self.known, self.held = {}, len(s) + len(value)
            self.known[value] = s
        return self.known[value]


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Keep, of each group, the rows of the smallest doc_id; rows with a null doc_id go only if their group has another id.

    Texts are linked if the Jaccard similarity of their sets of word shingles is at least ``similarity``. They meet if they
    share one of their rarest shingles, as counted in all rows, which leaves out no such pair. Texts without words, null
    ones too, are one group. Equal texts are one node however many there are; repeated rows of the id that stays all stay;
    an empty table gives no rows; other columns pass through.

    What is shuffled of a text is a key for a fifth of its shingles; its words follow only if a text of a near size has one of
    these keys too, or many texts have."""
    kind, spark = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    counts = spark.sparkContext.broadcast(slot_sums(source.select("text").mapInArrow(_shingle_counts(shingle), COUNTED), ["shingle"])[0]["shingle"].astype(np.uint32))
    rows = table(source.mapInArrow(_named(shingle), f"id {kind}, row long, node long, size long"))
    # one row a node gives its keys and its words
    nodes = table(rows.where("size > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size")))
    some = spark.sparkContext.broadcast(BitFilter.of(nodes, "row"))
    release(spark)

    def values(wanted: DataFrame) -> DataFrame:
        near = table(nodes.join(wanted.withColumnRenamed("id", "node"), "node", "left_semi"))
        few = spark.sparkContext.broadcast(BitFilter.of(near, "row"))
        texts = source.select("row", "text").mapInArrow(_texts(few), "row long, value binary")
        return table(texts.groupBy("row").agg(F.first("value").alias("value")).join(near, "row").select(F.col("node").alias("id"), "size", "value"))

    sets = Sets(shingle)
    keyed = source.select("row", "text").mapInArrow(_set_keys(shingle, similarity, counts, some), PACKED)
    groups = linked(keyed, values, similarity, [lambda a, b: jaccard(sets.of(a), sets.of(b)) >= similarity - 1e-12], sizes=nodes.select(F.col("node").alias("id"), "size"))
    rooted = rows.select("id", "node").join(groups, "node", "left").select("id", F.coalesce("component", "node").alias("root"))
    kept = table(rooted.groupBy("root").agg(F.min("id").alias("_kept")).select("_kept").distinct())
    release(spark)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    g = simhash_groups(read(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
