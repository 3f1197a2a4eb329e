"""Stable colours and ambiguous parts of graphs too large for joins: nodes are dealt over blocks, a block is one row of
packed arrays, and what nodes tell their neighbours travels as one array a pair of blocks.

Edges don't travel: both ends of the edges between two blocks keep them in one order, so a message is the values alone.
A node with one edge, to a node with more, is a leaf: its colour and part follow from that neighbour's, so leaves are
counted into the neighbour's first colour and stay out of the rounds.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import drop_table, release, table

ROWS, CHUNK = 1 << 19, 1 << 20  # rows of a block on average, and rows that a task packs at once
_SCHEMA = "part int, kind int, src int, data binary"
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAB5C4F9D1B)]
_LANES = (0, 1)  # a colour is two hashes of 64 bits that don't depend on each other


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coded(x: np.ndarray) -> tuple[str, int, bytes]:
    """Type, size and packed bytes of an array; the bytes of equal weight lie together."""
    x = np.ascontiguousarray(x)
    if x.dtype == np.int64 and len(x) and x.min() >= 0 and x.max() < 1 << 32:
        x = x.astype(np.min_scalar_type(int(x.max())))
    raw = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""
    return x.dtype.str, len(raw), pa.compress(raw, "zstd", asbytes=True) if raw else b""


class _Arrays:
    """Arrays by name, unpacked when they are asked for."""

    def __init__(self, data: pa.BinaryScalar | bytes):
        self.packed, self.known = pickle.loads(data if isinstance(data, bytes) else data.as_buffer()), {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            kind, size, raw = self.packed[name]
            raw = pa.decompress(raw, size, "zstd") if size else b""
            x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
            self.known[name] = x.astype(np.int64) if x.dtype.kind == "u" and x.dtype.itemsize < 8 else x
        return self.known[name]

    def put(self, **arrays: np.ndarray) -> bytes:
        """Packed, with these arrays in the place of those of their names."""
        return pickle.dumps(self.packed | {k: _coded(x) for k, x in arrays.items()}, 5)


def _dump(**arrays: np.ndarray) -> bytes:
    return pickle.dumps({k: _coded(x) for k, x in arrays.items()}, 5)


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs a, b, by a first, and whether each but the first equals the one before. Equal hashes a nearly
    always have equal b."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (y[1:][same] != y[:-1][same]).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = x[1:] == x[:-1]
    return order, same & (y[1:] == y[:-1])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((_mix(keys.view(np.uint64) ^ _K[3]) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["part", "kind", "src", "data"])


def _dealt(to: np.ndarray, kind: int, src: int, **arrays: np.ndarray) -> list[tuple]:
    """A row for every block of ``to``, with its share of the arrays, in their order."""
    to = to.astype(np.uint16 if len(to) and to.max() < 1 << 16 else np.int64)  # few bits sort quickly
    order = np.argsort(to, kind="stable")
    to = to.astype(np.int64)
    edge = np.flatnonzero(np.diff(to[order], prepend=-1))
    arrays = {k: x[order] for k, x in arrays.items()}
    return [(int(to[order[lo]]), kind, src, _dump(**{k: x[lo:hi] for k, x in arrays.items()})) for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(to)])]


def _joined(rows: list[_Arrays], *names: str) -> list[np.ndarray]:
    return [np.concatenate([r[n] for r in rows]) if rows else np.empty(0, np.int64) for n in names]


def _grouped(df: DataFrame, f: Callable[[int, dict[int, list[_Arrays]]], list[tuple]]) -> DataFrame:
    """``f`` of every block: its number and, by kind, its rows by source."""

    def run(t: pa.Table) -> pa.Table:
        part, got = t.column(0)[0].as_py(), {}
        for b in t.to_batches():
            for k, s, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                got.setdefault(k, []).append((s, x))
        return pa.Table.from_batches([_batch(f(part, {k: [_Arrays(x) for _, x in sorted(v, key=lambda r: r[0])] for k, v in got.items()}))])

    return df.groupBy("part").applyInArrow(run, _SCHEMA)


def _each(df: DataFrame, f: Callable[[int, _Arrays], list[tuple]]) -> DataFrame:
    """``f`` of every row of kind 0 by itself: its block and arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(3)):
                yield _batch(f(p, _Arrays(x)))

    return df.where("kind = 0").mapInArrow(run, _SCHEMA)


class _Kept:
    """The last state as a table; the one before is deleted when the next is written."""

    def __init__(self, df: DataFrame):
        self.df = table(df)

    def swap(self, df: DataFrame) -> None:
        old, self.df = self.df, table(df)
        drop_table(old)

    def drop(self) -> None:
        drop_table(self.df)


def _packed(parts: int):
    """Rows of ``rows`` (see ambiguous_parts) by block, packed."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, color, model, other, w = (t.column(i).combine_chunks() for i in range(5))
        edge = other.is_valid().to_numpy(zero_copy_only=False)
        col = lambda x: x.fill_null(0).to_numpy(zero_copy_only=False)
        node = col(node)
        return _batch(_dealt(_part(node, parts), 0, 0, node=node, color=col(color), model=col(model), other=col(other), w=col(w), edge=edge.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return run


def _codes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the place of each value among them."""
    at, values = pd.factorize(w, sort=True)
    return values, at


def _build(parts: int):
    """A block's nodes and distinct edges (by node, other end and weight), and word of its nodes of one edge to their
    neighbours' blocks."""

    def f(part: int, got: dict) -> list[tuple]:
        node, color, model, other, w, edge = _joined(got[0], "node", "color", "model", "other", "w", "edge")
        weights, w = _codes(w)
        order = np.lexsort((edge.astype(np.uint8), w.astype(np.min_scalar_type(len(weights))), other, node))
        node, color, model, other, w, edge = (x[order] for x in (node, color, model, other, w, edge))
        fresh = np.r_[True, node[1:] != node[:-1]]
        keys, color, model, own = node[fresh], color[fresh], model[fresh], np.cumsum(fresh) - 1
        new = (fresh | np.r_[True, (other[1:] != other[:-1]) | (w[1:] != w[:-1])] | np.r_[True, edge[1:] != edge[:-1]]) & (edge > 0)
        own, other, w = own[new], other[new], w[new]
        deg = np.bincount(own, minlength=len(keys))
        single = np.flatnonzero((deg[own] == 1) & (other != keys[own]))
        word = _dealt(_part(other[single], parts), 1, part, node=keys[own[single]], color=color[own[single]])
        return [(part, 0, part, _dump(keys=keys, color=color, model=model, deg=deg, other=other, weights=weights, w=w)), *word]

    return f


def _cored(parts: int):
    """Of blocks and the words for them: kind 0, the nodes that aren't leaves with the edges between them, and kind 1,
    their leaves."""

    def f(part: int, got: dict) -> list[tuple]:
        if 0 not in got:
            raise ValueError("edges must be given in both directions")
        x = got[0][0]
        keys, deg, other, w = x["keys"], x["deg"], x["other"], x["weights"][x["w"]]
        own = np.repeat(np.arange(len(keys)), deg)
        node, color = _joined(got.get(1, []), "node", "color")
        order = np.argsort(node)
        node, color = node[order], color[order]
        place = np.searchsorted(node, other)
        one = (np.append(node, 0)[place] == other) & (place < len(node)) & (other != keys[own])  # the other end has one edge
        leaf = np.zeros(len(keys), bool)
        leaf[own[(deg[own] == 1) & ~one & (other != keys[own])]] = True
        hung = one & (deg[own] > 1)
        core = np.flatnonzero(~leaf)
        number = np.cumsum(~leaf) - 1
        hang = np.flatnonzero(hung)
        lof, lkey, lcolor, lw = number[own[hang]], other[hang], color[place[hang]], w[hang]
        kind = _mix(_mix(lcolor.view(np.uint64) + _K[0]) ^ lw.view(np.uint64))
        c = {}
        for k in _LANES:
            sums = np.zeros(len(core), np.uint64)
            np.add.at(sums, lof, _mix(kind + _K[k]))
            c[f"c{k}"] = _mix(_mix(x["color"][core].view(np.uint64) + _K[k]) ^ _mix(sums))
        stay = np.flatnonzero(~hung & ~leaf[own])
        own, other, w = number[own[stay]], other[stay], w[stay]
        to = _part(other, parts)
        weights, at = _codes(w)
        back = np.lexsort((w, own, other, to))
        fixed = dict(keys=keys[core], model=x["model"][core], deg=np.bincount(own, minlength=len(core)), to=to, back=back, weights=weights, w=at)
        return [(part, 0, part, _dump(**fixed, **c)), (part, 1, part, _dump(lof=lof, lkey=lkey, lkind=kind))]

    return f


def _tell(*names: str):
    """Values of a block's nodes to the other ends of its edges."""

    def f(part: int, x: _Arrays) -> list[tuple]:
        own = np.repeat(np.arange(len(x["deg"])), x["deg"])
        return _dealt(x["to"], 2, part, **{k: x[k][own] for k in names})

    return f


def _heard(x: _Arrays, rows: list[_Arrays], *names: str) -> list[np.ndarray]:
    """For every edge of a block, the values that its other end told."""
    out = []
    for v in _joined(rows, *names):
        if len(v) != len(x["back"]):
            raise ValueError("edges must be given in both directions, with equal weights")
        got = np.empty_like(v)
        got[x["back"]] = v
        out.append(got)
    return out


def _round(part: int, got: dict) -> list[tuple]:
    x, new = got[0][0], {}
    w, own = _mix(x["weights"].view(np.uint64) + _K[2]), np.flatnonzero(x["deg"])
    start = (np.cumsum(x["deg"]) - x["deg"])[own]
    for k, near in zip(_LANES, _heard(x, got.get(2, []), "c0", "c1")):
        sums = np.zeros(len(x["deg"]), np.uint64)
        if len(own):
            sums[own] = np.add.reduceat(_mix(near.view(np.uint64) ^ _mix(w + _K[k])[x["w"]]), start)
        new[f"c{k}"] = _mix(_mix(x[f"c{k}"] + _K[2]) ^ _mix(sums + _K[k]))
    return [(part, 0, part, x.put(**new))]


def _distinct(parts: int):
    """A block's distinct colours to the blocks that count them."""

    def f(part: int, x: _Arrays) -> list[tuple]:
        order, same = _ordered(x["c0"], x["c1"])
        at = order[np.r_[True, ~same][: len(order)]]
        return _dealt(_part(x["c0"][at], parts), 3, part, c0=x["c0"][at], c1=x["c1"][at])

    return f


def _classes(part: int, got: dict) -> list[tuple]:
    c0, c1 = _joined(got[3], "c0", "c1")
    return [(part, len(c0) - int(_ordered(c0, c1)[1].sum()), part, b"")]


def _named(x: _Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Colours of a block's nodes, with their models."""
    m = x["model"].view(np.uint64)
    return _mix(x["c0"] ^ _mix(m + _K[0])), _mix(x["c1"] ^ _mix(m + _K[1]))


def _asked(parts: int):
    def f(part: int, x: _Arrays) -> list[tuple]:
        a, b = _named(x)
        return _dealt(_part(a, parts), 3, part, a=a, b=b, asker=np.full(len(a), part))

    return f


def _answered(part: int, got: dict) -> list[tuple]:
    """For each colour that was asked about, in the order of the question, whether it was asked about more than once."""
    a, b, asker = _joined(got[3], "a", "b", "asker")
    order, same = _ordered(a, b)
    many = np.zeros(len(a), np.int64)
    many[order] = np.r_[False, same] | np.r_[same, False]
    return _dealt(asker, 4, part, many=many)


def _marked(parts: int):
    def f(part: int, got: dict) -> list[tuple]:
        x = got[0][0]
        order = np.argsort(_part(_named(x)[0], parts), kind="stable")
        many = np.zeros(len(order), np.int64)
        many[order] = _joined(got.get(4, []), "many")[0]
        return [(part, 0, part, x.put(many=many))]

    return f


def _ends(parts: int):
    """Edges between nodes that share their colours, from the larger key to the smaller."""

    def f(part: int, got: dict) -> list[tuple]:
        x = got[0][0]
        own = np.repeat(np.arange(len(x["keys"])), x["deg"])
        u, (v, many) = x["keys"][own], _heard(x, got.get(2, []), "keys", "many")
        at = (many > 0) & (x["many"][own] > 0) & (u > v)
        return _to_both(part, parts, u[at], v[at])

    return f


def _to_both(part: int, parts: int, u: np.ndarray, v: np.ndarray) -> list[tuple]:
    return [*_dealt(_part(u, parts), 5, part, u=u, v=v), *_dealt(_part(v, parts), 5, part, u=v, v=u)]


def _sorted_edges(got: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct edges by u and v, the place of each one's u among the first edges of all u, and these."""
    u, v = _joined(got[5], "u", "v")
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
    u, v = u[new], v[new]
    fresh = np.r_[True, u[1:] != u[:-1]]
    return u, v, np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def _large_star(parts: int):
    """Of all neighbours of a node, the larger ones go to the least of them and itself."""

    def f(part: int, got: dict) -> list[tuple]:
        u, v, group, first = _sorted_edges(got)
        least = np.minimum(v[first], u[first])[group]
        at = v > u
        return _dealt(_part(v[at], parts), 5, part, u=v[at], v=least[at])

    return f


def _small_star(parts: int):
    """Of the smaller neighbours of a node, all and itself go to the least."""

    def f(part: int, got: dict) -> list[tuple]:
        u, v, group, first = _sorted_edges(got)
        least = v[first][group]
        at = v != least
        x, y = np.r_[v[at], u[first]], np.r_[least[at], v[first]]
        return [*_to_both(part, parts, x, y), (part, 6, part, _dump(n=np.array([len(x)]), h=_mix(_mix(x.view(np.uint64)) + y.view(np.uint64)).sum(keepdims=True)))]

    return f


def _connected(ends: DataFrame, parts: int) -> _Kept:
    """Edges from every node to the least of its component, both ways: large and small stars in turn, until nothing changes."""
    kept, before = _Kept(ends), None
    while True:
        kept.swap(_grouped(_grouped(kept.df.where("kind = 5"), _large_star(parts)), _small_star(parts)))
        release(ends.sparkSession)
        now = [_Arrays(bytes(r["data"])) for r in kept.df.where("kind = 6").select("data").collect()]
        state = (sum(int(x["n"][0]) for x in now), sum(int(x["h"][0]) for x in now) % (1 << 64))
        if state == before or not state[0]:
            return kept
        before = state


def _results(df: DataFrame) -> DataFrame:
    """``model, node, color, component`` of blocks with their leaves and stars."""
    schema = "model long, node long, color binary, component long"

    def run(t: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        for b in t.to_batches():
            for k, x in zip(b.column(1).to_pylist(), b.column(3)):
                got.setdefault(k, []).append(_Arrays(x))
        x, leaves = got[0][0], got[1][0]
        keys, many = x["keys"], x["many"] > 0
        u, v = _joined(got.get(5, []), "u", "v")
        u, v = u[v < u], v[v < u]
        component = keys.copy()
        component[np.searchsorted(keys, u)] = v
        lof, lkey, kind = leaves["lof"], leaves["lkey"], leaves["lkind"].view(np.uint64)
        order = np.lexsort((kind, lof))
        same = (lof[order][1:] == lof[order][:-1]) & (kind[order][1:] == kind[order][:-1])
        twin = np.zeros(len(lof), bool)
        twin[order] = (np.r_[False, same] | np.r_[same, False])[: len(lof)]
        at = np.flatnonzero(many[lof] | twin)
        lof, lkey, kind = lof[at], lkey[at], kind[at]
        own = np.flatnonzero(many)
        color = [np.r_[x[f"c{k}"][own], _mix(_mix(x[f"c{k}"][lof] + _K[3]) ^ _mix(kind + _K[k]))] for k in _LANES]
        color = np.stack(color, axis=1)
        flat = pa.Array.from_buffers(pa.binary(16), len(color), [None, pa.py_buffer(np.ascontiguousarray(color).tobytes())]).cast(pa.binary())
        return pa.table([np.r_[x["model"][own], x["model"][lof]], np.r_[keys[own], lkey], flat, np.r_[component[own], np.where(many[lof], component[lof], lkey)]], names=["model", "node", "color", "component"])

    return df.groupBy("part").applyInArrow(run, schema)


def ambiguous_parts(rows: DataFrame) -> DataFrame:
    """``model, node, color, component`` of the nodes that share their stable colour with another of their model, as
    lp.stable_colors and lp.ambiguous_components have them, but for the names of colours and components: a colour is 16
    bytes, and a component one of its nodes.

    ``rows(node, color, model, other, w)``, all longs: a node, its first colour (a hash), its model, and an edge of it to a
    node of its model with a hash of the weight, in both directions; ``other`` is null for a node alone. Rows may repeat. The
    driver sees one count a block and round. Tables in the shared folder are deleted when the next is written; those of
    the result (blocks, leaves, stars) stay."""
    rows = rows.select(*[F.col(c).cast("long") for c in ("node", "color", "model", "other", "w")]).where("node is not null")
    parts = max(-(-rows.count() // ROWS), 1)
    built = _grouped(rows.mapInArrow(_packed(parts), _SCHEMA), _build(parts))
    cored = _Kept(_grouped(built, _cored(parts)))
    del built
    release(rows.sparkSession)
    leaves, state, classes = table(cored.df.where("kind = 1")), _Kept(cored.df.where("kind = 0")), 0
    cored.drop()
    while True:
        n = sum(r["kind"] for r in _grouped(_each(state.df, _distinct(parts)), _classes).select("kind").collect())
        release(rows.sparkSession)  # the shuffles of what has been counted, or written below
        if n <= classes:
            break
        classes = n
        state.swap(_grouped(state.df.unionByName(_each(state.df, _tell("c0", "c1"))), _round))
        release(rows.sparkSession)
    answers = _grouped(_each(state.df, _asked(parts)), _answered)
    state.swap(_grouped(state.df.unionByName(answers), _marked(parts)))
    del answers
    release(rows.sparkSession)
    told = _each(state.df, _tell("keys", "many"))
    found = _connected(_grouped(state.df.unionByName(told), _ends(parts)), parts)
    return _results(state.df.unionByName(leaves).unionByName(found.df.where("kind = 5")))
