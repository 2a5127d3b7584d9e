"""Decision trees of many bootstraps, grown together with exact splits.

Each row is kept once per feature, in the order of that feature and cut into packs. All trees grow by a level in two
passes over the packs, whatever their number: the first sums up each node per pack, the second tries every place between
two distinct values, with what lies in the packs before added. A tree of its own per bootstrap would take jobs, plans and
statistics in the driver for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgauge.functions.expr import hash60
from taintgauge.operators.draws import sliced_rank
from taintgauge.session import materialise

#: Slots that a task holds before it sorts them into packs.
HELD = 1 << 21
#: Sums per pack, tree and node that the driver gathers at once; beyond that, trees grow in groups.
CELLS = 1 << 20


@dataclass
class Trees:
    """A row per tree and a column per node, where node i has the children 2i + 1 and 2i + 2: the feature it splits by
    (-1: none), its cut (values up to it go left) and the class of its majority."""

    split: np.ndarray
    cut: np.ndarray
    vote: np.ndarray


def _blobs(values: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix of bytes."""
    rows, width = values.shape
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(values))])


def bootstraps(x: DataFrame, key: str, rounds: int, seed: int, block: int) -> DataFrame:
    """`x` with `w`, a byte per round: how often its bootstrap drew the row.

    Each round draws as many slots as there are rows; a slot takes the row of rank hash mod n. Slots are exchanged as
    sorted numbers per `block` ranks. (No row is drawn 256 times: up to 255 rows it can't be, beyond that never is.)
    """
    spark, n, span = x.sparkSession, x.count(), block * rounds
    ranked = sliced_rank(x, [], key, seed, "row", name="_rank")
    rows = ranked.select(*x.columns, F.floor((F.col("_rank") - 1) / block).cast("bigint").alias("pack"), ((F.col("_rank") - 1) % block).cast("int").alias("place"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    slots = spark.range(0, n, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).select("id", turns.alias("turn"))
    slots = slots.select((F.pmod(hash60(seed, F.col("turn").cast("string"), F.col("id").cast("string")), F.lit(max(n, 1))) * rounds + F.col("turn")).alias("code"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            of = codes // span
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            parts = np.split((codes - of * span).astype(np.uint32), starts[1:])
            return pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["pack", "codes"])

        held: list[np.ndarray] = []
        for b in batches:
            held.append(b.column(0).to_numpy())
            if sum(map(len, held)) >= HELD:
                yield packed()
                held = []
        if held:
            yield packed()

    names = x.columns

    def count(own: pa.Table, drawn: pa.Table) -> pa.Table:
        codes = [np.frombuffer(c, np.uint32) for c in drawn["codes"].to_pylist()]
        times = np.bincount(np.concatenate([np.zeros(0, np.uint32), *codes]), minlength=span).reshape(block, rounds).astype(np.uint8)
        return own.select(names).append_column("w", _blobs(times[own["place"].to_numpy()]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)
    return rows.groupBy("pack").cogroup(slots.mapInArrow(pack, "pack bigint, codes binary").groupBy("pack")).applyInArrow(count, f"{kinds}, w binary")


def packs(x: DataFrame, n: int, key: str, features: int, label: str, rounds: int, block: int) -> DataFrame:
    """Rows in the order of each feature x0, x1, ..., about `block` to a pack: `part` and `seq` are the order of packs, `keys` are
    with the first feature only. `w` holds the rows of a round side by side."""
    parts = max(1, min(-(-n // block), max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // (10 * block)))))

    def fold(feature: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def folded() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks()
                values = np.stack([t[f"x{i}"].to_numpy() for i in range(features)], axis=1)
                w = np.frombuffer(b"".join(t["w"].to_pylist()), np.uint8).reshape(len(t), rounds)
                keys = t[key].to_pylist() if feature == 0 else None
                row = [feature, part, seq, values.tobytes(), t[label].to_numpy().astype(np.uint8).tobytes(), np.ascontiguousarray(w.T).tobytes(), keys]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["feature", "part", "seq", "x", "y", "w", "keys"])

            part, seq, held = TaskContext.get().partitionId(), 0, []
            for b in batches:
                held.append(b)
                if sum(map(len, held)) >= block:
                    yield folded()
                    seq, held = seq + 1, []
            if sum(map(len, held)):
                yield folded()

        return run

    schema = "feature int, part int, seq int, x binary, y binary, w binary, keys array<string>"
    ordered = [x.repartitionByRange(parts, f"x{j}", key).sortWithinPartitions(f"x{j}").mapInArrow(fold(j), schema) for j in range(features)]
    return materialise(reduce(DataFrame.unionByName, ordered), "packs")


def _unpacked(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    """(place, values, labels, draws) per pack; draws: a row per round."""
    for b in batches:
        for i in range(b.num_rows):
            at, y = tuple(b.column(k)[i].as_py() for k in range(3)), np.frombuffer(b.column(4)[i].as_buffer(), np.uint8)
            yield at, np.frombuffer(b.column(3)[i].as_buffer()).reshape(len(y), features), y, np.frombuffer(b.column(5)[i].as_buffer(), np.uint8).reshape(-1, len(y))


def _children(node: np.ndarray, values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return 2 * node + 1 + ~(values <= cut[node])  # NaN goes right, as it is ordered last


def _inside(x: np.ndarray, w: np.ndarray, split: np.ndarray, cut: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, nodes): the rows drawn that have come to a level of a tree, and its node there, from 0."""
    rows = np.flatnonzero(w)
    node = np.zeros(len(rows), np.int64)
    for _ in range(level):
        f = split[node]
        if (on := f >= 0).all():
            node = _children(node, x[rows, f], cut)
        else:
            rows = rows[on]
            node = _children(node[on], x[rows, f[on]], cut)
    return rows, node - ((1 << level) - 1)


def _best(v: np.ndarray, node: np.ndarray, w: np.ndarray, p: np.ndarray, before: np.ndarray, after: np.ndarray, total: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """(nodes, gain, cut, left weight, left positives) of the best place in one pack, whose rows are in the order of v.

    before, total: weight and positives per node, before the pack and in all; after: the first value behind the pack.
    """
    order = np.argsort(node.astype(np.uint16), kind="stable")
    v, node, w, p = v[order], node[order], w[order], p[order]
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    sizes = np.diff(starts, append=len(node))
    lw, lp = (np.cumsum(c) for c in (w, p))
    lw, lp = (c - np.repeat(c[starts] - own[starts], sizes) + b[node] for c, own, b in ((lw, w, before[0]), (lp, p, before[1])))
    behind = np.append(v[1:], 0.0)
    behind[starts + sizes - 1] = after[node[starts]]
    rw, rp = total[0][node] - lw, total[1][node] - lp
    at = np.flatnonzero((lw >= leaf) & (rw >= leaf) & ~(behind <= v) & ~np.isnan(v))
    v, behind, node, lw, lp, rw, rp = (c[at] for c in (v, behind, node, lw, lp, rw, rp))
    # Gini: the larger the sum over both sides of (squared positives + squared negatives) / weight, the purer they are.
    gain = (lp * lp + (lw - lp) ** 2) / lw + (rp * rp + (rw - rp) ** 2) / rw
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    most = np.repeat(np.maximum.reduceat(gain, starts), np.diff(starts, append=len(node))) if len(at) else gain
    hits = np.flatnonzero(gain == most)
    hits = hits[np.flatnonzero(np.diff(node[hits], prepend=-1))]  # the lowest of equally good ones
    with np.errstate(invalid="ignore"):
        mid = v[hits] / 2 + behind[hits] / 2
        cut = np.where((mid >= v[hits]) & (mid < behind[hits]), mid, v[hits])
    return node[hits], gain[hits], cut, lw[hits], lp[hits]


def grow(table: DataFrame, features: int, turns: range, depth: int, leaf: int) -> Trees:
    """The trees of some rounds: at most `depth` splits deep, `leaf` draws at least in a leaf, repeated ones counted.

    The driver gathers a few numbers per pack, tree and node of one level.
    """
    m, nodes = len(turns), (1 << depth + 1) - 1
    trees = Trees(np.full((m, nodes), -1, np.int64), np.zeros((m, nodes)), np.zeros((m, nodes), bool))
    narrow, schema = table.drop("keys"), "feature int, part int, seq int, cells binary"
    total = np.zeros((2, m, 1))
    open_ = np.ones((m, 1), bool)

    def gathered(visit: Callable, level: int, of: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """(places of packs in order, `of` numbers per pack, tree and node)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, x, y, w in _unpacked(batches, features):
                cells = visit(at, x, y, w)
                yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in at], pa.array([cells.tobytes()], pa.binary())], names=["feature", "part", "seq", "cells"])

        rows = sorted(narrow.mapInArrow(run, schema).collect(), key=lambda r: (r["feature"], r["part"], r["seq"]))
        cells = np.stack([np.frombuffer(r["cells"]).reshape(of, m, 1 << level) for r in rows], axis=1) if rows else np.zeros((of, 0, m, 1 << level))
        return [(r["feature"], r["part"], r["seq"]) for r in rows], cells

    for level in range(depth):
        width, first = 1 << level, (1 << level) - 1
        split, cut, kept = trees.split, trees.cut, open_

        def sums(at, x, y, w, level=level, width=width, split=split, cut=cut):
            out = np.zeros((3, m, width))
            for i, t in enumerate(turns):
                rows, node = _inside(x, w[t], split[i], cut[i], level)
                own = w[t][rows].astype(float)
                out[0, i], out[1, i] = np.bincount(node, own, width), np.bincount(node, own * y[rows], width)
                out[2, i, node[::-1]] = x[rows[::-1], at[0]]  # the first of a node is set last
            return out

        places, (weight, positives, start) = gathered(sums, level, 3)
        own = np.array([p[0] for p in places], np.int64)
        if level == 0:
            total = np.stack([c[own == 0].sum(axis=0) for c in (weight, positives)])
            trees.vote[:, 0] = 2 * total[1, :, 0] > total[0, :, 0]
            kept = open_ = (total[0] >= 2 * leaf) & (total[1] > 0) & (total[1] < total[0])
            if not open_.any():
                break
        around = {}
        for f in range(features):
            at = np.flatnonzero(own == f)
            lw, lp = (np.cumsum(c[at], axis=0) - c[at] for c in (weight, positives))
            after = np.full((m, width), np.nan)
            for k in reversed(range(len(at))):
                around[places[at[k]]] = lw[k], lp[k], after
                after = np.where(weight[at[k]] > 0, start[at[k]], after)
        sent = narrow.sparkSession.sparkContext.broadcast(around)

        def best(at, x, y, w, level=level, width=width, split=split, cut=cut, kept=kept, total=total, sent=sent):
            out = np.zeros((4, m, width))
            out[0] = -1
            lw, lp, after = sent.value[at]
            for i, t in enumerate(turns):
                rows, node = _inside(x, w[t], split[i], cut[i], level)
                if not (on := kept[i][node]).all():
                    rows, node = rows[on], node[on]
                if len(rows):
                    own = w[t][rows].astype(float)
                    found = _best(x[rows, at[0]], node, own, own * y[rows], (lw[i], lp[i]), after[i], (total[0, i], total[1, i]), leaf)
                    out[:, i, found[0]] = found[1:]
            return out

        places, (gain, at_cut, lw, lp) = gathered(best, level, 4)
        sent.destroy()
        top = gain.argmax(axis=0)[None]  # the first feature and the lowest cut of equally good ones
        gain, at_cut, lw, lp = (np.take_along_axis(c, top, 0)[0] for c in (gain, at_cut, lw, lp))
        does = gain >= 0
        trees.split[:, first : first + width] = np.where(does, np.array([p[0] for p in places])[top[0]], -1)
        trees.cut[:, first : first + width] = at_cut
        total = np.stack([np.stack([left, whole - left], axis=2).reshape(m, 2 * width) for left, whole in ((lw, total[0]), (lp, total[1]))])
        total *= np.repeat(does, 2, axis=1)
        trees.vote[:, first + width : first + 3 * width] = 2 * total[1] > total[0]
        open_ = (total[0] >= 2 * leaf) & (total[1] > 0) & (total[1] < total[0])
        if not open_.any():
            break
    return trees


def grown(table: DataFrame, features: int, rounds: int, depth: int, leaf: int) -> Trees:
    """The trees of all rounds, as many at a time as CELLS allows."""
    each = max(1, CELLS // max(1, table.count() << depth - 1))
    parts = [grow(table, features, range(a, min(a + each, rounds)), depth, leaf) for a in range(0, rounds, each)]
    return Trees(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("split", "cut", "vote")))


def out_of_bag(table: DataFrame, features: int, trees: Trees, depth: int) -> DataFrame:
    """(k, right, seen): how many trees whose bootstrap left the record out there are, and how many of them are right."""
    split, cut, vote = trees.split, trees.cut, trees.vote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (_, x, y, w) in enumerate(_unpacked([b], features)):
                right, seen = np.zeros(len(y), np.int32), np.zeros(len(y), np.int32)
                for t in range(len(split)):
                    rows = np.flatnonzero(w[t] == 0)
                    node = np.zeros(len(rows), np.int64)
                    for _ in range(depth):
                        f = split[t][node]
                        if not (on := f >= 0).any():
                            break
                        node = np.where(on, _children(node, x[rows, np.maximum(f, 0)], cut[t]), node)
                    right[rows] += vote[t][node] == y[rows]
                    seen[rows] += 1
                yield pa.RecordBatch.from_arrays([b.column(6)[i].values, pa.array(right), pa.array(seen)], names=["k", "right", "seen"])

    return table.where("feature = 0").mapInArrow(run, "k string, right int, seen int")
