"""Work on pairs of points that are closer than a radius, without a table of pairs unless one is asked for.

Queries are dealt to partitions by median splits of a bounded sample (operators/tree.py). A point goes to the partitions whose queries it can
reach, which are its own and, near a border, those beyond. A partition's queries and points meet in one task; where there are many of either,
in blocks of both, so a crowded place makes more groups and no larger ones. Within a group points are sorted by columns of cells and, within
a column, along the longest axis; a query reads at most nine ranges of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.model import AXES
from tessera.operators.tree import MOST_PARTS, SAMPLE, Tree

#: Queries of a partition, queries and points of a group at most on average, candidates that are looked at together.
PART_ROWS, QUERY_ROWS, POINT_ROWS, AT_ONCE = 16_384, 32_768, 262_144, 1 << 16
#: Cells along the two short axes and steps along the long one, beyond which cells are merged; steps of a radius.
_CELLS, _STEPS, _FINE = (1 << 20) - 4, (1 << 22) - 2, 8


def near_pairs(q: np.ndarray, p: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, squared distance) of all pairs strictly within radius, as places in q and p, in pieces of bounded size."""
    if not len(q) or not len(p):
        return
    low, high = np.minimum(q.min(0), p.min(0)), np.maximum(q.max(0), p.max(0))
    long = int(np.argmax(high - low))
    one, two = (a for a in range(3) if a != long)
    edge = radius * (1 + 1e-9)  # a rounded quotient must not put two points a cell too far apart
    cell = lambda v, a: np.minimum(np.floor((v[:, a] - low[a]) / edge), _CELLS).astype(np.int64) + 1
    step = lambda v: np.clip(np.floor((v - low[long]) * (_FINE / edge)), 0, _STEPS).astype(np.int64)
    key = lambda a, b, f: (((a << 20) | b) << 22) | f
    keys = key(cell(p, one), cell(p, two), step(p[:, long]))
    order = np.argsort(keys, kind="stable")
    keys, (px, py, pz) = keys[order], np.ascontiguousarray(p[order].T)
    a, b = cell(q, one), cell(q, two)
    turn = np.argsort(key(a, b, step(q[:, long])), kind="stable")
    for at in range(0, len(q), 1 << 13):
        some = turn[at : at + (1 << 13)]
        first, last = step(q[some, long] - edge), step(q[some, long] + edge)
        cells = [(a[some] + i, b[some] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        lo = np.concatenate([np.searchsorted(keys, key(i, j, first), "left") for i, j in cells])
        size = np.concatenate([np.searchsorted(keys, key(i, j, last), "right") for i, j in cells]) - lo
        who = np.tile(some, 9)[size > 0]
        lo, size = lo[size > 0], size[size > 0]
        ends = np.cumsum(size)
        s = 0
        while s < len(ends):
            begin = ends[s] - size[s]
            e = max(s + 1, int(np.searchsorted(ends, begin + AT_ONCE, "right")))
            i = np.repeat(who[s:e], size[s:e])
            j = np.arange(ends[e - 1] - begin) + np.repeat(lo[s:e] - (ends[s:e] - size[s:e] - begin), size[s:e])
            d = q[i, 0] - px[j]
            d2 = d * d
            d = q[i, 1] - py[j]
            d2 += d * d
            d = q[i, 2] - pz[j]
            d2 += d * d
            hit = np.flatnonzero(d2 < radius * radius)
            yield i[hit], order[j[hit]], d2[hit]
            s = e


def coordinates(t: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([t.column(a).to_numpy(zero_copy_only=False) for a in AXES], 1) if t.num_rows else np.zeros((0, 3))


def _plain(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with a place: others are near nothing."""
    rows = df.select(*[F.col(k).cast("long").alias(f"k{n}") for n, k in enumerate(keys)], *[F.col(a).cast("double").alias(a) for a in AXES])
    return rows.where(" and ".join(f"abs({a}) < double('infinity')" for a in AXES))


def _dealt(queries: DataFrame) -> Tree:
    """The tree of the partitions of stored queries, with the bounds of each."""
    n = queries.count()
    depth = min(int(math.log2(MOST_PARTS)), max(0, math.ceil(math.log2(max(1, n / PART_ROWS)))))
    some = queries if n <= SAMPLE else queries.where(F.pmod(F.xxhash64(*AXES, "k0"), F.lit(n)) < SAMPLE)
    tree = Tree(coordinates(some.select(*AXES).limit(2 * SAMPLE).toArrow()) if depth else np.zeros((0, 3)), depth)

    def bounds(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = coordinates(batch)
            part = tree.locate(q)
            by = np.argsort(part, kind="stable")
            own, first, size = np.unique(part[by], return_index=True, return_counts=True)
            ends = [f.reduceat(q[by, a], first) for f in (np.minimum, np.maximum) for a in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *map(pa.array, ends), pa.array(size)], ["part", "l0", "l1", "l2", "h0", "h1", "h2", "n"])

    got = queries.mapInArrow(bounds, "part int, l0 double, l1 double, l2 double, h0 double, h1 double, h2 double, n long").groupBy("part")
    t = got.agg(*[F.min(f"l{a}").alias(f"l{a}") for a in range(3)], *[F.max(f"h{a}").alias(f"h{a}") for a in range(3)], F.sum("n").alias("n")).toArrow()  # at most MOST_PARTS rows
    column = lambda c: t.column(c).to_numpy()
    tree.bound(column("part").astype(np.int64), *(np.stack([column(f"{c}{a}") for a in range(3)], 1) for c in "lh"), column("n"))
    return tree


def near_work(queries: DataFrame, points: DataFrame, radius: float, work: Callable, schema: str, keys: tuple[str, ...] = ("id",)) -> tuple[DataFrame, bool]:
    """Rows that work makes of groups of near queries and points, and whether a query's points may be in more than one group.

    work: (queries, points, q, p) to record batches of the schema: tables of k0, k1, ... (the keys), x, y, z, and their places as arrays. Every
    query with a place is in a group, whether it has points or not; each pair within radius is in exactly one."""
    same = queries is points
    asked = stored(_plain(queries, keys))
    offered = asked if same else stored(_plain(points, keys))
    tree = _dealt(asked)
    leaves = 1 << tree.depth
    own = tree.count[leaves - 1 :]
    r2 = radius * radius

    def told(batches):
        total = np.zeros(leaves, np.int64)
        for batch in batches:
            p = coordinates(batch)
            total += np.bincount(tree.reach(p, np.full(len(p), r2))[1], minlength=leaves)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["part", "n"])

    met = np.zeros(leaves, np.int64)
    for part, n in offered.mapInArrow(told, "part int, n long").groupBy("part").agg(F.sum("n")).collect():  # at most MOST_PARTS rows
        met[part] = n
    blocks_q, blocks_p = np.maximum(1, -(-own // QUERY_ROWS)), np.maximum(1, -(-met // POINT_ROWS))

    def sent(side: bool, mine: np.ndarray, theirs: np.ndarray):
        """To partitions, there to one block of its own kind and all of the other."""

        def run(batches):
            for batch in batches:
                v = coordinates(batch)
                who, part = (np.arange(len(v)), tree.locate(v)) if side else tree.reach(v, np.full(len(v), r2))
                k = batch.column("k0").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                block = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)[who] % mine[part]
                times = theirs[part]
                other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                who, part, block = (np.repeat(c, times) for c in (who, part, block))
                two = (block, other) if side else (other, block)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(who)) for c in batch.columns), pa.array(part.astype(np.int32)), *(pa.array(c.astype(np.int32)) for c in two), pa.array(np.full(len(who), side))], [*batch.schema.names, "part", "bq", "bp", "asks"])

        return run

    kinds = ", ".join(f"k{n} long" for n in range(len(keys))) + ", x double, y double, z double, part int, bq int, bp int, asks boolean"
    both = asked.mapInArrow(sent(True, blocks_q, blocks_p), kinds).unionByName(offered.mapInArrow(sent(False, blocks_p, blocks_q), kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        asks = table.column("asks").to_numpy()
        q, p = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if q.num_rows:
            yield from work(q, p, coordinates(q), coordinates(p))

    return both.groupBy("part", "bq", "bp").applyInArrow(run, schema), bool(blocks_p.max() > 1)
