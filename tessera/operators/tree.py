"""A balanced tree over points: partitions by median splits, and exact k nearest neighbours that visit only the partitions they can reach.

The splits come from a sample of bounded size, the bounds of the partitions from all points. A partition's points meet its queries in one
task, which cuts both into small blocks, near in space, and goes down a tree over the points once a block. A query first searches its own
partition; its k-th distance then says which other partitions it must visit. Only those queries, few of all, move a second time, and only the
points within the boxes around their balls."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import stored
from tessera.model import AXES

#: Points of a partition, partitions at most (their bounds are broadcast), points of the sample, queries of one task.
PART_ROWS, MOST_PARTS, SAMPLE, QUERY_ROWS = 32_768, 65_536, 200_000, 65_536
#: Points of a leaf and queries of a block within a task (up to twice as many), distances that are computed at once, neighbours that are sorted at once.
LEAF_ROWS, BLOCK_ROWS, AT_ONCE, SORTED = 12, 16, 1 << 16, 1 << 20
#: Partitions of a task: of larger tasks, few for the cores, the last keep the others waiting.
TASK_PARTS = 8
#: Boxes around the balls that reach into a partition, by the number of the partition they come from.
SIDES = 8


class Tree:
    """A perfect binary tree. Node n has the children 2 n + 1 and 2 n + 2; a point goes right if its axis's value is not below the split."""

    def __init__(self, points: np.ndarray, depth: int):
        """Splits at the medians of points, each across the widest axis of what it splits."""
        self.depth, inner = depth, (1 << depth) - 1
        self.axis, self.split = np.zeros(inner, np.int8), np.zeros(inner)
        work = [np.arange(len(points))]
        for level in range(depth):
            below = []
            for k, own in enumerate(work):
                at, p = (1 << level) - 1 + k, points[own]
                if len(own):
                    a = int(np.argmax(p.max(0) - p.min(0)))
                    mid = float(np.partition(p[:, a], len(own) // 2)[len(own) // 2])
                    self.axis[at], self.split[at] = a, mid
                    right = p[:, a] >= mid
                    below += [own[~right], own[right]]
                else:
                    below += [own, own]
            work = below
        self.low = self.high = self.count = None

    def locate(self, p: np.ndarray) -> np.ndarray:
        """The leaf, from 0, of each point."""
        at, flat, row = np.zeros(len(p), np.int64), np.ascontiguousarray(p).ravel(), 3 * np.arange(len(p))
        for _ in range(self.depth):
            at = 2 * at + 1 + (flat[row + self.axis[at]] >= self.split[at])
        return at - ((1 << self.depth) - 1)

    def bound(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        """Bounds and numbers of points by leaf; those of inner nodes follow. A leaf without points is infinitely far."""
        inner = (1 << self.depth) - 1
        self.low, self.high, self.count = np.full((2 * inner + 1, 3), np.inf), np.full((2 * inner + 1, 3), -np.inf), np.zeros(2 * inner + 1, np.int64)
        self.low[inner + leaf], self.high[inner + leaf], self.count[inner + leaf] = low, high, count
        for level in reversed(range(self.depth)):
            n = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
            self.low[n], self.high[n] = np.minimum(self.low[2 * n + 1], self.low[2 * n + 2]), np.maximum(self.high[2 * n + 1], self.high[2 * n + 2])
            self.count[n] = self.count[2 * n + 1] + self.count[2 * n + 2]

    def reach(self, q: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves that a query's ball of squared radius r2, its surface included, meets."""
        who, at = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(self.depth + 1):
            gap = np.maximum(np.maximum(self.low[at] - q[who], q[who] - self.high[at]), 0)
            near = (gap * gap).sum(1) <= r2[who] * (1 + 1e-12)
            near &= self.count[at] > 0
            who, at = who[near], at[near]
            if level < self.depth:
                who, at = np.repeat(who, 2), np.stack([2 * at + 1, 2 * at + 2], 1).ravel()
        return who, at - ((1 << self.depth) - 1)

    def reach_of_blocks(self, q: np.ndarray, r2: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What reach gives, in pieces of bounded size, for queries in blocks that lie near each other: q[starts[i] : starts[i + 1]]."""
        inner, slack, size = (1 << self.depth) - 1, r2 * (1 + 1e-12), np.diff(starts)
        low, high, most = np.minimum.reduceat(q, starts[:-1]), np.maximum.reduceat(q, starts[:-1]), np.maximum.reduceat(slack, starts[:-1])
        block, at = np.arange(len(size)), np.zeros(len(size), np.int64)
        for level in range(self.depth + 1):
            gap = np.fmax(np.fmax(self.low[at] - high[block], low[block] - self.high[at]), 0)
            near = ((gap * gap).sum(1) <= most[block]) & (self.count[at] > 0)
            block, at = block[near], at[near]
            if level < self.depth:
                block, at = np.repeat(block, 2), np.stack([2 * at + 1, 2 * at + 2], 1).ravel()
        width = int(size.max())
        row = np.minimum(starts[:-1, None] + np.arange(width), starts[1:, None] - 1)
        there, axes = np.arange(width) < size[:, None], [np.ascontiguousarray(q[:, a])[row] for a in range(3)]
        slack = np.where(there, slack[row], -1.0)
        begin, most_pairs = 0, max(1, AT_ONCE // width)
        while begin < len(block):
            end = min(len(block), begin + most_pairs)
            b, to = block[begin:end], at[begin:end]
            far = np.zeros((len(b), width))
            for a in range(3):
                v = axes[a][b]
                gap = np.fmax(np.fmax(self.low[to, a][:, None] - v, v - self.high[to, a][:, None]), 0)
                far += gap * gap
            i, j = np.nonzero(far <= slack[b])
            yield row[b[i], j], to[i] - inner
            begin = end

    def enough(self, q: np.ndarray, leaf: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which each query surely has k points: to the far end of the smallest node around its leaf that holds as many."""
        at, out = leaf + (1 << self.depth) - 1, np.full(len(q), np.inf)
        for _ in range(self.depth + 1):
            open_ = np.isinf(out) & (self.count[at] >= k)
            far = np.maximum(np.abs(q[open_] - self.low[at[open_]]), np.abs(q[open_] - self.high[at[open_]]))
            out[open_] = (far * far).sum(1)
            at = np.maximum((at - 1) // 2, 0)
        return out


def even(points: np.ndarray, depth: int) -> tuple[np.ndarray, Tree]:
    """Splits into 2^depth leaves whose numbers of points differ by one at most: places in points by leaf, -1 at the end of the smaller ones; the tree."""
    tree = Tree(np.zeros((0, 3)), 0)
    tree.depth, tree.axis, tree.split = depth, np.zeros((1 << depth) - 1, np.int8), np.zeros((1 << depth) - 1)
    at, axes = np.arange(len(points)).reshape(1, -1), [np.ascontiguousarray(points[:, a]) for a in range(3)]
    for level in range(depth):
        here = slice((1 << level) - 1, (1 << (level + 1)) - 1)
        full = at[:, -1] >= 0
        some = np.where(at < 0, at[:, :1], at)
        v = [x[some] for x in axes]
        axis = np.argmax(np.stack([x.max(1) - x.min(1) for x in v], 1), 1)
        key = v[2].copy()
        for a in (0, 1):
            key[axis == a] = v[a][axis == a]
        key[~full, -1] = np.nan
        half, odd = divmod(at.shape[1], 2)
        by = np.argpartition(key, half if full.all() else (half, at.shape[1] - 1), 1)  # what is missing comes last
        at = np.take_along_axis(at, by, 1)
        tree.axis[here], tree.split[here] = axis, np.take_along_axis(key, by[:, half : half + 1], 1)[:, 0]
        left, right = at[:, : half + odd].copy(), at[:, half:].copy()
        if odd:  # the middle point of a full node goes left, that of others right
            left[~full, -1] = -1
            right[full, :-1], right[full, -1] = right[full, 1:], -1
        at = np.stack([left, right], 1).reshape(-1, half + odd)
    return at, tree


def blocks_of(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of queries in which blocks lie near each other, and where these start, with the end."""
    at, _ = even(q, max(0, int(math.log2(max(1, len(q)) / BLOCK_ROWS))))
    return at[at >= 0], np.r_[0, np.cumsum((at >= 0).sum(1))]


def search(points: np.ndarray, ids: np.ndarray, q: np.ndarray, starts: np.ndarray, k: int, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, squared distance) of the k nearest points of each query among those within r2, by query, then distance, then identifier.

    q lies in blocks (blocks_of). A query's own leaf says how far it must look at most."""
    order = np.lexsort((ids, *points.T[::-1]))
    order = order[np.r_[np.ones(min(k, len(order)), bool), (points[order[k:]] != points[order[:-k]]).any(1)]]  # the k smallest of a place
    points, ids = points[order], ids[order]
    at, tree = even(points, max(0, int(math.log2(len(points) / max(LEAF_ROWS, k)))) if len(points) > k else 0)
    there, width = at >= 0, at.shape[1]
    axes = [np.where(there, points[at, a], np.inf) for a in range(3)]
    low, high = np.stack([x.min(1) for x in axes], 1), np.stack([np.where(there, x, -np.inf).max(1) for x in axes], 1)
    tree.bound(np.arange(len(at)), low, high, there.sum(1))
    qs = [np.ascontiguousarray(q[:, a]) for a in range(3)]

    def squared(who: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        out = np.zeros((len(who), width))
        for v, p in zip(qs, axes):
            d = p[leaf]
            d -= v[who][:, None]
            d *= d
            out += d
        return out

    step = max(1, AT_ONCE // width)
    if len(points) > k:
        own = tree.locate(q)
        for s in range(0, len(q), step):
            some = np.arange(s, min(len(q), s + step))
            r2[some] = np.fmin(r2[some], np.partition(squared(some, own[some]), k - 1, 1)[:, k - 1])

    def kept(found: list[tuple], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, p, d = (np.concatenate(x) for x in zip(*found))
        who -= first
        by = np.argsort(d)
        by = by[np.argsort(who[by].astype(np.uint16 if last - first <= 65_536 else np.int64), kind="stable")]
        who, p, d = who[by], p[by], d[by]
        like = np.flatnonzero((d[1:] == d[:-1]) & (who[1:] == who[:-1]))
        if len(like):  # ties go by identifier
            tied = np.zeros(last - first, bool)
            tied[who[like]] = True
            mine = np.flatnonzero(tied[who])
            p[mine] = p[mine[np.lexsort((ids[p[mine]], d[mine], who[mine]))]]
        ends = np.cumsum(np.bincount(who, minlength=last - first))
        best = np.arange(len(who)) - np.r_[0, ends[:-1]][who] < k
        return who[best] + first, ids[p[best]], d[best]

    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    together = max(1, SORTED // (4 * (k + LEAF_ROWS) * int(np.diff(starts).max())))
    for s in range(0, len(starts) - 1, together):
        some = starts[s : s + together + 1]
        found = []
        for who, leaf in tree.reach_of_blocks(q[some[0] : some[-1]], r2[some[0] : some[-1]], some - some[0]):
            who = who + some[0]
            for c in range(0, len(who), step):
                w, to = who[c : c + step], leaf[c : c + step]
                d = squared(w, to)
                i, j = np.nonzero(d <= r2[w][:, None])
                p = at[to[i], j]
                d = d[i, j]
                if len(p) and p.min() < 0:
                    i, p, d = i[p >= 0], p[p >= 0], d[p >= 0]
                found.append((w[i], p, d))
        if found:
            out.append(kept(found, int(some[0]), int(some[-1])))
    return tuple(np.concatenate(x) for x in zip(*out))


def _xyz(batch, prefix: str = "") -> np.ndarray:
    return np.stack([batch.column(prefix + a).to_numpy(zero_copy_only=False) for a in AXES], 1) if batch.num_rows else np.zeros((0, 3))


def _plain(df: DataFrame) -> DataFrame:
    """Rows with a place: others are near nothing."""
    rows = df.select("id", *[F.col(a).cast("double").alias(a) for a in AXES])
    return rows.where(" and ".join(f"{a} is not null and not isnan({a})" for a in AXES))


def partition(points: DataFrame, part_rows: int | None = None, kept: bool = False) -> tuple[DataFrame, Tree]:
    """points (id, x, y, z, part) and the tree of the partitions with the bounds of each. Points of equal place share a partition.

    points are stored, unless they are kept already: they are read several times."""
    rows = points if kept else stored(points)
    n = rows.count()
    depth = min(int(math.log2(MOST_PARTS)), max(0, math.ceil(math.log2(max(1, n / (part_rows or PART_ROWS))))))
    some = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("id", *AXES), F.lit(n)) < SAMPLE)
    tree = Tree(_xyz(some.select(*AXES).limit(2 * SAMPLE).toArrow()) if depth else np.zeros((0, 3)), depth)
    placed = _placed(rows, tree)
    each = placed.groupBy("part").agg(*[f(a).alias(f"{n_}{a}") for n_, f in (("low", F.min), ("high", F.max)) for a in AXES], F.count(F.lit(1)).alias("n")).toArrow()  # at most MOST_PARTS rows
    take = lambda p: np.stack([each.column(p + a).to_numpy() for a in AXES], 1)
    tree.bound(each.column("part").to_numpy().astype(np.int64), take("low"), take("high"), each.column("n").to_numpy())
    return placed, tree


def _listed(values: np.ndarray, kind: str) -> F.Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast(f"array<{kind}>")


def _placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows and their part, as Tree.locate tells it: a column a level, each from the one before. It costs less than to store it or to ask Python."""
    rows = rows.withColumn("part", F.lit(0))
    for level in range(tree.depth):
        here, at = slice((1 << level) - 1, (2 << level) - 1), F.col("part")
        axis = tree.axis[here]
        if (axis == axis[0]).all():
            value = F.col(AXES[axis[0]])
        else:
            own = F.get(_listed(axis, "int"), at)
            value = F.when(own == 0, F.col("x")).when(own == 1, F.col("y")).otherwise(F.col("z"))
        rows = rows.withColumn("part", 2 * at + F.when(value >= F.get(_listed(tree.split[here], "double"), at), 1).otherwise(0))
    return rows


def _within(placed: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points in a box of their partition."""
    own = boxes.select(F.col("part").alias("_part"), *[n + a for n in ("low", "high") for a in AXES])
    inside = reduce(and_, (F.col(a).between(F.col("low" + a), F.col("high" + a)) for a in AXES), F.col("part") == F.col("_part"))
    return placed.join(F.broadcast(own), inside, "left_semi")  # at most MOST_PARTS * SIDES rows


def _met(queries: DataFrame, told: DataFrame, most: int, placed: DataFrame, tree: Tree, k: int, boxes: DataFrame | None = None) -> DataFrame:
    """queries (qid, x, y, z, part, r2) against the points of their partitions: (qid, rank, pid, d2). Without boxes, r2 is not given, and a query that
    other partitions can have neighbours of has no ranks yet, but one row more: the parts that it must visit (to), with place and r2.

    told (part, blocks): a partition that many queries meet has them in blocks, most at most, each with the partition's points; with boxes (part,
    bounds), only with those in one of its boxes."""
    few, boxed = F.broadcast(told), boxes is not None  # at most MOST_PARTS rows
    q, p, keys = queries, _within(placed, boxes) if boxed else placed, ["part"]
    if most > 1:
        q = q.join(few, "part").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int"))
        p = p.join(few, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["part", "block"]
    q, p = q.select("qid", *AXES, *(("r2",) if boxed else ()), *keys), p.select("id", *AXES, *keys)
    if not boxed:
        tasks = -(-(told.agg(F.sum("blocks")).first()[0] or 1) // TASK_PARTS)
        q, p = q.repartition(tasks, *keys), p.repartition(tasks, *keys)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, p = _xyz(left), _xyz(right)
        if not len(q):
            return result.empty_table()
        turn, starts = blocks_of(q)
        q = q[turn]
        r2 = np.full(len(q), np.inf) if not boxed else left.column("r2").to_numpy()[turn]
        who, pid, d = search(p, right.column("id").to_numpy(), q, starts, k, r2.copy()) if len(p) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ends, qid = np.searchsorted(who, np.arange(len(q) + 1)), left.column("qid").take(pa.array(turn)).combine_chunks()
        rank, on, rows = (np.arange(len(who)) - ends[who] + 1).astype(np.int32), np.zeros(len(q), bool), []
        if not boxed:
            part = left.column("part")[0].as_py()
            full = np.diff(ends) == k
            r2[full] = d[ends[1:][full] - 1]
            r2[~full] = tree.enough(q[~full], np.full(np.count_nonzero(~full), part), k)
            found = [(i[other], x[other]) for i, x in tree.reach_of_blocks(q, r2, starts) for other in (x != part,)]
            some, to = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 2
            by = np.argsort(some, kind="stable")
            going, first = np.unique(some[by], return_index=True)
            on[going] = True
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(some)].astype(np.int32)), pa.array(to[by], pa.int32()))
            rows = [("qid", qid.take(pa.array(going))), ("to", lists), *((a, pa.array(v)) for a, v in zip(AXES, q[going].T)), ("r2", pa.array(r2[going])), ("part", pa.array(np.full(len(going), part, np.int32)))]
        met = [("qid", qid.take(pa.array(who))), ("rank", pa.array(rank, mask=on[who])), ("pid", pa.array(pid)), ("d2", pa.array(d))]
        return pa.concat_tables([_table(dict(met), len(who), result), *([_table(dict(rows), len(rows[0][1]), result)] if rows else [])])

    result = pa.schema([("qid", pa.int64()), ("rank", pa.int32()), ("pid", pa.int64()), ("d2", pa.float64())])
    visits = "" if boxed else ", to array<int>, x double, y double, z double, r2 double, part int"
    if not boxed:
        result = pa.schema([*result, ("to", pa.list_(pa.int32())), *((a, pa.float64()) for a in (*AXES, "r2")), ("part", pa.int32())])
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(run, "qid long, rank int, pid long, d2 double" + visits)


def _table(columns: dict, n: int, schema: pa.Schema) -> pa.Table:
    """n rows; columns that are not given are missing."""
    return pa.Table.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def nearest(queries: DataFrame, points: DataFrame, k: int, part_rows: int | None = None, kept: bool = False, distinct: bool = False) -> DataFrame:
    """(qid, rank, pid, d2): the k nearest points of each query, ties by identifier; fewer where there are fewer points. Exact.

    Of points at one place the k smallest identifiers are enough, so a place that many points share stays small. Rows of queries that share
    an identifier are one query, with the k nearest of all. kept: both tables are stored and cheap to read again. distinct: no two queries share an
    identifier, which else is looked up."""
    placed, tree = partition(_plain(points), part_rows, kept)
    if tree.count[(1 << tree.depth) - 1 :].max(initial=0) > 4 * max(part_rows or PART_ROWS, int(tree.count[0]) >> tree.depth):
        rank = F.row_number().over(Window.partitionBy(*AXES).orderBy("id"))
        placed, tree = partition(placed.withColumn("rank", rank).where(F.col("rank") <= k).select("id", *AXES), part_rows)
    asked = _plain(queries).withColumnRenamed("id", "qid")
    asked = _placed(asked if kept else stored(asked), tree)
    blocks = F.ceil(F.sum("n") / QUERY_ROWS).cast("int").alias("blocks")
    told = stored(asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(blocks))
    first = stored(_met(asked, told, told.agg(F.max("blocks")).first()[0] or 1, placed, tree, k))
    visits = first.where("to is not null").select("qid", *AXES, "r2", F.pmod("part", F.lit(SIDES)).alias("side"), F.explode("to").alias("part"))
    pairs, done = first.where("to is null").select("qid", "rank", "pid", "d2"), F.col("rank").isNotNull()
    if not distinct:
        shared = stored(asked.groupBy("qid").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("qid"))
        if not shared.isEmpty():
            marked = shared.select(F.col("qid").alias("_qid"), F.lit(True).alias("_shared"))
            pairs, done = pairs.join(marked, F.col("qid").eqNullSafe(F.col("_qid")), "left"), done & F.col("_shared").isNull()
    again = pairs.where(~done).select("qid", "pid", "d2")
    radius = F.sqrt("r2") * (1 + 1e-9) + 1e-150
    box = [f(F.col(a) + sign * radius).alias(name + a) for name, f, sign in (("low", F.min, -1), ("high", F.max, 1)) for a in AXES]
    boxes = stored(visits.groupBy("part", "side").agg(*box, F.count(F.lit(1)).alias("n")))
    told = stored(boxes.groupBy("part").agg(blocks))
    most = told.agg(F.max("blocks")).first()[0]
    if most:
        again = again.unionByName(_met(visits, told, most, placed, tree, k, boxes).select("qid", "pid", "d2"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "pid"))), 1, k)
    merged = again.groupBy("qid").agg(best.alias("best")).select("qid", F.posexplode("best").alias("rank", "b"))
    return pairs.where(done).select("qid", "rank", "pid", "d2").unionByName(merged.select("qid", (F.col("rank") + 1).alias("rank"), F.col("b.pid").alias("pid"), F.col("b.d2").alias("d2")))
