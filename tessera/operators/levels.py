"""Cuts of nodes that are too large for a task, from lists that are sorted once.

Trees on the same features share a group of lists: its unlike rows, once by each feature of many values, in pieces of LIST_ROWS rows that stand
as arrays. A node is a box of values, so nothing is written or dealt again from level to level: in a list its rows lie between two places, less those
that other features keep out. A level reads the lists twice, without a shuffle of rows: first each piece tells its class counts of each node,
which give the counts ahead of each piece; then each piece tells its best cut. Features of few values are told by counts of their values alone."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a feature that has no list of its own, rows of a piece, rows of a range, classes up to which blocks are bounded by all their corners.
FEW, LIST_ROWS, RANGE_ROWS, CORNERS = 256, 1 << 17, 500_000, 4
_LISTS = "grp int, f int, part int, seq int, n int, size int, label binary, w binary, x binary"


def impurity(counts: np.ndarray, kind: str) -> np.ndarray:
    """Of rows of class counts, times their number for Gini so that sides can be added."""
    n = counts.sum(axis=-1)
    if kind == "gini":
        squares = sum(counts[..., c].astype(float) ** 2 for c in range(counts.shape[-1]))
        return n - squares / np.maximum(n, 1)
    # Fixed values, from which the criterion follows: ln n! exact up to 8, the approximation of Stirling above.
    lf = lambda k: np.where(k > 8, k * np.log(np.maximum(k, 1)) - k + 0.5 * np.log(2 * np.pi * np.maximum(k, 1)), np.log(np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320]))[np.minimum(k, 8).astype(int)])
    return lf(n) - lf(counts).sum(axis=-1)


@dataclass
class Group:
    """Trees on the same features; values of those features that have few; features with a list, the first of which carries the rows."""

    trees: list[int]
    width: int
    few: dict[int, np.ndarray]
    listed: list[int]


@dataclass
class Node:
    """A node of a group's tree: low <= x < high in each feature, its class counts, its unlike rows."""

    grp: int
    tree: int
    place: int
    low: np.ndarray
    high: np.ndarray
    own: np.ndarray
    n: int


@dataclass
class Cut:
    """The best cut: sum of both sides, feature, rows to the left, threshold, class counts and unlike rows to the left."""

    total: float
    f: int
    k: int
    th: float
    left: np.ndarray
    n: int


def listed(base: DataFrame, grp: int, group: Group, classes: int, n: int) -> DataFrame:
    """The lists of a group, from its unlike rows base (label, x0, x1, ..., w0, w1, ..., the times that each tree takes a row)."""
    out = []
    for f in group.listed:

        def pack(batches, f=f):
            part, seq, kept = TaskContext.get().partitionId(), 0, []
            for batch in batches:
                kept.append(batch)
                while sum(b.num_rows for b in kept) >= LIST_ROWS:
                    rest = pa.Table.from_batches(kept)
                    yield _packed(rest.slice(0, LIST_ROWS), grp, group, classes, f, part, seq)
                    kept, seq = rest.slice(LIST_ROWS).to_batches(), seq + 1
            if sum(b.num_rows for b in kept):
                yield _packed(pa.Table.from_batches(kept), grp, group, classes, f, part, seq)

        ranges = max(2 * base.sparkSession.sparkContext.defaultParallelism, -(-n // RANGE_ROWS))
        out.append(base.repartitionByRange(ranges, f"x{f}").sortWithinPartitions(f"x{f}").mapInArrow(pack, _LISTS))
    return reduce(DataFrame.unionByName, out)


def _packed(t: pa.Table, grp: int, group: Group, classes: int, f: int, part: int, seq: int) -> pa.RecordBatch:
    column = lambda c: t.column(c).to_numpy()
    w = np.stack([column(f"w{k}") for k in range(len(group.trees))])
    kind = next(k for k in (np.uint8, np.uint32, np.int64) if w.max() <= np.iinfo(k).max)
    x = b"".join((np.searchsorted(group.few[k], column(f"x{k}")).astype(np.uint16) if k in group.few else column(f"x{k}").astype(np.float64)).tobytes() for k in range(group.width))
    label = column("label").astype(np.uint8 if classes <= 256 else np.uint32).tobytes()
    row = [grp, f, part, seq, t.num_rows, np.dtype(kind).itemsize, label, w.astype(kind).tobytes(), x]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for v in row], [c.split()[0] for c in _LISTS.split(", ")])


class _Piece:
    """Rows of a list, in its order."""

    def __init__(self, group: Group, f: int, label: np.ndarray, w: np.ndarray, x: list[np.ndarray], classes: int, at: tuple[int, int, int] = (0, 0, 0)):
        self.group, self.f, self.label, self.w, self.x, self.n = group, f, label, w, x, len(label)
        self.grp, self.part, self.seq = at
        self.is_class = [label == c for c in range(classes)]

    def taken(self, rows) -> _Piece:
        return _Piece(self.group, self.f, self.label[rows], self.w[:, rows], [x[rows] for x in self.x], len(self.is_class))

    def values(self, j: int, rows) -> np.ndarray:
        return self.group.few[j][self.x[j][rows]] if j in self.group.few else self.x[j][rows]

    def _bounds(self, j: int, node: Node) -> tuple:
        """What a feature's array is compared with; None where there is no bound."""
        ends = [None if np.isinf(v) else v for v in (node.low[j], node.high[j])]
        return tuple(v if v is None or j not in self.group.few else int(np.searchsorted(self.group.few[j], v)) for v in ends)

    def of(self, node: Node) -> tuple[int, np.ndarray]:
        """Where the node's rows begin, and how often its tree takes each row from there; 0 for those that are not the node's."""
        low, high = self._bounds(self.f, node)
        v = self.x[self.f]
        s, e = 0 if low is None else int(np.searchsorted(v, low)), self.n if high is None else int(np.searchsorted(v, high))
        w = self.w[self.group.trees.index(node.tree), s : max(s, e)]
        for j in range(self.group.width):
            low, high = self._bounds(j, node)
            if j == self.f or low is high is None or not len(w):
                continue
            x = self.x[j][s:e]
            if low is not None:
                w = w * ~(x < low)
            if high is not None:
                w = w * (x < high)
        return s, w


def _pieces(batches, groups: list[Group], classes: int) -> Iterator[_Piece]:
    for batch in batches:
        raw = lambda c, k, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)  # noqa: E731, B023
        for k in range(batch.num_rows):
            grp, f, part, seq, n, size = (batch.column(c)[k].as_py() for c in ("grp", "f", "part", "seq", "n", "size"))
            x, all_, begin = [], raw("x", k, np.uint8), 0
            for j in range(groups[grp].width):
                kind, bytes_ = (np.uint16, 2) if j in groups[grp].few else (np.float64, 8)
                x.append(all_[begin : begin + bytes_ * n].view(kind))
                begin += bytes_ * n
            w = raw("w", k, {1: np.uint8, 4: np.uint32, 8: np.int64}[size]).reshape(-1, n)
            yield _Piece(groups[grp], f, raw("label", k, np.uint8 if classes <= 256 else np.uint32), w, x, classes, (grp, part, seq))


def _by_group(nodes: list[Node]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for k, node in enumerate(nodes):
        out[node.grp].append(k)
    return out


def _table(piece: _Piece, j: int, some: slice, w: np.ndarray, classes: int) -> np.ndarray:
    """Class counts and unlike rows by value of a feature of few values."""
    v, code = piece.group.few[j], piece.x[j][some].astype(np.intp)
    got = np.bincount(code * classes + piece.label[some], w, len(v) * classes).reshape(-1, classes), np.bincount(code, w > 0, len(v))
    return np.column_stack(got).astype(np.int64)


def _of_table(values: np.ndarray, table: np.ndarray, j: int, own: np.ndarray, kind: str) -> Cut | None:
    values, run = values[table[:, -1] > 0], np.cumsum(table[table[:, -1] > 0], axis=0)[:-1]
    if not len(run):
        return None
    total = impurity(run[:, :-1], kind) + impurity(own - run[:, :-1], kind)
    at = int(np.argmin(total))
    return Cut(float(total[at]), j, int(run[at, :-1].sum()), float((values[at] + values[at + 1]) / 2), run[at, :-1], int(run[at, -1]))


def best_cuts(lists: DataFrame, groups: list[Group], nodes: list[Node], classes: int, kind: str) -> list[Cut | None]:
    """The best cut of each node, the first of equal ones by feature and place; None where none is better than no cut."""
    of_group = _by_group(nodes)

    def tell(batches):
        """Counts of each piece and node; at the end those by value of features without a list."""
        told, values = [], {}
        for piece in _pieces(batches, groups, classes):
            for k in of_group[piece.grp]:
                s, w = piece.of(nodes[k])
                there = np.flatnonzero(w)
                if not len(there):
                    continue
                some = slice(s, s + len(w))
                counts = [int((w * c[some]).sum(dtype=np.int64)) for c in piece.is_class]
                first, last = (float(piece.values(piece.f, s + i)) for i in (there[0], there[-1]))
                told.append((k, piece.f, piece.part, piece.seq, len(there), first, last, counts, None))
                if piece.f != piece.group.listed[0]:
                    continue
                for j, v in piece.group.few.items():
                    if j not in piece.group.listed:
                        values[k, j] = values.get((k, j), 0) + _table(piece, j, some, w, classes)
        told += [(k, j, -1, -1, 0, 0.0, 0.0, None, v.tobytes()) for (k, j), v in values.items()]
        names = ["node", "f", "part", "seq", "n", "first", "last", "counts", "table"]
        kinds = [pa.int32()] * 5 + [pa.float64()] * 2 + [pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in enumerate(kinds)], names)

    told = lists.mapInArrow(tell, "node int, f int, part int, seq int, n int, first double, last double, counts array<long>, table binary").collect()  # a row a piece and node
    best: dict[int, Cut] = {}
    whole = [float(impurity(node.own, kind)) for node in nodes]

    def offer(k: int, cut: Cut) -> None:
        if cut.total < whole[k] and (k not in best or (cut.total, cut.f, cut.k) < (best[k].total, best[k].f, best[k].k)):
            best[k] = cut

    tables, pieces = {}, defaultdict(list)
    for r in told:
        if r.table is not None:
            tables[r.node, r.f] = tables.get((r.node, r.f), 0) + np.frombuffer(r.table, np.int64).reshape(-1, classes + 1)
        else:
            pieces[r.node, r.f].append(r)
    for (k, j), table in tables.items():
        if cut := _of_table(groups[nodes[k].grp].few[j], table, j, nodes[k].own, kind):
            offer(k, cut)
    ahead: dict[tuple, list] = defaultdict(list)  # of a piece: node, counts and unlike rows ahead of it, the next value beyond it
    for (k, f), rows in pieces.items():
        rows.sort(key=lambda r: (r.part, r.seq))
        counts, n = np.cumsum([r.counts for r in rows], axis=0), np.cumsum([r.n for r in rows])
        for i, r in enumerate(rows):
            beyond = rows[i + 1].first if i + 1 < len(rows) else None
            ahead[nodes[k].grp, f, r.part, r.seq].append((k, counts[i] - np.array(r.counts), int(n[i] - r.n), beyond))
            if beyond is not None and beyond != r.last:
                total = float(impurity(counts[i], kind) + impurity(nodes[k].own - counts[i], kind))
                offer(k, Cut(total, f, int(counts[i].sum()), (r.last + beyond) / 2, counts[i], int(n[i])))
    known = [best[k].total if k in best else v for k, v in enumerate(whole)]
    shipped = lists.sparkSession.sparkContext.broadcast(dict(ahead))

    def cut(batches):
        out = []
        for piece in _pieces(batches, groups, classes):
            for k, before, n, beyond in shipped.value.get((piece.grp, piece.f, piece.part, piece.seq), ()):
                s, w = piece.of(nodes[k])
                got = _best_of(piece, s, w, before, beyond, nodes[k].own, kind, known[k])
                if got:
                    total, left, th, m = got
                    out.append((k, piece.f, total, th, left.tolist(), n + m))
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in out], kind) for k, kind in enumerate(kinds)], ["node", "f", "total", "th", "counts", "n"])

    for r in lists.mapInArrow(cut, "node int, f int, total double, th double, counts array<long>, n long").collect():  # at most a row a piece and node
        offer(r.node, Cut(r.total, r.f, sum(r.counts), r.th, np.array(r.counts), r.n))
    shipped.destroy()
    return [best.get(k) for k in range(len(nodes))]


def _least(starts: np.ndarray, ends: np.ndarray, own: np.ndarray, kind: str) -> np.ndarray:
    """A bound that no sum of both sides falls below while the class counts to the left grow from starts to ends. The main part is concave in the
    counts, so it is least in a corner; what the logarithms of factorials have besides grows with each count, so it is bounded by the ends."""

    def main(l):
        n = l.sum(-1)
        if kind == "gini":
            return n - (l * l).sum(-1) / np.maximum(n, 1)
        log = lambda v: v * np.log(np.maximum(v, 1))
        return log(n) - log(l).sum(-1)

    lows = []
    for corner in range(1 << len(own)):
        l = np.where((corner >> np.arange(len(own))) & 1 > 0, ends, starts)
        lows.append(main(l) + main(own - l))
    low = np.minimum.reduce(lows)
    if kind != "gini":
        low = low + _besides(starts.sum(-1)) - _besides(ends).sum(-1) + _besides((own - ends).sum(-1)) - _besides(own - starts).sum(-1)
    return low


def _besides(k: np.ndarray) -> np.ndarray:
    """ln k! as impurity() has it, less k ln k - k. It grows with k."""
    k = np.asarray(k, float)
    small = np.log(np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320])) - np.array([v * np.log(max(v, 1)) - v for v in range(9)])
    return np.where(k > 8, 0.5 * np.log(2 * np.pi * np.maximum(k, 1)), small[np.minimum(k, 8).astype(int)])


def _edges(n: int, ahead: int, behind: int) -> np.ndarray:
    """Where the blocks of n rows begin: of 64 to 4096 rows, about a quarter of the square root of what lies on the smaller side."""
    if n <= 256:
        return np.array([0])
    if ahead or behind:
        return np.arange(0, n, int(np.clip(np.sqrt(min(ahead, behind)) / 4, 64, 4096)))
    half = np.arange(0, min(n // 2, 1 << 16), 64)
    half = np.append(half, (np.arange(2048, max(2048, int(8 * np.sqrt(n // 2)))) ** 2) // 64)
    half = half[half < n // 2]
    return np.unique(np.r_[half, n // 2, n - half[half > 0]])


def _best_of(piece: _Piece, s: int, w: np.ndarray, before: np.ndarray, beyond: float | None, own: np.ndarray, kind: str, known: float) -> tuple | None:
    """(sum of both sides, counts to the left, threshold, unlike rows to the left in the piece) of the first best cut after a row of the piece that is not worse than known.

    Rows are summed in blocks of about a quarter of the square root of what lies on the smaller side; only blocks that may hold a better cut than is
    known are looked into."""
    here, classes = slice(s, s + len(w)), len(own)
    edges = _edges(len(w), int(before.sum()), int(own.sum() - before.sum() - w.sum(dtype=np.int64))) if classes <= CORNERS else np.array([0])
    per = np.stack([np.add.reduceat(w * c[here], edges, dtype=np.int64) for c in piece.is_class], 1)
    ends = before + np.cumsum(per, axis=0)
    stops, best = np.append(edges[1:], len(w)), None
    least = _least(ends - per, ends, own, kind) - 1e-9 * (1 + float(own.sum())) if len(edges) > 1 else np.array([-np.inf])

    def look(a: int, b: int) -> None:
        """Into blocks a to b - 1."""
        nonlocal best, known
        rows = np.flatnonzero(w[edges[a] : stops[b - 1]]) + edges[a]
        if not len(rows):
            return
        v = piece.values(piece.f, s + rows)
        follows, at = beyond, stops[b - 1]
        while at < len(w):
            if len(after := np.flatnonzero(w[at : at + 1024])):
                follows = piece.values(piece.f, s + at + after[0])
                break
            at += 1024
        at = np.flatnonzero(np.append(v[1:] != v[:-1], follows is not None and follows != v[-1]))
        if not len(at):
            return
        run = np.stack([np.cumsum(np.where(c[s + rows], w[rows], 0), dtype=np.int64)[at] for c in piece.is_class], 1) + (ends[a] - per[a])
        total = impurity(run, kind) + impurity(own - run, kind)
        i = int(np.argmin(total))
        if total[i] <= known and (best is None or (total[i], run[i].sum()) < (best[0], best[1].sum())):
            after_v = v[at[i] + 1] if at[i] + 1 < len(v) else follows
            best = (float(total[i]), run[i], float((v[at[i]] + after_v) / 2), int(np.count_nonzero(w[: rows[at[i]] + 1])))
            known = float(total[i])

    if len(edges) > 1:
        for a in np.argsort(least)[:4]:
            if least[a] <= known:
                look(a, a + 1)
    open_ = np.flatnonzero(least <= known)
    for some in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
        if len(some):
            look(some[0], some[-1] + 1)
    return best


def rows_of(lists: DataFrame, groups: list[Group], nodes: list[Node], classes: int) -> DataFrame:
    """(tree, node, label, w, x): the unlike rows of nodes, from the lists that carry the rows."""
    of_group = _by_group(nodes)

    def run(batches):
        for piece in _pieces(batches, groups, classes):
            if piece.f != piece.group.listed[0]:
                continue
            for k in of_group[piece.grp]:
                s, w = piece.of(nodes[k])
                there = np.flatnonzero(w)
                if len(there):
                    x = np.stack([piece.values(j, s + there) for j in range(piece.group.width)], 1)
                    lists_ = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    one = lambda v, kind, m=len(there): pa.array(np.full(m, v, kind))
                    yield pa.RecordBatch.from_arrays([one(nodes[k].tree, np.int32), one(nodes[k].place, np.int64), pa.array(piece.label[s + there].astype(np.int32)), pa.array(w[there].astype(np.int64)), lists_], ["tree", "node", "label", "w", "x"])

    return lists.mapInArrow(run, "tree int, node long, label int, w long, x array<double>")


#: Rows of a node that is cut by bounds within a task; smaller ones go level by level, all at once.
BOUNDED_ROWS = 10_000


def grow_bounded(grow_tree, x: np.ndarray, y: np.ndarray, classes: int, least: int, kind: str, depth: int, weights: np.ndarray) -> list[tuple]:
    """What grow_tree gives on all features, row by row the same; nodes of more than BOUNDED_ROWS rows are cut as best_cuts cuts those of many tasks."""
    if len(y) <= BOUNDED_ROWS or np.isnan(x).any():
        return grow_tree(x, y, classes, np.arange(x.shape[1]), least, kind, depth, weights)
    width = x.shape[1]
    few = {j: v for j in range(width) for v in (np.unique(x[:, j]),) if len(v) <= FEW}
    group = Group([0], width, few, [j for j in range(width) if j not in few] or [0])
    coded = [np.searchsorted(few[j], x[:, j]).astype(np.uint16) if j in few else np.ascontiguousarray(x[:, j]) for j in range(width)]
    label, w = y.astype(np.uint8 if classes <= 256 else np.uint32), weights[None].astype(np.uint8 if weights.max() < 256 else np.int64)
    rows = _Piece(group, group.listed[0], label, w, coded, classes)
    lists = []
    for f in group.listed:
        lists.append(rows.taken(np.argsort(coded[f], kind="stable")))
        lists[-1].f = f
    made: dict[int, list] = {}  # of each node: left, right, var, th, label, gain
    root = Node(0, 0, 0, np.full(width, -np.inf), np.full(width, np.inf), np.bincount(y, weights, classes).astype(np.int64), len(y))
    work, number = [(0, root, lists, 0)], 1
    while work:
        name, node, lists, level = work.pop()
        s, taken = lists[0].of(node)
        if node.n < len(taken) / 2:  # keep what is the node's
            lists = [piece.taken(b + np.flatnonzero(v)) for piece in lists for b, v in (piece.of(node),)]
            s, taken = lists[0].of(node)
        if node.n <= BOUNDED_ROWS:
            there = s + np.flatnonzero(taken)
            own = np.stack([lists[0].values(j, there) for j in range(width)], 1)
            below = grow_tree(own, lists[0].label[there].astype(int), classes, np.arange(width), least, kind, depth - level, lists[0].w[0, there].astype(np.int64))
            names = {0: name} | {k + 1: number + k for k in range(len(below) - 1)}
            number += len(below) - 1
            made.update({names[b[0]]: [names[b[1]] if b[1] else 0, names[b[2]] if b[1] else 0, *b[3:]] for b in below})
            continue
        whole, best = float(impurity(node.own, kind)), None
        if level < depth and node.own.sum() > least and np.count_nonzero(node.own) > 1:
            cuts = [_of_table(v, _table(lists[0], j, slice(s, s + len(taken)), taken, classes), j, node.own, kind) for j, v in few.items() if j not in group.listed]
            cuts = [c for c in cuts if c and c.total < whole]
            known = min((c.total for c in cuts), default=whole)
            for piece in lists:
                b, v = piece.of(node)
                if got := _best_of(piece, b, v, np.zeros(classes, np.int64), None, node.own, kind, known):
                    if got[0] < whole:
                        cuts.append(Cut(got[0], piece.f, int(got[1].sum()), got[2], got[1], got[3]))
                        known = min(known, got[0])
            best = min(cuts, key=lambda c: (c.total, c.f, c.k), default=None)
        if best is None:
            made[name] = [0, 0, 0, 0.0, int(node.own.argmax()), 0.0]
            continue
        made[name] = [number, number + 1, best.f, best.th, int(node.own.argmax()), whole - best.total]
        high, low = node.high.copy(), node.low.copy()
        high[best.f] = low[best.f] = best.th
        work.append((number, Node(0, 0, 0, node.low, high, best.left, best.n), lists, level + 1))
        work.append((number + 1, Node(0, 0, 0, low, node.high, node.own - best.left, node.n - best.n), lists, level + 1))
        number += 2
    out, line, count = [], [0], 1
    while line:  # numbers as grow_tree gives them, level by level
        below = []
        for name in line:
            left, right, *rest = made[name]
            out.append((len(out), count, count + 1, *rest) if left else (len(out), 0, 0, *rest))
            if left:
                below += [left, right]
                count += 2
        line = below
    return out
