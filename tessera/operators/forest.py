"""Random forests: split search, exact and scalable fitting, prediction and evaluation."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checkpoints import stored
from tessera.functions import log_factorial_ratio
from tessera.operators.agg import kfold
from tessera.operators.levels import FEW, Group, Node, best_cuts, grow_bounded, impurity, listed, rows_of
from tessera.operators.ordered import running

NODES = "tree int, node int, left int, right int, var int, th double, label int, gain double"


def _cuts(df: DataFrame, feature: str, labels: list[int]) -> DataFrame:
    """(f, next, k, all, l0.., r0..): class counts left and right of each place between unlike values; k rows lie to the left.

    Rows of a value are counted first; running sums over the distinct values go range by range."""
    counts = df.groupBy(F.col(feature).alias("f")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == c).alias(f"n{c}") for c in labels])
    own = running(counts, ["f"], ["n", *[f"n{c}" for c in labels]], "f").where("after is not null")
    return own.select("f", F.col("after").alias("next"), F.col("run_n").alias("k"), F.col("all_n").alias("all"), *[F.col(f"run_n{c}").alias(f"l{c}") for c in labels], *[(F.col(f"all_n{c}") - F.col(f"run_n{c}")).alias(f"r{c}") for c in labels])


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def gini_split(df: DataFrame, feature: str, labels: list[int]) -> DataFrame:
    """(n_left, n_right, gini, threshold): the first cut with the smallest weighted Gini impurity."""
    c = _cuts(df, feature, labels)
    side = lambda p, n: 1.0 - _sum([F.pow(F.col(f"{p}{k}") / n, 2) for k in labels])
    kr = F.col("all") - F.col("k")
    g = (F.col("k") * side("l", F.col("k")) + kr * side("r", kr)) / F.col("all")
    c = c.withColumns({"g": g, "th": (F.col("f") + F.col("next")) / 2})
    best = c.agg(F.min_by(F.struct("k", "all", "g", "th"), F.struct("g", "k")).alias("b"))
    return best.select(F.col("b.k").alias("n_left"), (F.col("b.all") - F.col("b.k")).alias("n_right"), F.col("b.g").alias("gini"), F.col("b.th").alias("threshold"))


def entropy_split(df: DataFrame, feature: str, labels: list[int]) -> DataFrame:
    """The same with the combinatorial entropy ln(n! / prod n_i!) of both sides added."""
    c = _cuts(df, feature, labels)
    side = lambda p, n: log_factorial_ratio(n) - _sum([log_factorial_ratio(F.col(f"{p}{k}")) for k in labels])
    e = side("l", F.col("k")) + side("r", F.col("all") - F.col("k"))
    c = c.withColumns({"e": e, "th": (F.col("f") + F.col("next")) / 2})
    best = c.agg(F.min_by(F.struct("k", "all", "e", "th"), F.struct("e", "k")).alias("b"))
    return best.select(F.col("b.k").alias("n_left"), (F.col("b.all") - F.col("b.k")).alias("n_right"), F.col("b.e").alias("entropy"), F.col("b.th").alias("threshold"))


# ---------------------------------------------------------------- fitting


def grow_tree(x: np.ndarray, y: np.ndarray, classes: int, features: np.ndarray, least: int, kind: str, depth: int = 64, weights: np.ndarray | None = None) -> list[tuple]:
    """(node, left, right, var, th, label, gain), level by level, until nodes are pure, of at most least rows, or cannot be cut. left 0 marks a leaf.
    A row counts as often as its weight says.

    Every feature is sorted once. A level is a few passes over each feature's list, in which the rows of a node stand together, in order of
    their values; rows then go left or right within the lists, so the order stays. Of equal cuts the first feature's first one is taken."""
    w = np.ones(len(y), np.int64) if weights is None else weights
    lists = []  # of each feature: rows, values and labels, by node and value
    for f in features:
        order = np.argsort(x[:, f], kind="stable").astype(np.int32)
        lists.append((order, x[order, f], y[order].astype(np.int16)))
    starts, ids, made, out = np.zeros(1, np.int64), np.zeros(1, np.int64), 1, []
    for level in range(depth + 1):
        m = len(lists[0][0])
        sizes = np.diff(np.append(starts, m))
        seg = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        own = np.bincount(seg.astype(np.int64) * classes + lists[0][2], w[lists[0][0]], minlength=len(starts) * classes).astype(np.int64).reshape(-1, classes)
        whole = impurity(own, kind)
        open_ = ((own > 0).sum(1) > 1) & (own.sum(1) > least) & (level < depth)
        best, var, cut, th = whole.copy(), np.full(len(starts), -1), np.zeros(len(starts), np.int64), np.zeros(len(starts))
        within = (seg[1:] == seg[:-1]) & open_[seg[:-1]] if m else np.zeros(0, bool)
        for k, (order, v, label) in enumerate(lists):
            at = np.flatnonzero((v[1:] != v[:-1]) & within)
            if not len(at):
                continue
            here = seg[at]
            base, left = starts[here], np.empty((len(at), classes), np.int64)
            times = w[order]
            for c in range(classes):
                run = np.cumsum(np.where(label == c, times, 0))
                left[:, c] = run[at] - np.where(base > 0, run[base - 1], 0)
            total = impurity(left, kind) + impurity(own[here] - left, kind)
            first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            low = np.minimum.reduceat(total, first)
            hit = np.flatnonzero(total == np.repeat(low, np.diff(np.append(first, len(at)))))
            hit = hit[np.r_[True, here[hit][1:] != here[hit][:-1]]]
            better = low < best[here[first]]
            s, at = here[hit][better], at[hit][better]
            best[s], var[s], cut[s], th[s] = low[better], k, at - starts[s] + 1, (v[at] + v[at + 1]) / 2
        split = var >= 0
        children = np.where(split, made + 2 * (np.cumsum(split) - 1), 0)
        made += 2 * int(split.sum())
        shown = np.where(split, np.asarray(features)[var], 0)
        out += zip(*(a.tolist() for a in (ids, children, children + split, shown, np.where(split, th, 0.0), own.argmax(1), np.where(split, whole - best, 0.0))), strict=True)
        if not split.any():
            break
        left_of = np.zeros(len(y), bool)
        for k, (order, _, _) in enumerate(lists):
            mine = (var == k)[seg]
            left_of[order[mine]] = (np.arange(m) - starts[seg] < cut[seg])[mine]
        lefts, rights = cut[split], (sizes - cut)[split]
        starts_new = np.r_[0, np.cumsum(np.stack([lefts, rights], 1).ravel())[:-1]]
        stay = split[seg]
        begin, both = np.r_[0, np.cumsum(lefts + rights)[:-1]], lefts + rights
        to_left, to_right = np.repeat(starts_new[::2], both), np.repeat(starts_new[1::2], both)
        for k, (order, v, label) in enumerate(lists):
            order, v, label = order[stay], v[stay], label[stay]
            l = left_of[order]
            run = np.cumsum(l)
            before = run - l - np.repeat(run[begin] - l[begin], both)  # rows of the node that go left, ahead of this one
            place = np.where(l, to_left + before, to_right + np.arange(len(l)) - np.repeat(begin, both) - before)
            moved = (np.empty_like(order), np.empty_like(v), np.empty_like(label))
            for a, b in zip(moved, (order, v, label)):
                a[place] = b
            lists[k] = moved
        starts = starts_new
        ids = np.stack([children[split], children[split] + 1], 1).ravel()
    return out


#: Rows of a node, equal ones counted as one, that one task grows alone; larger nodes are cut by sums over the whole table, a level at a time.
TASK_ROWS = 2_000_000
#: Trees on the same features whose rows are counted in one pass.
TREES_AT_ONCE = 32


def _counted(df: DataFrame, values: list[Column], features: tuple[int, ...], taken: list[Column]) -> DataFrame:
    """(label, x0, x1, ..., w0, w1, ...): the rows of df that are alike in class and features, and how often each of some trees takes them; stored."""
    xs, ws = [f"x{j}" for j in range(len(features))], [f"w{k}" for k in range(len(taken))]
    rows = df.select(F.col("label").cast("int").alias("label"), *[values[f].alias(x) for f, x in zip(features, xs)], *[t.alias(w) for t, w in zip(taken, ws)])
    counted = rows.groupBy("label", *xs).agg(*[F.count_if(F.col(w)).alias(w) for w in ws])
    return stored(counted.where(reduce(or_, (F.col(w) > 0 for w in ws))))


def _few(base: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The values of features of at most FEW of them."""
    told = base.agg(*[F.approx_count_distinct(f"x{j}").alias(f"x{j}") for j in range(width)], *[F.count_if(F.col(f"x{j}").isNull() | F.isnan(f"x{j}")).alias(f"n{j}") for j in range(width)]).first()
    out = {}
    for j in range(width):
        if told[f"x{j}"] <= 2 * FEW and not told[f"n{j}"]:
            values = np.array(sorted(r[0] for r in base.select(f"x{j}").distinct().limit(FEW + 1).collect()))
            out |= {j: values} if len(values) <= FEW else {}
    return out


def _chosen(features: list[str], width: int | None, trees: int, seed: int) -> list[list[int]]:
    width = width or max(1, round(len(features) ** 0.5))
    return [sorted(np.random.default_rng([seed, t]).choice(len(features), width, replace=False).tolist()) for t in range(trees)]


def _taken(share: float, trees: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(t), "id"), F.lit(1_000_000)) < int(share * 1_000_000) for t in range(trees)]


def fit(df: DataFrame, features: list[str], trees: int = 100, share: float = 0.632, least: int = 1, kind: str = "gini", seed: int = 0, width: int | None = None, depth: int = 60, task_rows: int = TASK_ROWS) -> DataFrame:
    """The node table of a forest of exact trees, each grown on its own subsample without replacement and width features, sqrt(features) unless given."""
    return _grown(df, features, _chosen(features, width, trees, seed), _taken(share, trees, seed), share, least, kind, depth, task_rows)


def _together(chosen: list[list[int]]) -> list[tuple[tuple[int, ...], list[int]]]:
    """Features and the trees that are grown on them, TREES_AT_ONCE at most."""
    out = []
    for own in sorted(set(map(tuple, chosen))):
        mine = [t for t, c in enumerate(chosen) if tuple(c) == own]
        out += [(own, mine[k : k + TREES_AT_ONCE]) for k in range(0, len(mine), TREES_AT_ONCE)]
    return out


def _top(lists: DataFrame, groups: list[Group], roots: list[Node], classes: int, least: int, kind: str, depth: int, task_rows: int) -> tuple[list[tuple], list[Node]]:
    """(tree, place, label, cut, gain) of the nodes of more than task_rows unlike rows, a level of all trees at once; and the nodes below them."""
    top, below, level, made = [], [], 0, roots
    while made:
        below += [node for node in made if node.n <= task_rows]
        open_ = [node for node in made if node.n > task_rows]
        tried = [k for k, node in enumerate(open_) if level < depth and node.own.sum() > least and np.count_nonzero(node.own) > 1]
        cuts = dict(zip(tried, best_cuts(lists, groups, [open_[k] for k in tried], classes, kind))) if tried else {}
        made, level = [], level + 1
        for k, node in enumerate(open_):
            cut = cuts.get(k)
            top.append((node.tree, node.place, int(node.own.argmax()), cut, float(impurity(node.own, kind)) - cut.total if cut else 0.0))
            if cut:
                high, low = node.high.copy(), node.low.copy()
                high[cut.f] = low[cut.f] = cut.th
                made.append(Node(node.grp, node.tree, 2 * node.place + 1, node.low, high, cut.left, cut.n))
                made.append(Node(node.grp, node.tree, 2 * node.place + 2, low, node.high, node.own - cut.left, node.n - cut.n))
    return top, below


def _grown(df: DataFrame, features: list[str], chosen: list[list[int]], taken: list[Column], share: float, least: int, kind: str, depth: int, task_rows: int) -> DataFrame:
    """The node table of trees on the features chosen for each and the rows taken by each, about share of them.

    Of a large table, rows that a tree cannot tell apart are counted and kept once. Nodes of more than task_rows such rows are cut level by level, those
    of all trees at once, from lists that are sorted once (levels.py). A smaller node's rows meet in one task, which grows what is below it. So no
    tree and no node of more than task_rows rows is ever in one task. A tree that is cut alike at every level has the nodes that a single task
    would give it."""
    most, n = df.agg(F.max("label"), F.count(F.lit(1))).first()
    classes, width, trees = (most or 0) + 1, len(chosen[0]), len(chosen)
    values = [F.col(f).cast("double") for f in features]
    top, small = [], []
    if n * share > task_rows / 2:  # then some tree may need more than one task
        groups, lists, nodes = [], [], []
        for own, mine in _together(chosen):
            base = _counted(df, values, own, [taken[t] for t in mine])
            told = {r["label"]: r for r in base.groupBy("label").agg(*[f.alias(c + str(k)) for k in range(len(mine)) for c, f in (("w", F.sum(f"w{k}")), ("n", F.count_if(F.col(f"w{k}") > 0)))]).collect()}  # a row a class
            counts, sizes = (np.array([[told[c][side + str(k)] if c in told else 0 for c in range(classes)] for k in range(len(mine))]) for side in "wn")
            if sizes.sum(1).max() <= task_rows:
                each = base.select(F.lit(0).cast("long").alias("node"), "label", F.array(*[f"x{j}" for j in range(width)]).alias("x"), F.posexplode(F.array(*[f"w{k}" for k in range(len(mine))])).alias("tree", "w"))
                small.append(each.where("w > 0").select(F.element_at(F.lit(mine), F.col("tree") + 1).cast("int").alias("tree"), "node", "label", "w", "x"))
                continue
            few = _few(base, width)
            groups.append(Group(mine, width, few, [j for j in range(width) if j not in few] or [0]))
            lists.append(listed(base, len(groups) - 1, groups[-1], classes, int(sizes.sum(1).max())))
            nodes += [Node(len(groups) - 1, t, 0, np.full(width, -np.inf), np.full(width, np.inf), counts[k], int(sizes[k].sum())) for k, t in enumerate(mine)]
        if groups:
            rows = stored(reduce(DataFrame.unionByName, lists))
            top, below = _top(rows, groups, nodes, classes, least, kind, depth, task_rows)
            small += [rows_of(rows, groups, below, classes)] if below else []
    else:
        own = F.transform(F.element_at(F.lit(chosen), F.col("tree") + 1), lambda k: F.element_at(F.array(*values), k.cast("int") + 1))
        dealt = df.withColumn("tree", F.explode(F.filter(F.transform(F.array(*taken), lambda t, k: F.when(t, k)), lambda k: k.isNotNull())))
        small.append(dealt.select("tree", F.lit(0).cast("long").alias("node"), F.col("label").cast("int").alias("label"), F.lit(1).cast("long").alias("w"), own.alias("x")))

    def grow(table: pa.Table) -> pa.Table:
        tree, place = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        left_levels = depth - (place + 1).bit_length() + 1
        node, left, right, var, th, label, gain = (np.array(c) for c in zip(*grow_bounded(grow_tree, x, table.column("label").to_numpy().astype(int), classes, least, kind, left_levels, table.column("w").to_numpy())))
        var = np.array(chosen[tree])[var] * (left > 0)
        n = len(node)
        return pa.table([pa.array(np.full(n, tree), pa.int32()), pa.array(np.full(n, place), pa.int64()), pa.array(np.full(n, n), pa.int32()), *(pa.array(a, pa.int32()) for a in (node, left, right, var)), pa.array(th, pa.float64()), pa.array(label, pa.int32()), pa.array(gain, pa.float64())], names=["tree", "place", "size", "node", "left", "right", "var", "th", "label", "gain"])

    schema = "tree int, place long, size int, node int, left int, right int, var int, th double, label int, gain double"
    below = reduce(DataFrame.unionByName, small).repartition(4 * trees, "tree", "node").groupBy("tree", "node").applyInArrow(grow, schema) if small else df.sparkSession.createDataFrame([], schema)
    if not top:
        return below.select(*[c.split()[0] for c in NODES.split(", ")])
    placed = [(t, place, 1, 0, int(cut is not None), int(cut is not None), chosen[t][cut.f] if cut else 0, cut.th if cut else 0.0, label, gain, True) for t, place, label, cut, gain in top]
    above = df.sparkSession.createDataFrame(placed, schema + ", top boolean")
    every = stored(above.unionByName(below.withColumn("top", F.lit(False))))
    # Numbers from 0 without gaps: pieces of a tree, a node above or what a task grew, stand by place.
    pieces = every.where("node = 0").select("tree", "place", (F.sum("size").over(Window.partitionBy("tree").orderBy("place")) - F.col("size")).cast("int").alias("at"))
    pieces = stored(pieces)
    child = lambda side, c: pieces.select("tree", F.col("place").alias(side), F.col("at").alias(c))
    sides = every.join(pieces, ["tree", "place"]).withColumns({"p1": F.when(F.col("top"), 2 * F.col("place") + 1), "p2": F.when(F.col("top"), 2 * F.col("place") + 2)})
    sides = sides.join(child("p1", "to_left"), ["tree", "p1"], "left").join(child("p2", "to_right"), ["tree", "p2"], "left")
    link = lambda c, to: F.when(F.col("left") == 0, 0).otherwise(F.when(F.col("top"), F.col(to)).otherwise(F.col(c) + F.col("at"))).cast("int").alias(c)
    return sides.select("tree", (F.col("node") + F.col("at")).cast("int").alias("node"), link("left", "to_left"), link("right", "to_right"), "var", "th", "label", "gain")


#: Nodes that are applied at once; larger models are applied some trees at a time.
NODES_AT_ONCE = 5_000_000


def _votes(df: DataFrame, nodes: DataFrame, features: list[str], out: str) -> DataFrame:
    """df with out, the labels that the trees of nodes give a row. Nodes are shipped as arrays; rows are walked down a level at a time, all
    rows of a batch at once."""
    table = nodes.select("tree", "node", "left", "right", "var", "th", "label").orderBy("tree", "node").toArrow()  # at most NODES_AT_ONCE rows
    tree, node = (table.column(c).to_numpy() for c in ("tree", "node"))
    starts = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(tree) else np.zeros(0, np.int64)
    place = np.repeat(starts, np.diff(np.append(starts, len(tree))))
    left, right = (np.where(table.column("left").to_numpy() == 0, np.arange(len(tree)), place + table.column(c).to_numpy()) for c in ("left", "right"))
    if len(tree) and not np.array_equal(node, np.arange(len(tree)) - place):
        raise ValueError("a tree's nodes are numbered from 0 without gaps")
    shipped = df.sparkSession.sparkContext.broadcast((starts, left, right, table.column("var").to_numpy(), table.column("th").to_numpy(), table.column("label").to_numpy()))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = schema.names

    def run(batches):
        starts, left, right, var, th, label = shipped.value
        for batch in batches:
            x = np.stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], axis=1)
            got = np.empty((batch.num_rows, len(starts)), np.int32)
            for k, start in enumerate(starts):
                at, rows = np.full(batch.num_rows, start), np.arange(batch.num_rows)
                while len(rows):
                    here = at[rows]
                    new = np.where(x[rows, var[here]] < th[here], left[here], right[here])
                    at[rows], rows = new, rows[new != here]
                got[:, k] = label[at]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(starts)), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names)

    return df.mapInArrow(run, schema)


def predict(df: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """df with prediction: majority of the trees, the smallest label among equals. No shuffle: votes are counted within the row.

    The model is shipped to the tasks if it has at most NODES_AT_ONCE nodes; a larger one some trees at a time, each pass adding its votes to
    the stored rows. One tree is always shipped whole: the task that grew it has held it and its rows."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect()  # one row a tree
    groups, size = [[]], 0
    for r in sizes:
        if size and size + r["n"] > NODES_AT_ONCE:
            groups, size = [*groups, []], 0
        groups[-1].append(r["tree"])
        size += r["n"]
    rows, votes = df, []
    for k, trees in enumerate(groups):
        some = nodes if len(groups) == 1 else nodes.where(F.col("tree").between(trees[0], trees[-1]))
        rows = _votes(rows if not k else stored(rows), some, features, f"votes_{k}")
        votes.append(F.col(f"votes_{k}"))
    every = F.concat(*votes)
    best = F.array_max(F.transform(F.array_distinct(every), lambda v: F.struct(F.size(F.filter(every, lambda x: x == v)).alias("n"), (-v).alias("label"))))
    return rows.withColumn("prediction", -best["label"]).select(*df.columns, "prediction")


def tree_expression(nodes: list[tuple], features: list[str], at: int = 0) -> Column:
    """One tree (node, left, right, var, th, label) as nested CASE WHEN, compiled with the query."""
    by = {n[0]: n for n in nodes}
    node = by[at]
    if node[1] == 0:
        return F.lit(int(node[5]))
    return F.when(F.col(features[node[3]]) < float(node[4]), tree_expression(nodes, features, node[1])).otherwise(tree_expression(nodes, features, node[2]))


def importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """(var, importance): each feature's share of all gains."""
    gains = nodes.where("left > 0").groupBy("var").agg(F.sum("gain").alias("g"))
    total = gains.agg(F.sum("g").alias("t"))
    names = nodes.sparkSession.createDataFrame([(i, f) for i, f in enumerate(features)], "var int, name string")
    return names.join(gains, "var", "left").crossJoin(F.broadcast(total)).select("var", "name", F.coalesce(F.col("g") / F.col("t"), F.lit(0.0)).alias("importance"))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg((F.count_if(F.col("prediction") == F.col("label")) / F.count(F.lit(1))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def feature_ranks(df: DataFrame, features: list[str]) -> DataFrame:
    """(id, feature, rank): place of each row in each feature's order, from 0, ties by identifier."""
    long = df.select("id", F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "value"))
    got = running(long.withColumn("one", F.lit(1)), ["feature", "value", "id"], ["one"])  # every row has every feature
    return got.select("id", "feature", F.pmod(F.col("run_one") - 1, F.col("all_one") / len(features)).cast("int").alias("rank"))


def cross_validate(df: DataFrame, features: list[str], folds: int = 5, trees: int = 100, share: float = 0.632, least: int = 1, kind: str = "gini", seed: int = 0, width: int | None = None, depth: int = 60, task_rows: int = TASK_ROWS) -> DataFrame:
    """(fold, n, accuracy): each fold of identifiers predicted by a forest that is fitted on the others. The trees of all folds are grown together."""
    rows, out = kfold(df, "id", folds), []
    taken = [t & (F.col("fold") != k) for k in range(folds) for t in _taken(share, trees, seed)]
    every = stored(_grown(rows, features, _chosen(features, width, trees, seed) * folds, taken, share * (folds - 1) / folds, least, kind, depth, task_rows))
    for k in range(folds):
        model = every.where(F.col("tree").between(k * trees, (k + 1) * trees - 1)).withColumn("tree", F.col("tree") - k * trees)
        out.append(accuracy(predict(rows.where(F.col("fold") == k), model, features)).select(F.lit(k).alias("fold"), "n", "accuracy"))
    return reduce(DataFrame.unionByName, out)
