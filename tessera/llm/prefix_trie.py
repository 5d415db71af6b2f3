"""The trie of conversation prefixes, from a Cartesian tree over the common prefixes of sorted conversations.

Conversations are sorted so that all with a common start stand together, and lcp[i] is the number of first turns that conversation i shares
with the one before it. A node of the trie that branches is then an interval between two nearest smaller values of lcp: the tree over these
intervals is the Cartesian tree of lcp with equal values merged, and depths that it lacks are filled in along each edge. Everything a node
says of its members is a sum or a minimum over its interval.

Sorting. A turn is known by a digest of role and text. WIDTH digests in a row make a block's key; where conversations are longer, the distinct
keys are sorted and numbered, the numbers are the units of the next level, and so on until each conversation is one key. So no row and no task
holds a whole conversation. Common prefixes are found from the top level down, one block a level.

Nearest smaller values. Positions are dealt to blocks of W = max(LEAST_BLOCK, n / MOST_BLOCKS). A block says its minimum and the strict minima
seen from either end, with the sums and minima up to there. What a block cannot answer itself goes to the nearest block with a smaller minimum,
found in a table of all block minima (at most MOST_BLOCKS numbers, the only thing that is broadcast); equal questions are asked once.

Cases: turns without conversation belong to none and are left out; a null role or text is empty; turns with the same number stand by the first 48
characters of role and text, then by digest, so rows that repeat are turns like any other; a conversation that is rebuilt to nothing is a
member of the root alone; equal conversations share all their nodes; an empty table gives no node; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _base as B

#: Units of one key; hex digits of a turn's digest and of a key's number.
WIDTH, DIGITS, NAME_DIGITS = 32, 32, 16
LEAST_BLOCK, MOST_BLOCKS = 1024, 65536
#: Fixed values of how conversations are rebuilt: the first crc32(decimal id) % HEAD_MOD turns come from conversation id - id % FAMILY.
FAMILY, HEAD_MOD = 5, 9
#: Depths of an edge that are filled in at once.
FILL = 4096
NOBODY = np.iinfo("int64").max


# ---------------------------------------------------------------- turns


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, q, unit, bytes, cum): each turn's place in its conversation from 1, its digest, the bytes of its text and of all up to it.

    Rows are sorted by ranges, so that a conversation of any length may lie in many partitions; only the first conversation of a
    partition can have begun in an earlier one, so what is carried over is one row a partition."""
    role, text = B.text_of(role_col), B.text_of(text_col)
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.substring(F.concat(role, F.lit("\n"), text), 1, 48).alias("head"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, DIGITS).alias("unit"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ["turn", "head", "unit", "rid"]
    rows = B.stored(rows.where("conv is not null").withColumn("rid", F.monotonically_increasing_id()), "turns")
    rows = B.stored(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "placed")
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("part", "conv").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).select("part", "conv", F.sum("n").over(ahead).alias("q0"), F.sum("b").over(ahead).alias("b0")).where("q0 > 0")
    within = Window.partitionBy("part", "conv").orderBy(*order)
    own = rows.withColumns({"q": F.row_number().over(within).cast("long"), "cum": F.sum("bytes").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    zero = F.lit(0).cast("long")
    told = own.join(F.broadcast(carried), ["part", "conv"], "left")
    return B.stored(told.select("conv", (F.col("q") + F.coalesce("q0", zero)).alias("q"), "unit", "bytes", (F.col("cum") + F.coalesce("b0", zero)).alias("cum")), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, unit, bytes, cum) and (conv, len): the first h turns of conversation id - id % FAMILY, then the own turns after the first h."""
    zero = F.lit(0).cast("long")
    head = F.sort_array(F.collect_list(F.when(F.col("q") < HEAD_MOD, F.struct("q", "unit", "bytes", "cum"))))
    convs = turns.groupBy("conv").agg(F.max("q").alias("n"), head.alias("head")).withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD_MOD)))
    convs = B.stored(convs, "convs")
    cum_at = lambda a, k: F.when(k > 0, F.element_at(a, k.cast("int"))["cum"]).otherwise(zero)
    base = convs.select(F.col("conv").alias("base"), F.col("head").alias("lent"))
    both = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(base, "base", "left")
    both = both.withColumn("lent", F.slice(F.coalesce("lent", F.slice("head", 1, 0)), F.lit(1), F.col("h").cast("int"))).withColumn("got", F.size("lent").cast("long"))
    both = both.select("conv", "n", "h", "got", "lent", cum_at(F.col("lent"), F.col("got")).alias("before"), cum_at(F.col("head"), F.least("h", "n")).alias("skipped"))
    both = B.stored(both, "frames")
    lent = both.select("conv", F.explode("lent").alias("t")).select("conv", F.col("t.q").alias("pos"), "t.unit", "t.bytes", "t.cum")
    own = B.lookup(turns, both.drop("lent"), "conv", "n", turns.count(), "inner").where(F.col("q") > F.col("h"))
    own = own.select("conv", (F.col("got") + F.col("q") - F.col("h")).alias("pos"), "unit", "bytes", (F.col("before") + F.col("cum") - F.col("skipped")).alias("cum"))
    return B.stored(lent.unionByName(own), "rebuilt"), both.select("conv", (F.col("got") + F.greatest(F.col("n") - F.col("h"), zero)).alias("len"))


# ---------------------------------------------------------------- sorting and common prefixes


def keys(turns: DataFrame) -> list[DataFrame]:
    """(conv, blk, key) by level; at the last one each conversation with turns has one key."""
    units, levels = turns.select("conv", (F.col("pos") - 1).alias("at"), "unit"), []
    while True:
        key = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "unit"))), lambda x: x["unit"]), "")
        blocks = B.stored(units.groupBy("conv", F.floor(F.col("at") / WIDTH).alias("blk")).agg(key.alias("key")), "keys")
        levels.append(blocks)
        if not (blocks.agg(F.max("blk")).first()[0] or 0):
            return levels
        names = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("key").sortWithinPartitions("key")
        names = B.stored(names.withColumn("unit", F.lpad(F.hex(F.monotonically_increasing_id()), NAME_DIGITS, "0")), "names")
        units = B.lookup(blocks, names, "key", "n", blocks.count(), "inner").select("conv", F.col("blk").alias("at"), "unit")


def _shared(width: int):
    """How many first units of width characters two keys share."""

    def count(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y)) // width
        if x[: high * width] == y[: high * width]:
            return high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if x[low * width : mid * width] == y[low * width : mid * width] else (low, mid)
        return low

    @F.pandas_udf("long")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([count(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int64")

    return shared


def cells(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, int]:
    """(i, block, conv, len, lcp, common, done), and how many there are: conversations in order, the number of first turns shared with the one
    before (-1 for the first), the bytes of these turns, and whether the one before has more turns than that."""
    levels, spark = keys(turns), turns.sparkSession
    rows = lengths.join(levels[-1].select("conv", "key"), "conv", "left").withColumn("key", F.coalesce("key", F.lit("")))
    rows = rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid"), "conv", "len", "key")
    rows = B.stored(rows, "sorted")
    # A row a partition: where it begins, and the last row of the one before.
    parts = sorted(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("conv", "len", "key"), "mid").alias("last")).collect(), key=lambda r: r.part)
    n = sum(r.n for r in parts)
    begins, last = [], None
    for r in parts:
        begins.append((r.part, (begins[-1][1] + before) if begins else 0, last))
        before, last = r.n, tuple(r.last)
    starts = spark.createDataFrame(begins, "part int, start long, last struct<conv:bigint, len:bigint, key:string>")
    w = Window.partitionBy("part").orderBy("mid")
    prev = F.coalesce(F.lag(F.struct("conv", "len", "key")).over(w), F.col("last"))
    pairs = rows.join(F.broadcast(starts), "part").select((F.col("start") + F.row_number().over(w) - 1).alias("i"), "conv", "len", "key", prev.alias("p"))
    digits = lambda level: NAME_DIGITS if level else DIGITS
    pairs = pairs.select("i", "conv", "len", F.col("p.conv").alias("pconv"), F.col("p.len").alias("plen"), _shared(digits(len(levels) - 1))("key", "p.key").alias("q"))
    for level in reversed(range(len(levels) - 1)):
        side = lambda c, k, level=level: levels[level].select(F.col("conv").alias(c), F.col("blk").alias("q"), F.col("key").alias(k))
        pairs = B.stored(pairs, "pairs").join(side("conv", "a"), ["conv", "q"], "left").join(side("pconv", "b"), ["pconv", "q"], "left")
        pairs = pairs.withColumn("q", F.col("q") * WIDTH + _shared(digits(level))("a", "b")).drop("a", "b")
    first = F.col("pconv").isNull()
    pairs = pairs.select("i", "conv", "len", F.when(first, -1).otherwise(F.least("q", "len", "plen")).alias("lcp"), "plen")
    met = pairs.join(turns.select("conv", F.col("pos").alias("lcp"), F.col("cum").alias("common")), ["conv", "lcp"], "left")
    width = max(LEAST_BLOCK, -(-n // MOST_BLOCKS))
    met = met.select("i", F.floor(F.col("i") / width).alias("block"), "conv", "len", "lcp", F.coalesce("common", F.lit(0).cast("long")).alias("common"), F.coalesce(F.col("plen") > F.col("lcp"), F.lit(False)).cast("long").alias("done"))
    return B.stored(met, "cells"), n


# ---------------------------------------------------------------- nearest smaller values

_SUMMARY = "block long, low long, first long, least long, common long, done long, first_same boolean, last_start long, " + ", ".join(f"{s}_{c} array<bigint>" for s in ("pre", "suf") for c in ("at", "low", "common", "done", "least"))


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's minimum and sums, and its strict minima seen from the start (pre) and the end (suf): place, value, sums and least conversation
    between that end and there (pre: before the place; suf: after it, its own conversation included in least)."""
    rows = rows.sort_values("i")
    i, lcp, conv, common, done, size = (rows[c].to_numpy("int64") for c in ("i", "lcp", "conv", "common", "done", "len"))
    ahead = np.r_[NOBODY, np.minimum.accumulate(lcp)[:-1]]
    behind = np.r_[np.minimum.accumulate(lcp[::-1])[::-1][1:], NOBODY]
    pre, suf = np.flatnonzero(lcp < ahead), np.flatnonzero(lcp < behind)
    sums = {"common": np.r_[0, np.cumsum(common)], "done": np.r_[0, np.cumsum(done)]}
    least = np.r_[NOBODY, np.minimum.accumulate(conv)]
    least_after = np.minimum.accumulate(conv[::-1])[::-1]
    fresh = np.flatnonzero(lcp != size)
    out = {"block": rows["block"].iloc[0], "low": lcp.min(), "first": lcp[0], "least": conv.min(), "common": sums["common"][-1], "done": sums["done"][-1], "first_same": bool(lcp[0] == size[0]), "last_start": i[fresh[-1]] if len(fresh) else -1}
    out |= {"pre_at": i[pre], "pre_low": lcp[pre], "pre_least": least[pre], "suf_at": i[suf], "suf_low": lcp[suf], "suf_least": least_after[suf]}
    for c, s in sums.items():
        out |= {f"pre_{c}": s[pre], f"suf_{c}": s[-1] - s[suf + 1]}
    return pd.DataFrame({k: [v] for k, v in out.items()})


class Lows:
    """Minima over ranges of a sequence in constant time, and the nearest place with less than a bound."""

    def __init__(self, values: np.ndarray):
        self.n, self.rows = len(values), [values]
        while 2 << (len(self.rows) - 1) <= self.n:
            r, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(r[:-step], r[step:]))

    def over(self, a: int, b: int) -> int:
        """Over [a, b); NOBODY if that is empty."""
        if a >= b:
            return NOBODY
        k = (b - a).bit_length() - 1
        return min(int(self.rows[k][a]), int(self.rows[k][b - (1 << k)]))

    def before(self, at: int, bound: int) -> int:
        """The last place before at with less than bound, or -1."""
        for k in reversed(range(len(self.rows))):
            if at >= 1 << k and self.rows[k][at - (1 << k)] >= bound:
                at -= 1 << k
        return at - 1

    def after(self, at: int, bound: int) -> int:
        """The first place from at on with less than bound, or n."""
        for k in reversed(range(len(self.rows))):
            if at + (1 << k) <= self.n and self.rows[k][at] >= bound:
                at += 1 << k
        return at


class Blocks:
    """What is broadcast: at most MOST_BLOCKS numbers of each kind."""

    def __init__(self, rows: list, n: int):
        rows = sorted(rows, key=lambda r: r.block)
        take = lambda c: np.array([r[c] for r in rows], "int64")
        self.n, self.count = n, len(rows)
        self.low, self.least, self.first = Lows(take("low")), Lows(take("least")), take("first")
        self.sums = {c: np.r_[0, np.cumsum(take(c))] for c in ("common", "done")}
        self.first_same = np.array([r.first_same for r in rows], bool)
        #: The start of the run of equal conversations that a block may continue.
        self.run = np.r_[-1, np.maximum.accumulate(take("last_start"))] if rows else np.array([-1])


def _questions(blocks):
    """(block, right, bound, target) of what a block cannot answer: values below each of its minima seen from the start, and no greater than
    it, to the left; below each of its minima seen from the end to the right."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lows = blocks.value.low
        for rows in batches:
            out = []
            for b, pre, suf in zip(rows["block"], rows["pre_low"], rows["suf_low"], strict=True):
                out += [(b, False, x, lows.before(b, x)) for x in sorted({int(v) + k for v in pre for k in (0, 1)})]
                out += [(b, True, int(v), lows.after(b + 1, int(v))) for v in suf]
            yield pd.DataFrame([x for x in out if 0 <= x[3] < lows.n], columns=["block", "right", "bound", "target"])

    return ask


_ANSWER = "target long, right boolean, bound long, at long, low long, common long, done long, least long"


def _answers(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    b, out = block.iloc[0] if len(block) else None, []
    for right, bound in zip(asked["right"], asked["bound"], strict=True):
        side = "pre" if right else "suf"
        low = b[f"{side}_low"]
        k = int(np.argmax(low < bound)) if right else int(np.searchsorted(low, bound)) - 1
        out.append((b["block"], right, bound, *[b[f"{side}_{c}"][k] for c in ("at", "low", "common", "done", "least")]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _ANSWER.split(", ")])


_FOUND = "kind int, i long, conv long, depth long, above long, of_left boolean, members long, leaves long, common long, text string, block long"
#: Kinds of what a block finds: a position (conv, depth: its lcp, above: its nearest smaller place), a node, the hash of a whole run, a piece of a run.
PLACE, NODE, WHOLE, PIECE = range(4)


def _found(blocks):
    def find(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = blocks.value
        rows = rows.sort_values("i")
        b, i = int(rows["block"].iloc[0]), rows["i"].to_numpy("int64")
        lcp, conv, size = (rows[c].to_numpy("int64") for c in ("lcp", "conv", "len"))
        at0, m = int(i[0]), len(rows)
        least, ahead = Lows(conv), {c: np.r_[0, np.cumsum(rows[c].to_numpy("int64"))] + known.sums[c][b] for c in ("common", "done")}
        far = {(bool(r), int(x)): tuple(map(int, rest)) for r, x, *rest in answers[["right", "bound", "target", "at", "low", "common", "done", "least"]].itertuples(index=False)}
        left, right, same = [-1] * m, [m] * m, [False] * m
        stack: list[int] = []
        for k in range(m):
            while stack and lcp[stack[-1]] > lcp[k]:
                right[stack.pop()] = k
            same[k] = bool(stack) and lcp[stack[-1]] == lcp[k]
            left[k] = left[stack[-1]] if same[k] else stack[-1] if stack else -1
            stack.append(k)  # equal values stay on the stack: they all wait for something smaller

        def to_left(k):
            """(place, value, sums after it, block, least from it to its block's end)."""
            if left[k] >= 0:
                j = left[k]
                return at0 + j, int(lcp[j]), {c: int(s[j + 1]) for c, s in ahead.items()}, b, j
            if (False, int(lcp[k])) not in far:
                return -1, -1, None, -1, None
            t, at, low, common, done, low_conv = far[False, int(lcp[k])]
            return at, low, {"common": int(known.sums["common"][t + 1]) - common, "done": int(known.sums["done"][t + 1]) - done}, t, low_conv

        def to_right(k):
            if right[k] < m:
                j = right[k]
                return at0 + j, int(lcp[j]), {c: int(s[j]) for c, s in ahead.items()}, b, j
            if (True, int(lcp[k])) not in far:
                return known.n, -1, {c: int(s[-1]) for c, s in known.sums.items()}, known.count, NOBODY
            t, at, low, common, done, low_conv = far[True, int(lcp[k])]
            return at, low, {"common": int(known.sums["common"][t]) + common, "done": int(known.sums["done"][t]) + done}, t, low_conv

        out = []
        next_first = int(known.first[b + 1]) if b + 1 < known.count else -1
        for k in range(m):
            j, low_j, sum_j, bj, part_j = to_left(k)
            out.append((PLACE, at0 + k, conv[k], lcp[k], j, False, 0, 0, 0, None, b))
            after = int(lcp[k + 1]) if k + 1 < m else next_first
            if size[k] > max(lcp[k], after):
                out.append((NODE, at0 + k, conv[k], size[k], max(lcp[k], after), lcp[k] >= after, 1, 1, 0, None, b))
            if lcp[k] < 0 or same[k]:
                continue
            if left[k] < 0 and far[False, int(lcp[k]) + 1][2] == lcp[k]:
                continue  # an earlier block has the same interval
            e, low_e, sum_e, be, part_e = to_right(k)
            if bj == be:
                who = least.over(part_j, part_e)
            else:
                who = min(least.over(part_j, m) if bj == b else part_j, known.least.over(bj + 1, be), least.over(0, part_e) if be == b else part_e)
            out.append((NODE, j, who, lcp[k], max(low_j, low_e), low_j >= low_e, e - j, 1 + sum_e["done"] - sum_j["done"], sum_e["common"] - sum_j["common"], None, b))
        begins = np.flatnonzero(np.r_[True, lcp[1:] != size[1:]])
        for s, e in zip(begins, np.r_[begins[1:], m], strict=True):
            ids = ",".join(map(str, conv[s:e]))
            begun = lcp[s] != size[s]
            goes_on = e == m and b + 1 < known.count and known.first_same[b + 1]
            start = at0 + int(s) if begun else int(known.run[b])
            out.append((WHOLE, start, 0, size[s], 0, False, 0, 0, 0, hashlib.sha256(ids.encode()).hexdigest(), b) if begun and not goes_on else (PIECE, start, 0, size[s], 0, False, 0, 0, 0, ids, b))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return find


def _long_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of runs, by start and block, to one hash a run: they are hashed as they come."""
    start, depth, state = None, None, None
    told = lambda: pd.DataFrame({"i": [start], "depth": [depth], "text": [state.hexdigest()]})
    for rows in batches:
        for i, d, text in zip(rows["i"], rows["depth"], rows["text"], strict=True):
            if i == start:
                state.update(b",")
            else:
                if state:
                    yield told()
                start, depth, state = i, d, hashlib.sha256()
            state.update(text.encode())
    if state:
        yield told()


def found(rows: DataFrame, n: int) -> DataFrame:
    """What all blocks find, with the nearest smaller values that lie in other blocks."""
    spark = rows.sparkSession
    summary = B.stored(rows.groupBy("block").applyInPandas(_summary, _SUMMARY), "blocks")
    few = summary.select("block", "low", "first", "least", "common", "done", "first_same", "last_start").collect()  # at most MOST_BLOCKS
    blocks = spark.sparkContext.broadcast(Blocks(few, n))
    asked = B.stored(summary.select("block", "pre_low", "suf_low").mapInPandas(_questions(blocks), "block long, right boolean, bound long, target long"), "asked")
    once = asked.select("right", "bound", "target").distinct()
    answers = once.groupBy("target").cogroup(summary.join(once.select(F.col("target").alias("block")).distinct(), "block", "left_semi").groupBy("block")).applyInPandas(_answers, _ANSWER)
    told = asked.join(answers, ["target", "right", "bound"])
    return B.stored(rows.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_found(blocks), _FOUND), "found")


# ---------------------------------------------------------------- the trie


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. turns: conv, pos, unit, bytes,
    cum; lengths: conv, len."""
    rows, n = cells(turns, lengths)
    got = found(rows, n)
    places = got.where(F.col("kind") == PLACE).select(F.col("i"), F.col("conv").alias("own"), F.col("depth").alias("lcp"), F.col("above").alias("smaller"))
    nodes = got.where(F.col("kind") == NODE).drop("kind", "text", "block").join(places, "i")
    name = lambda *c: F.concat_ws(":", *c)
    up = F.when(F.col("above") >= 0, F.when(F.col("of_left"), name("smaller", "lcp")).otherwise(name("i", "above")))
    long_runs = got.where(F.col("kind") == PIECE).select("i", "depth", "block", "text").repartition("i").sortWithinPartitions("i", "block").select("i", "depth", "text").mapInPandas(_long_runs, "i long, depth long, text string")
    ends = got.where(F.col("kind") == WHOLE).select("i", "depth", "text").unionByName(long_runs).withColumnRenamed("text", "ends")
    nodes = B.stored(nodes.join(ends, ["i", "depth"], "left").select("own", "conv", "depth", "above", "members", "leaves", "common", "ends", name("i", "depth").alias("node"), up.alias("up")), "nodes")
    below = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    nodes = B.stored(nodes.join(below, "node", "left").fillna(0, ["children"]), "nodes")
    over = nodes.where("children > 0").select(F.col("node").alias("up"), F.col("conv").alias("parent"), F.col("children").alias("n"))
    nodes = B.lookup(nodes, over, "up", "n", nodes.count())
    fill = nodes.withColumn("from", F.explode(F.sequence(F.col("above") + 1, "depth", F.lit(FILL).cast("long")))).withColumn("d", F.explode(F.sequence("from", F.least(F.col("from") + (FILL - 1), "depth"))))
    fill = B.stored(fill.select("own", "conv", "d", "depth", "above", "members", "leaves", "common", "ends", "children", "parent"), "depths")
    zero = F.lit(0).cast("long")
    shared = fill.where("members > 1").join(turns.select(F.col("conv").alias("own"), (F.col("pos") + 1).alias("d"), "cum"), ["own", "d"], "left")
    every = shared.unionByName(fill.where("members = 1").withColumn("cum", zero))
    bottom = F.col("d") == F.col("depth")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return every.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.when(F.col("d") == F.col("above") + 1, F.col("parent")).otherwise(F.col("conv"))).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(bottom, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("common") - (F.col("members") - 1) * F.coalesce("cum", zero)).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends", nobody)).otherwise(nobody).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of rebuilt conversations; see trie()."""
    return trie(*rebuilt(numbered(conversations, conv_col, turn_col, role_col, text_col)))
