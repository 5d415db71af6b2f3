"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. A shard owns several virtual nodes; a cell belongs to the next node clockwise. Every
shard has a bound on its rows, the bounds adding up to the number of rows, so a full shard's overflow continues clockwise to
the next shard with room and counts end at most one apart. Only counts by cell, at most CELLS numbers, reach the driver; it
settles how many rows of each cell go to which shard, and rows learn their shard from their rank within their cell.

Cases: a null text has 0 bytes and the checksum of no bytes; a null identifier hashes like any other value; rows that repeat
share a cell and take different ranks in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _base as B

CELLS = 65536
#: Parts of a hot cell.
BINS = 64
NODES = 128


def ring(shards: int, nodes: int = NODES, seed: int = 0) -> tuple[list[int], list[int]]:
    """Cells of the virtual nodes, ascending, and the shards they belong to. More shards only add nodes."""
    at = sorted((xxhash.xxh64_intdigest(f"{seed}/{s}/{v}") % CELLS, s, v) for s in range(shards) for v in range(nodes))
    return [a for a, _, _ in at], [s for _, s, _ in at]


def clockwise(shards: int, nodes: int = NODES, seed: int = 0) -> list[list[int]]:
    """For each virtual node, the distinct shards met clockwise from it."""
    _, owner = ring(shards, nodes, seed)
    out = []
    for k in range(len(owner)):
        seen: list[int] = []
        j = k
        while len(seen) < shards:
            if owner[j % len(owner)] not in seen:
                seen.append(owner[j % len(owner)])
            j += 1
        out.append(seen)
    return out


def settle(counts: dict[int, int], shards: int, nodes: int = NODES, seed: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, slot of the first): every row's place from its rank in its cell.

    Cells ask their first shard clockwise, in ring order of an odd stride, so no arc is always last; what a full shard turns away asks the next."""
    at, _ = ring(shards, nodes, seed)
    order = clockwise(shards, nodes, seed)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    left, used, out = dict(counts), dict.fromkeys(counts, 0), []
    cells = sorted(counts, key=lambda c: (c * 40503) % CELLS)
    for hop in range(shards):
        for c in cells:
            n = left[c]
            if not n:
                continue
            s = order[bisect_left(at, c) % len(at)][hop]
            take = min(n, room[s])
            if take:
                out.append((c, used[c], used[c] + take, s, slot[s]))
                used[c] += take
                left[c] -= take
                room[s] -= take
                slot[s] += take
    return out


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, seed: int = 0) -> DataFrame:
    """One row per document: id_col, size, text_crc32, shard, slot. Texts are not shuffled."""
    text = B.text_of(text_col)
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        h.bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell"),
        h.alias("h"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = B.stored(rows, "ring")
    counts = {c: n for c, n in rows.groupBy("cell").count().collect()}  # at most CELLS rows
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(k, T.LongType() if k in ("lo", "hi", "base") else T.IntegerType(), False) for k in ("cell", "lo", "hi", "shard", "base")])
    parts = spark.createDataFrame([(c, a, b, s, t) for c, a, b, s, t in settle(counts, shards, nodes, seed)], schema)
    parts = parts.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard", "base"))).alias("parts"), F.max("hi").alias("rows"))
    # One row a cell, CELLS at most: a proven bound, so it is broadcast. A cell of more than a thousandth of the rows (one identifier, or none, that
    # many rows bear) is counted off in BINS parts, of which there are fewer than a thousand times BINS.
    hot = F.col("rows") > max(1, sum(counts.values()) // B.HOT_SHARE)
    told = rows.join(F.broadcast(parts), "cell").withColumn("bin", F.when(hot, F.pmod("row", F.lit(BINS))).otherwise(0).cast("int"))
    before = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = told.where(hot).groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n")).select("cell", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("cell", "bin").orderBy("h", "id", "text_crc32", "size", "row")) - 1
    placed = told.withColumn("rank", rank.cast("long")).join(F.broadcast(ahead), ["cell", "bin"], "left").withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0)))
    part = F.element_at(F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1)
    return placed.withColumn("part", part).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("part.base") + F.col("rank") - F.col("part.lo")).alias("slot")
    )
