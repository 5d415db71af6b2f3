"""Blocked Bloom filters as tables, DataFrame functions only.

A filter is a table of blocks of 32768 bits. A key's first hash names its block, its second HASHES bits within that block, so one row of the
table answers a key. The number of blocks follows the counted keys: KEY_BITS bits each, which lets about 0.7 % of strangers pass. A table of at
most BROADCAST_BLOCKS blocks (64 MB) is broadcast; a larger one is dealt by block and met by a shuffle. There are no false negatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS, KEY_BITS, HASHES = 32768, 12, 4
BROADCAST_BLOCKS = 16384


@dataclass
class Filter:
    #: (f_block, f_bits)
    table: DataFrame
    blocks: int

    def stored(self, store) -> Filter:
        return Filter(store(self.table), self.blocks)


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * KEY_BITS // BLOCK_BITS))


def _places(key, blocks: int):
    """(block, HASHES bits within it)."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    second = F.xxhash64(key, F.lit(1))
    return block, [F.shiftrightunsigned(second, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("long") for k in range(HASHES)]


def make(keys: DataFrame, key, count: int) -> Filter:
    """The filter of a column of keys. count: how many rows keys has, or more."""
    blocks = blocks_for(count)
    block, bits = _places(key, blocks)
    each = keys.where(key.isNotNull()).select(block.alias("f_block"), F.explode(F.array(*bits)).alias("f_pos"))
    return Filter(each.groupBy("f_block").agg(F.expr("bitmap_construct_agg(f_pos)").alias("f_bits")), blocks)


def told(rows: DataFrame, key, filt: Filter) -> DataFrame:
    """rows with f_maybe: false where the key surely is not among the filter's, null keys included."""
    block, bits = _places(key, filt.blocks)
    table = F.broadcast(filt.table) if filt.blocks <= BROADCAST_BLOCKS else filt.table
    byte = lambda k: F.expr(f"cast(conv(hex(substring(f_bits, cast(f_pos[{k}] div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.lit(True)
    for k in range(HASHES):
        hit = hit & (byte(k).bitwiseAND(F.expr(f"cast(shiftleft(1, cast(f_pos[{k}] % 8 as int)) as int)")) != 0)
    placed = rows.withColumns({"f_block": F.when(key.isNotNull(), block), "f_pos": F.array(*bits)})
    return placed.join(table, "f_block", "left").withColumn("f_maybe", F.coalesce(hit, F.lit(False))).drop("f_block", "f_pos", "f_bits")
