"""Running sums and ranks over a whole table without one task for all rows: ranges, their sums, and windows within a range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import stored


#: Rows of a range, about.
RANGE_ROWS = 500_000


def running(df: DataFrame, order: list[str], sums: list[str], following: str | None = None) -> DataFrame:
    """df with run_<c>, the sum of each column of sums up to the row in the given order (which must tell rows apart), all_<c>, its total, and
    after, the column following of the next row.

    Rows are dealt to ranges of the order; one row a range is gathered for the offsets, which are broadcast. Windows stay within ranges.
    There are more ranges of more rows, not larger ones, and as many tasks."""
    ranges = max(1, math.ceil(df.count() / RANGE_ROWS))
    dealt = stored(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    first = [F.min(following).alias("first")] if following else []
    parts = dealt.groupBy("range").agg(*[F.sum(c).alias("part_" + c) for c in sums], *first)
    before, every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # one row a range
    offsets = {"off_" + c: F.coalesce(F.sum("part_" + c).over(before), F.lit(0)) for c in sums} | {"all_" + c: F.sum("part_" + c).over(every) for c in sums}
    if following:
        offsets["beyond"] = F.lead("first").over(Window.orderBy("range"))
    parts = parts.withColumns(offsets).drop("first", *["part_" + c for c in sums])
    w = Window.partitionBy("range").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.repartition(ranges, "range").withColumns({"run_" + c: F.sum(c).over(upto) for c in sums} | ({"after": F.lead(following).over(w)} if following else {}))
    out = out.join(F.broadcast(parts), "range").withColumns({"run_" + c: F.col("run_" + c) + F.col("off_" + c) for c in sums})
    if following:
        out = out.withColumn("after", F.coalesce("after", "beyond")).drop("beyond")
    return out.drop("range", *["off_" + c for c in sums])
