"""Connected components of a table of links by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base as B


def components(links: DataFrame, scope: str = "op") -> DataFrame:
    """(node, label): the smallest node reachable, for every node of links (a, b). Each round stores its labels.

    A round takes the smallest label among a node and its neighbours, then the label of that label, so chains halve. A node with
    many links, or a label that many nodes bear, is a hot key of either join: B.lookup broadcasts its row."""
    both = B.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", scope)
    first = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count(F.lit(1)).alias("links"))
    labels = B.stored(first.select(F.col("a").alias("node"), "label", "links"), "labels", scope)
    total = labels.agg(F.sum("links")).first()[0] or 0
    while True:
        near = B.lookup(both, labels.select(F.col("node").alias("b"), "label", "links"), "b", "links", total, "inner").groupBy("a").agg(F.min("label").alias("near"))
        step = B.stored(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", "links", F.least("label", "near").alias("next")), "step", scope)
        borne = step.groupBy("next").agg(F.count(F.lit(1)).alias("nodes")).join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next")
        jump = B.lookup(step, borne, "next", "nodes", total).withColumn("new", F.least("next", F.coalesce("far", "next")))
        new = B.stored(jump.select("node", F.col("new").alias("label"), "links", (F.col("new") != F.col("label")).alias("moved")), "labels", scope)
        labels = new.select("node", "label", "links")
        if new.where("moved").isEmpty():
            return labels.select("node", "label")
