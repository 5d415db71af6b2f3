"""Mixing sources to target weights by Sainte-Lague apportionment, DataFrame functions only.

Sources get target sizes by weight (water-filling under a cap of max_repeat times their own size). Blocks of equal size are
allocated to sources by highest quotients target / (2 k + 1), then each source's blocks to its shards likewise, which gives
integer quotas for each shard and source. Within a shard and source the documents stand in a seeded order. A quota of words takes
every document quota div size of the stream times, and those at the head of the order, whole, once more until the rest is used up.

Documents of equal source, identifier and size, repeated rows and rows without identifier above all, are one group in every step and stand one
after another in the order, so a group may hold any part of the rows; a quota that ends within a group takes so many of its documents.

Cases: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own, last in order; rows
that repeat are rows like any other; an empty table gives an empty result; other columns are ignored. The table of sources, a row a
source, is summed and ranked in one task; all else is dealt out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _base as B

#: Blocks have total / RESOLUTION words, MIN_BLOCK at least.
RESOLUTION, MIN_BLOCK = 1_000_000, 16
#: Documents are dealt to this many bins of their source; a shard is a set of bins.
BINS = 1024
#: Documents of one group that a task writes at a time.
RUN = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1 .. cycle, repeating, by source in code point order, null last. sources: one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))


def targets(sources: DataFrame, max_repeat: int = 3) -> DataFrame:
    """Adds target: shares of the whole by weight, at most max_repeat * source_size, the excess reshared until none is above.

    The level at which water-filling ends is found from running sums over sources sorted by cap / weight."""
    s = sources.withColumns({"_cap": (F.col("source_size") * max_repeat).cast("double")}).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    s = s.withColumns({"_caps": F.sum("_cap").over(order), "_weights": F.sum("weight").over(order), "_all": F.sum("weight").over(whole), "_total": F.sum("source_size").over(whole).cast("double")})
    full = F.col("_caps") + F.col("_ratio") * (F.col("_all") - F.col("_weights")) <= F.col("_total")
    s = s.withColumns({"_full": full}).withColumns(
        {"_used": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole), "_left": F.sum(F.when(F.col("_full"), F.lit(0.0)).otherwise(F.col("weight"))).over(whole)}
    )
    level = (F.col("_total") - F.col("_used")) / F.col("_left")
    return s.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * level)).select(*sources.columns, "target")


def sainte_lague(parties: DataFrame, votes: str, seats, by: list[str], ties: list[str], out: str) -> DataFrame:
    """Adds out: the seats that each party gets by highest quotients votes / (2 k + 1), within each group of by.

    seats: column with the group's seats. Only quotients near a party's share can be the deciding ones: for S parties and Q
    seats a party's seats differ from its share x by at most x S / (2 Q) + 1, so a few rows a party are ranked. Ties go by the
    columns in ties. Parties without votes get none."""
    group = Window.partitionBy(*by)
    p = parties.withColumn("_seats", seats.cast("long")).withColumns({"_v": F.sum(votes).over(group), "_s": F.count(F.lit(1)).over(group)})
    share = F.when(F.col("_v") > 0, F.col("_seats") * F.col(votes) / F.col("_v")).otherwise(0.0)
    p = p.withColumn("_x", share).withColumn("_c", F.ceil(F.col("_x") * F.col("_s") / (2 * F.greatest(F.col("_seats"), F.lit(1)))) + 1)
    p = p.withColumns({"_low": F.greatest(F.lit(0).cast("long"), F.floor("_x") - F.col("_c")), "_high": F.floor("_x") + F.col("_c") + 1})
    p = p.withColumn("_open", F.col("_seats") - F.sum("_low").over(group))
    keys = list(dict.fromkeys(by + ties))
    tried = p.where(F.col(votes) > 0).select(*keys, "_open", votes, F.explode(F.sequence("_low", "_high")).alias("_k")).withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    rank = Window.partitionBy(*by).orderBy(F.col("_q").desc(), *ties)
    won = tried.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= F.col("_open")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    on = None
    w = won.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_won")
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_w_{k}"))
        on = same if on is None else on & same
    return p.join(w, on, "left").withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0).cast("long"))).select(*parties.columns, out)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=source_weights, max_repeat: int = 3, shards: int = 8, seed: int = 0) -> DataFrame:
    """One row per group of documents of equal id, source and size: id, source, size, docs, source_size, target, shard, epochs (how often each
    of its documents is taken) and more (how many of them are taken once more)."""
    assert BINS % shards == 0 and 1 <= max_repeat
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), _size(text_col).alias("size"))
    rows = rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("docs")).withColumns({"h": F.xxhash64(F.lit(seed), "id", "size"), "words": F.col("size") * F.col("docs")})
    rows = B.stored(rows.withColumn("bin", F.pmod(F.col("h"), F.lit(BINS)).cast("int")), "sizes")
    bins = B.stored(rows.groupBy("source", "bin").agg(F.sum("words").alias("bin_size")), "bins")
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    # The table of sources has a row a source; all windows without a key run over it alone.
    plan = B.stored(targets(weights(sources), max_repeat), "targets")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    block = max(MIN_BLOCK, total // RESOLUTION)
    plan = sainte_lague(plan.withColumn("_whole", F.lit(0)), "target", F.lit(round(total / block)), ["_whole"], ["source"], "quota").drop("_whole")
    shard = F.pmod(F.col("bin"), F.lit(shards)).cast("int")
    streams = bins.withColumn("shard", shard).groupBy("source", "shard").agg(F.sum("bin_size").alias("stream_size"))
    p = plan.withColumnRenamed("source", "_s")
    streams = streams.join(p, streams["source"].eqNullSafe(p["_s"])).drop("_s")
    streams = sainte_lague(streams, "stream_size", F.col("quota"), ["source"], ["source", "shard"], "take")
    wanted = F.least(F.col("take") * block, F.col("stream_size") * max_repeat)
    streams = streams.withColumn("epochs", F.when(F.col("stream_size") > 0, F.floor(wanted / F.col("stream_size"))).otherwise(F.lit(0).cast("long")))
    streams = B.stored(streams.withColumn("extra", wanted - F.col("epochs") * F.col("stream_size")), "streams")
    # Where each bin's documents begin in their stream: running sums over at most BINS / shards rows a stream.
    ahead = Window.partitionBy("source", "shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("shard", shard).withColumn("bin_at", F.coalesce(F.sum("bin_size").over(ahead), F.lit(0).cast("long")))
    st = streams.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "source_size", "target", "epochs", "extra")
    placed = B.stored(placed.join(st, placed["source"].eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h"), "placed")
    cuts = _cuts(rows, placed)
    placed = placed.join(cuts, placed["source"].eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")), "left").drop("_s", "_h")
    # Both sides are dealt by (source, bin), of which none holds more than a thousandth of a source's groups.
    told = _starts(rows, placed.withColumn("cut", F.coalesce("cut", "extra")))
    fit = F.floor((F.col("cut") - F.col("at")) / F.col("size"))
    more = F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), F.least("docs", fit))).otherwise(F.lit(0).cast("long"))
    return told.select("id", "source", "size", "docs", "source_size", "target", "shard", F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(0).cast("long")).alias("epochs"), more.alias("more"))


def _size(text_col: str):
    return F.regexp_count(B.text_of(text_col), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id_col, size, source, source_size, target, shard, taken (words that the mix takes, repeats counted), epochs. options: see decide."""
    told = B.stored(decide(docs, id_col, **options), "decided")
    parts = told.select("*", F.explode(F.array(F.struct(F.col("more").alias("n"), F.lit(1).alias("plus")), F.struct((F.col("docs") - F.col("more")).alias("n"), F.lit(0).alias("plus")))).alias("x")).where("x.n > 0")
    # A large group is written by many tasks, RUN documents at a time.
    runs = parts.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("x.n") - 1) / RUN))))
    if not told.where(F.col("docs") > RUN).isEmpty():
        runs = runs.repartition(F.xxhash64("id", "source", "size", "x", "run"))
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("x.n") - F.col("run") * RUN))))
    return each.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "shard", ((F.col("epochs") + F.col("x.plus")) * F.col("size")).alias("taken"), "epochs")


def _starts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """rows of the bins in placed, with placed's columns and at, where the group begins in its stream."""
    within = Window.partitionBy("source", "bin").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("at", F.coalesce(F.sum("words").over(within), F.lit(0).cast("long")))
    pl = placed.withColumnsRenamed({"source": "_s", "bin": "_b"})
    return own.join(pl, own["source"].eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b"))).drop("_s", "_b").withColumn("at", F.col("at") + F.col("bin_at"))


def _cuts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(_s, _h, cut): for each stream that takes part of a pass, where it ends: before or after the document in which its extra words end.

    From the largest such document on, the choice that keeps the source's sum closer to its quota is made, so a source misses by half
    of one of them at most. One bin a stream is read, one row a stream gathered."""
    ends = placed.where((F.col("extra") > 0) & (F.col("bin_at") <= F.col("extra")) & (F.col("extra") < F.col("bin_at") + F.col("bin_size")))
    b = ends.select(F.col("source").alias("_s"), F.col("bin").alias("_b"))
    few = rows.join(b, rows["source"].eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")), "left_semi")
    last = _starts(few, ends).where((F.col("at") <= F.col("extra")) & (F.col("extra") < F.col("at") + F.col("words")))
    last = last.withColumn("at", F.col("at") + F.floor((F.col("extra") - F.col("at")) / F.col("size")) * F.col("size"))  # the document within its group
    held = last.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("first"), "shard", "at", "size", "extra"))).alias("ends"))
    start = F.struct(F.lit(0).cast("long").alias("over"), F.array().cast("array<struct<shard:int,cut:bigint>>").alias("cuts"))

    def step(acc, x):
        without, within = acc["over"] + x["at"] - x["extra"], acc["over"] + x["at"] + x["size"] - x["extra"]
        less = F.abs(without) <= F.abs(within)
        cut = F.struct(x["shard"].alias("shard"), F.when(less, x["at"]).otherwise(x["at"] + x["size"]).alias("cut"))
        return F.struct(F.when(less, without).otherwise(within).alias("over"), F.concat(acc["cuts"], F.array(cut)).alias("cuts"))

    return held.select(F.col("source").alias("_s"), F.explode(F.aggregate("ends", start, step)["cuts"]).alias("c")).select("_s", F.col("c.shard").alias("_h"), F.col("c.cut").alias("cut"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them, each as often as decided, columns as they were.

    Rows are told by their identifier where all are there and unlike, else by source, identifier and size together. Of a group that is taken
    in part, at most one a source and shard, the rows are written once and counted off partition by partition."""
    told = B.stored(decide(docs, id_col, text_col, source_col, **options), "decided")
    own, source = F.col(id_col).cast("long"), F.col(source_col).cast("string")
    if told.groupBy("id").agg(F.sum("docs").alias("n")).where("n > 1 or id is null").isEmpty():
        key, named = own, F.col("id")
    else:
        known = lambda i, s, n: F.struct(i.isNull().alias("a"), F.coalesce(i, F.lit(0)).alias("b"), s.isNull().alias("c"), F.coalesce(s, F.lit("")).alias("d"), n.alias("e"))
        key, named = known(own, source, _size(text_col)), known(F.col("id"), F.col("source"), F.col("size"))
    index = told.select(named.alias("key"), "docs", "epochs", "more")
    total = told.agg(F.sum("docs")).first()[0] or 0
    rows = B.keyed(docs, key)
    if index.where(F.col("docs") > max(1, total // B.HOT_SHARE)).isEmpty():
        met = rows.join(index, "key")
    else:
        met = B.lookup(rows, index, "key", "docs", total, "inner")
    split = (F.col("more") > 0) & (F.col("more") < F.col("docs"))
    out = met.where(~split).select("row", (F.col("epochs") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("n"))
    if not index.where(split).isEmpty():
        some = B.stored(met.where(split).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "split")
        ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = some.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c")).select("key", "part", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"))
        rank = F.row_number().over(Window.partitionBy("key", "part").orderBy("at")) + F.col("before")
        out = out.unionByName(some.join(before, ["key", "part"]).select("row", (F.col("epochs") + F.when(rank <= F.col("more"), 1).otherwise(0)).alias("n")))
    return out.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")
