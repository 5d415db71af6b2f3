"""Exact deduplication by a log-structured merge index, DataFrame functions only.

Rows are inserted batch by batch, at most MEMTABLE rows each. A batch is collected in memtables, the hash tables of its tasks' partial sums, and flushed as one run
of level 0: one row a digest (smallest identifier, count), sorted by digest, with a filter over its digests. An inserted batch probes the
filters of the runs already there, and what passes is looked up in the run. When FAN_IN runs stand on one level they are merged into one
of the next level; compact() merges what is left, of whatever levels. Merging keeps the smallest identifiers. Digests found again, in a
batch or in an older run, are hits: their texts are compared byte by byte before a copy may go.

Cases: a null text counts as empty; null identifiers sort after all others; of rows with equal text and equal identifier one
stays, the others are its copies (which one is not told apart in the decision columns, drop_exact_copies keeps one of them);
an empty table gives an empty result; other columns, whatever their names, pass through drop_exact_copies and do not take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import bloom

#: Runs of one level that are merged into one of the next.
FAN_IN = 2
#: A whole table is inserted in as many batches as it has times this many rows, but in BATCHES at least.
MEMTABLE, BATCHES = 1 << 28, 3


def _digest(norm):
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text with each run of white space replaced by one space."""
    return docs.select(F.col(id_col).cast("long").alias("id"), _digest(B.normalized(B.text_of(text_col))).alias("digest"))


class Run:
    """A sorted table (digest, keep_id, n), one row a digest, and its filter, both in the shared folder."""

    def __init__(self, path: str, level: int, rows: DataFrame, filt: bloom.Filter):
        self.path, self.level, self.rows, self.filter = path, level, rows, filt

    @classmethod
    def flush(cls, merged: DataFrame, level: int, scope: str) -> Run:
        spark = merged.sparkSession
        path = B.new_path(spark, f"run{level}", scope)
        merged.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).sortWithinPartitions("digest").write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        B.make_filter(rows, F.col("digest")).table.write.parquet(f"{path}/filter")
        return cls.open(spark, path, level)

    @classmethod
    def open(cls, spark: SparkSession, path: str, level: int) -> Run:
        rows = spark.read.parquet(f"{path}/rows")
        return cls(path, level, rows, bloom.Filter(spark.read.parquet(f"{path}/filter"), bloom.blocks_for(rows.count())))


class MergeIndex:
    """Runs by age, oldest first. insert() flushes and merges, find() looks digests up, compact() leaves one run, hits() are digests seen again.

    state() names the runs, from which a later session opens the index again; runs of a scope of their own outlive the operators' tables."""

    def __init__(self, scope: str = "op"):
        self.scope, self.runs, self.seen = scope, [], []

    def state(self) -> list[tuple[str, int]]:
        return [(r.path, r.level) for r in self.runs]

    @classmethod
    def open(cls, spark: SparkSession, state: list[tuple[str, int]], scope: str = "op") -> MergeIndex:
        lsm = cls(scope)
        lsm.runs = [Run.open(spark, path, level) for path, level in state]
        return lsm

    def find(self, rows: DataFrame) -> DataFrame:
        """(digest, keep_id, n) of those digests of rows that some run holds: each run is probed through its filter, then joined."""
        told = [B.split_by_filter(rows.select("digest", F.col("digest").alias("key")), r.filter)[1].select("digest").join(r.rows, "digest") for r in self.runs]
        return reduce(DataFrame.unionByName, told).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def insert(self, rows: DataFrame) -> None:
        """Flush rows (id, digest) as a run; note which of its digests are hits; merge levels that are full."""
        new = Run.flush(rows.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n")), 0, self.scope)
        again = new.rows.where(F.col("n") > 1).select("digest")
        self.seen.append(B.stored((again.unionByName(self.find(new.rows).select("digest")) if self.runs else again).distinct(), "hits", self.scope))
        self.runs.append(new)
        while len(own := [r for r in self.runs if r.level == self.runs[-1].level]) >= FAN_IN:
            self._merge(own)

    def _merge(self, runs: list[Run]) -> None:
        merged = Run.flush(reduce(DataFrame.unionByName, [r.rows for r in runs]), max(r.level for r in runs) + 1, self.scope)
        self.runs = [r for r in self.runs if r not in runs] + [merged]

    def compact(self) -> DataFrame:
        """The one run that is left when all are merged: smallest identifier and number of rows of each digest."""
        if len(self.runs) > 1:
            self._merge(self.runs)
        return self.runs[0].rows

    def hits(self) -> DataFrame:
        """(digest): digests of more than one row."""
        return reduce(DataFrame.unionByName, self.seen).distinct()


def build(rows: DataFrame, batches: int | None = None, scope: str = "op") -> MergeIndex:
    """An index of rows (id, digest), a stored table, inserted batch by batch."""
    lsm, batches = MergeIndex(scope), batches or max(BATCHES, -(-rows.count() // MEMTABLE))
    for k in range(batches):
        lsm.insert(rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(batches)) == k))
    return lsm


def _told(rows: DataFrame, lsm: MergeIndex) -> DataFrame:
    """rows (id, digest) with keep_id and n."""
    return B.lookup(rows, lsm.compact(), "digest", "n", rows.count())


def verify(docs: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of hits whose texts are not all the same bytes: (digest). Empty unless SHA-256 collides. told: rows of hits (id).

    Only texts whose identifier passes the filter of the hits' are normalised again. Within a digest the smallest and the largest text
    are compared; both are aggregated on the map side, so a group of any size sends one row a task."""
    rows = docs.select(F.col(id_col).cast("long").alias("key"), B.text_of(text_col).alias("text"))
    hits = B.split_by_filter(rows, B.make_filter(told, F.col("id")))[1].select(B.normalized(F.col("text")).alias("norm"))
    return hits.groupBy(_digest(F.col("norm")).alias("digest")).agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where(F.col("a") != F.col("b")).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256."""
    rows = B.stored(digests(docs, id_col, text_col), "digests")
    lsm = build(rows, batches)
    found = _told(rows, lsm)
    bad = B.stored(verify(docs, rows.join(lsm.hits(), "digest", "left_semi"), id_col, text_col), "unequal")
    if not bad.isEmpty():  # digests that collide: their rows are grouped by the text itself
        norm = docs.select(F.col(id_col).cast("long").alias("id"), B.normalized(B.text_of(text_col)).alias("norm")).withColumn("digest", _digest(F.col("norm")))
        odd = norm.join(bad, "digest", "left_semi")
        exact = odd.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        found = found.join(bad, "digest", "left_anti").unionByName(odd.join(exact, ["digest", "norm"]).drop("norm"))
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """docs without the copies, columns as they were.

    Copies are known by identifier, so texts are digested once. Rows without identifier, rows that share one and rows of colliding
    digests, usually none, are decided by their text instead."""
    rows = B.stored(digests(docs, id_col, text_col), "digests")
    lsm = build(rows, batches)
    told = B.stored(_told(rows, lsm), "told")
    repeated = told.where(F.col("n") > 1)
    bad = B.stored(verify(docs, repeated, id_col, text_col), "unequal")
    odd = told.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or id is null").select("id")
    odd = B.stored(odd.unionByName(told.join(bad, "digest", "left_semi").select("id")).distinct(), "odd")
    gone = B.stored(repeated.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("key")).distinct(), "copies")
    own = F.col(id_col).cast("long")
    if odd.isEmpty():
        return B.anti_rows(docs, own, gone)
    both = gone.unionByName(odd.select(F.col("id").alias("key")))
    left = B.anti_rows(docs.where(own.isNotNull()), own, both)
    other = docs.where(own.isNull()).unionByName(B.semi_rows(docs, own, odd.select(F.col("id").alias("key"))))
    other = other.select(own.alias("id"), B.normalized(B.text_of(text_col)).alias("norm"), F.struct("*").alias("row")).withColumn("digest", _digest(F.col("norm")))
    equal = other.join(bad, "digest", "left_semi")
    groups = equal.groupBy("norm").agg(F.min("id").alias("keep_id"))  # all rows of a colliding digest are here
    chosen = equal.join(groups, "norm").where(F.col("id").eqNullSafe(F.col("keep_id"))).select("norm", "row")
    plain = other.join(bad, "digest", "left_anti").select("digest", "id", "norm", "row")
    named = told.groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    first = B.lookup(plain, named, "digest", "n", told.count(), "inner").where(F.col("id").eqNullSafe(F.col("keep_id"))).select("norm", "row")
    return left.unionByName(first.unionByName(chosen).dropDuplicates(["norm"]).select("row.*"))
