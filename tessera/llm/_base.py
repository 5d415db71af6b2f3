"""What the operators of this subpackage share: shared-folder tables, skew-safe joins and filters."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bloom

#: White space of the text contracts, as a Java/Python character class.
BLANK = r"[\x20\x09-\x0D]+"
#: A key that holds more than one part in HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: Dimension tables of at most this many rows are broadcast.
DIM_ROWS = 4096

_tables: list[tuple[SparkSession, str, str]] = []
atexit.register(lambda: release())


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one on a single machine (tests), an
    error on a cluster, whose machines could not share one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(set_dir)
        atexit.register(_drop_local, set_dir[7:])
    return set_dir.rstrip("/")


def _drop_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, name: str, scope: str = "op") -> str:
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _tables.append((spark, scope, path))
    return path


def stored(df: DataFrame, name: str, scope: str = "op") -> DataFrame:
    """Write df into the shared folder once and return the written table: lineage ends there and survives lost executors.

    A table stays until release() or the end of the driver process, since the caller's result may read it lazily."""
    path = new_path(df.sparkSession, name, scope)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2500):
    """Arrow batches of fewer rows for what is planned and run within: whole texts are long, and JVM and worker hold a batch each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(scope: str | None = None) -> None:
    """Delete the shared tables of a scope (None: all). Call it once what was derived from them has been written."""
    kept = []
    for spark, own, path in _tables:
        if scope not in (None, own):
            kept.append((spark, own, path))
            continue
        try:
            jvm = spark.sparkContext._jvm
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
        except Exception:  # the session has ended: its folder goes with it
            pass
    _tables[:] = kept


def marks() -> set[str]:
    """The shared tables there are now; see rescope."""
    return {path for _, _, path in _tables}


def rescope(before: set[str], scope: str) -> None:
    """Give the shared tables made since marks() returned before to a scope."""
    for k, (spark, own, path) in enumerate(_tables):
        if path not in before and own == "op":
            _tables[k] = (spark, scope, path)


def drop_tables(*paths: str) -> None:
    """Delete single tables by path as soon as nothing reads them."""
    for k, (spark, _, path) in enumerate(_tables):
        if path in paths:
            _tables[k] = (spark, "gone", path)
    release("gone")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text"):
    """The text column, a null text being the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def normalized(text):
    """Each run of white space replaced by one space."""
    return F.regexp_replace(text, BLANK, " ")


# ---------------------------------------------------------------- joins that hold up when one key has a third of the rows


def lookup(rows: DataFrame, index: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with index (one row a key; column size: how many rows have that key) without a hot partition.

    Keys with more than total / HOT_SHARE rows are fewer than HOT_SHARE, so their index rows are broadcast, a proven
    bound; any other key holds at most a thousandth of the rows, which an ordinary shuffled join takes."""
    limit = max(1, total // HOT_SHARE)
    hot = index.where(F.col(size) > limit)
    flags = hot.select(F.col(key), F.lit(True).alias("_hot"))
    tagged = rows.join(F.broadcast(flags), key, "left")
    one = tagged.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key, "inner")
    rest = tagged.where(F.col("_hot").isNull()).drop("_hot").join(index.where(F.col(size) <= limit), key, how)
    return one.unionByName(rest)


def with_dim(rows: DataFrame, dim: DataFrame, key: str, bound: int = DIM_ROWS) -> DataFrame:
    """Left join with a small table, one row a key (null-safe): broadcast when its counted rows are within bound, else shuffled with
    salted keys. dim should be cheap to count."""
    other = dim.withColumnRenamed(key, "_dim_key")
    if other.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(other), rows[key].eqNullSafe(F.col("_dim_key")), "left").drop("_dim_key")
    salts = 64
    left = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = other.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, left[key].eqNullSafe(F.col("_dim_key")) & (F.col("_salt") == F.col("_dim_salt")), "left").drop("_dim_key", "_salt", "_dim_salt")


def block_pairs(left: DataFrame, right: DataFrame, key: str, sizes: tuple[str, str], rows: tuple[str, str], width: int = 2000) -> DataFrame:
    """left joined with right (other columns named apart) on key, no task having more than about width rows of either side for a key.

    sizes: how many rows of left and of right have the key, columns of both; rows: a column that tells the rows of left and of right apart.
    The rows of a large key are dealt to blocks of width, and every block of the one side meets every block of the other under a key of its own."""
    blocks = [F.greatest(F.lit(1).cast("long"), F.ceil(F.col(c) / width)) for c in sizes]
    own = [F.pmod(F.xxhash64(c), n).cast("int") for c, n in zip(rows, blocks)]
    every = [F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))) for n in blocks]
    a = left.withColumn("block_a", own[0]).withColumn("block_b", every[1])
    b = right.withColumn("block_b", own[1]).withColumn("block_a", every[0]).drop(*sizes)
    return a.join(b, [key, "block_a", "block_b"]).drop("block_a", "block_b")


# ---------------------------------------------------------------- rows by their keys, moving few


def make_filter(keys: DataFrame, key) -> bloom.Filter:
    """A blocked Bloom filter sized by the counted keys; keys should be cheap to count."""
    return bloom.make(keys, key, keys.count())


def split_by_filter(rows: DataFrame, filt: bloom.Filter) -> tuple[DataFrame, DataFrame]:
    """rows (column key and others of the operator's own) in two: those whose key surely is not in the filter, and the others.

    Rows with texts are not moved for a filter that is too large to be broadcast: all of them may be in it then, and the exact join decides."""
    if filt.blocks > bloom.BROADCAST_BLOCKS:
        return rows.where(F.lit(False)), rows
    told = bloom.told(rows, F.col("key"), filt)
    return told.where(~F.col("f_maybe")).drop("f_maybe"), told.where("f_maybe").drop("f_maybe")


def keyed(rows: DataFrame, key) -> DataFrame:
    """(key, row): each row as one struct, so that no name of its columns can clash; select("row.*") gives it back."""
    return rows.select(key.alias("key"), F.struct("*").alias("row"))


def semi_rows(rows: DataFrame, key, ids: DataFrame) -> DataFrame:
    """rows, columns as they were, whose key is in ids (column key), moving only rows that pass the bounded filter, so texts of other rows are not shuffled."""
    maybe = split_by_filter(keyed(rows, key), make_filter(ids, F.col("key")))[1]
    return maybe.join(ids.select("key").distinct(), "key", "left_semi").select("row.*")


def anti_rows(rows: DataFrame, key, gone: DataFrame) -> DataFrame:
    """rows, columns as they were, whose key is not in gone (column key); only rows that pass the bounded filter are shuffled."""
    stay, maybe = split_by_filter(keyed(rows, key), make_filter(gone, F.col("key")))
    return stay.select("row.*").unionByName(maybe.join(gone.select("key").distinct(), "key", "left_anti").select("row.*"))
