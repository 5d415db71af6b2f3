"""The corpus pipeline: five stages from raw documents to packed sequences, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _base as B
from tessera.llm import exact_dedup, mixing, near_dedup, packing, quality


def _stage(work):
    """A stage begins where the one before has been written, so shared tables that earlier stages left are deleted then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        B.release("pipeline")
        before = B.marks()
        out = work(spark, docs, sf_dir)
        B.rescope(before, "pipeline")
        return out

    return run


def _quality(spark, docs, sf_dir):
    """Documents that the n-gram model rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark, docs, sf_dir):
    """Of equal texts one document stays."""
    return exact_dedup.drop_exact_copies(docs)


def _near(spark, docs, sf_dir):
    """Of each group of near copies one document stays."""
    return near_dedup.drop_near_copies(docs)


def _mix(spark, docs, sf_dir):
    """Documents stand as often as the mix takes them."""
    return mixing.apply_mix(docs)


def _pack(spark, docs, sf_dir):
    """Pieces of sequences of 1024 ids. Workers that other stages use too remember less and hold nothing afterwards."""
    return packing.pack(docs, cache=50_000, slice_bytes=3_000_000, keep=False)


STAGES = [("quality", _stage(_quality)), ("exact_dedup", _stage(_exact)), ("near_dedup", _stage(_near)), ("mixing", _stage(_mix)), ("packing", _stage(_pack))]

#: Hashes, tokenizers and the language model cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs, last = B.documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = B.new_path(spark, f"stage-{name}", "run")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            B.drop_tables(last)
        last = path
    return docs
