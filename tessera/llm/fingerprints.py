"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes proposes cut points: a rare condition before the normal chunk size, a frequent one after it
(normalised chunking), so sizes gather around the normal one and an insertion moves only the chunks that it touches. A
fingerprint is the set of chunk digests, each with its chunk's length; shared length over the smaller total measures containment.

Cases: a null text counts as empty, whose fingerprint is the empty string; two empty fingerprints have likeness 1, an empty
and another one 0; equal texts have equal fingerprints; in neighbour comparison, rows with equal identifiers follow in order of
their text's hash, null identifiers come last, and a single row is its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import tokens

LEAST, NORMAL, MOST = 16, 48, 192
#: Bits that must be zero before and after the normal size.
STRICT, LOOSE = 7, 4
WINDOW = 32
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte, sum of GEAR[byte k back] << k over WINDOW bytes, by doubling."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)  # the right side is formed before the sum is
        step *= 2
    return h


def chunk_edges(texts: list[bytes]) -> list[list[int]]:
    """For each text the ends of its chunks. Texts are hashed together, with zeros between, so cuts depend on a text alone."""
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    top = gear_hashes(data) >> np.uint32(32 - STRICT)
    loose = np.flatnonzero((top >> np.uint32(STRICT - LOOSE)) == 0)
    strict = loose[top[loose] == 0].tolist()
    loose = loose.tolist()
    out, at, i, j = [], WINDOW, 0, 0
    for t in texts:
        start, end, edges = at, at + len(t), []
        while start < end:
            if end - start <= LEAST:
                cut = end
            else:
                i = bisect_left(strict, start + LEAST - 1, i)
                if i < len(strict) and strict[i] < min(start + NORMAL, end):
                    cut = strict[i] + 1
                else:
                    j = bisect_left(loose, start + NORMAL - 1, j)
                    cut = min(loose[j] + 1 if j < len(loose) else end, start + MOST, end)
            edges.append(cut - at)
            start = cut
        out.append(edges)
        at = end + WINDOW
    return out


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct numbers digest << 8 | length of its chunks, the digest of 48 bits."""
    digest, out = xxhash.xxh3_64_intdigest, []
    for t, edges in zip(texts, chunk_edges(texts)):
        start, own = 0, set()
        for end in edges:
            own.add((digest(t[start:end]) & 0xFFFFFFFFFFFF) << 8 | (end - start))
            start = end
        out.append(np.array(sorted(own), np.uint64))
    return out


def to_text(fingerprint: np.ndarray) -> str:
    """14 hex digits a chunk: digest, length."""
    return fingerprint.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 7)
    return np.concatenate([np.zeros((len(raw), 1), np.uint8), raw], axis=1).view(">u8").ravel().astype(np.uint64)


def _weight(f: np.ndarray) -> int:
    return int((f & np.uint64(255)).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the shared chunks over that of the smaller set: 1 if one text's chunks are contained in the other's."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return _weight(np.intersect1d(a, b, assume_unique=True)) / min(_weight(a), _weight(b))


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_chars, fingerprint, without a shuffle."""

    def run(batches):
        for batch in batches:
            for a, b in tokens.slices(batch.column("text"), 2_000_000):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_text(f) for f in fingerprints([t.encode() for t in texts])])], ["id", "n_chars", "fingerprint"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), B.text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- each document and its neighbour by identifier

_LAST = -(1 << 63)


def _bucket(order, bounds: list[int]):
    """How many of the ascending bounds are at most order: a binary search in an array literal."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.lit(bounds)
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda lo, step: F.when((lo + step <= len(bounds)) & (F.element_at(table, F.least(lo + step, F.lit(len(bounds)))) <= order), lo + step).otherwise(lo),
    )


def with_neighbour(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, follower, order, tie, id, text) dealt by ranges of the identifier. The first row of a range also stands in the
    range above it as its follower, and that of the highest in the lowest: there it ends the range in descending order.

    The texts are shuffled once. Bounds and first rows are numbers, one a range, that the driver holds."""
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    ids = docs.select(order.alias("o"))
    share = [k / parts for k in range(1, parts)]
    bounds = sorted(set(ids.agg(F.percentile_approx("o", share, 10 * parts).alias("b")).first()["b"] or []))
    bucket = _bucket(F.col("o"), bounds)
    heads = {r["b"]: r["m"] for r in ids.select(bucket.alias("b"), "o").groupBy("b").agg(F.max("o").alias("m")).collect()}
    there = sorted(heads)
    above = {b: there[(k + 1) % len(there)] for k, b in enumerate(there)}
    top = max(there, default=0)
    head_of = F.lit([heads.get(b, _LAST) for b in range(top + 1)])
    above_of = F.lit([above.get(b, 0) for b in range(top + 1)])
    rows = docs.select(order.alias("o"), F.col(id_col).cast("long").alias("id"), B.text_of(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "bucket": bucket})
    at = F.col("bucket") + 1
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("follower"))
    also = F.struct(F.element_at(above_of, at).cast("int").alias("bucket"), F.lit(1).alias("follower"))
    both = F.when(F.element_at(head_of, at) == F.col("o"), F.array(own, also)).otherwise(F.array(own))
    dealt = rows.withColumn("to", F.explode(both)).select(F.col("to.bucket").alias("bucket"), F.col("to.follower").alias("follower"), "o", "tie", "id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "follower", F.col("o").desc(), "tie")


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by as many first ones of the next document by
    descending identifier (after the last: the first)."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(rows, follow):
        """rows: (bucket, follower, id, text); follow: the row after them."""
        texts = [r[3] for r in rows]
        edited = []
        for t, nxt in zip(texts, [*texts[1:], follow[3]]):
            k = len(t) // 3
            edited.append((t[: len(t) - k] + nxt[:k]).encode())
        n = len(texts)
        prints = fingerprints([t.encode() for t in texts] + [follow[3].encode()])
        changed = fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array([to_text(f) for f in prints[:n]]),
                pa.array([to_text(f) for f in changed]),
                pa.array([likeness(a, b) for a, b in zip(prints, changed)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
            ],
            names,
        )

    def run(batches):
        held, size, closed = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "follower", "id", "text"))):
                if closed == row[0]:  # further rows that share the first follower's identifier
                    continue
                if row[1]:
                    if held:
                        yield work(held, row)
                    held, size, closed = [], 0, row[0]
                    continue
                if size >= 2_000_000:
                    yield work(held, row)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        assert not held, "a range without a follower"
        tokens.give_back()

    return with_neighbour(docs, id_col, text_col).select("bucket", "follower", "id", "text").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
