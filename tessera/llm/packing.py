"""Packing along a space-filling curve.

A document's hashed token counts are projected to few dimensions; its Hilbert key orders documents so that like ones are
neighbours. Documents are range-dealt and sorted by key, and their ids fill sequences one after another along the curve.

Cases: a null text counts as empty and has the end id only; null identifiers are kept; equal texts have equal keys and are
spread over ranges by identifier and row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import tokens

BUCKETS, DIMS, BITS = 512, 3, 16
#: A row carries at most this many ids, so that long documents, neighbours on the curve, do not make a range heavier than others.
CHUNK = 4096
SEQUENCE = 1024


def hilbert_key(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates below 2 ** bits (Skilling's transposed form, all rows at once)."""
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(buckets: int = BUCKETS, dims: int = DIMS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims))


def curve_keys(ids: np.ndarray, counts: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given by their ids one after another."""
    n, buckets = len(counts), len(projection)
    bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
    v = np.sqrt(np.bincount(np.repeat(np.arange(n), counts) * buckets + bucket, minlength=n * buckets).reshape(n, buckets))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    unit = 0.5 + 0.5 * np.tanh(v @ projection)
    return hilbert_key(np.minimum(unit * (1 << BITS), (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 0, cache: int = tokens.CACHE, slice_bytes: int = 8_000_000, keep: bool = True) -> DataFrame:
    """(id, key, n, start, ids): each document's ids with the end id, 16 bit and compressed, CHUNK at most a row from start on, its number of ids and
    its Hilbert key. Written once into the shared folder."""

    def run(batches):
        import zstandard

        encoder, projection, squeeze = tokens.encoder(vocabulary, cache), _projection(), zstandard.ZstdCompressor(level=1)
        width = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            texts, own = batch.column("text"), batch.column("id")
            for a, b in tokens.slices(texts, slice_bytes):
                ids, counts = tokens.with_end(*encoder.encode(texts.slice(a, b - a)), end)
                keys = curve_keys(ids, counts, projection)
                small, edge = ids.astype(width), np.concatenate([[0], np.cumsum(counts)])
                rows = -(-counts // CHUNK)
                of = np.repeat(np.arange(b - a), rows)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)) * CHUNK
                packed = [squeeze.compress(small[edge[k] + at : min(edge[k] + at + CHUNK, edge[k + 1])].tobytes()) for k, at in zip(of, start)]
                yield pa.RecordBatch.from_arrays([own.slice(a, b - a).take(pa.array(of)), pa.array(keys[of]), pa.array(counts[of]), pa.array(start), pa.array(packed, pa.binary())], ["id", "key", "n", "start", "ids"])
            tokens.give_back()
        if not keep:
            tokens.forget()
            tokens.give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), B.text_of(text_col).alias("text"))
    with B.small_batches(docs.sparkSession):
        return B.stored(rows.mapInArrow(run, "id long, key long, n long, start long, ids binary"), "tokens")


def tail_cuts(n: int) -> list[int]:
    """Lengths that the last n ids of a range are cut to: powers of two, which need no padding."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, vocabulary: str | None = None, end: int = 0, with_ids: bool = False, cache: int = tokens.CACHE, slice_bytes: int = 8_000_000, keep: bool = True) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, key, and ids (array<int>) if with_ids.

    A range fills sequences of length ids one after another; only its last ids are cut to powers of two. Ranges number their
    sequences apart (range << 40), so no task waits for another's totals. Speed against memory of workers: cache, the segments that
    one remembers; slice_bytes, the text that it encodes at once; keep, whether it holds the vocabulary after the task."""
    made = tokenized(docs, id_col, text_col, vocabulary, end, cache, slice_bytes, keep).withColumn("row", F.monotonically_increasing_id())
    keys = ["key", "id", "start", "row"]
    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, key long" + ", ids array<int>" * with_ids

    def run(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        base, sequence, offset = TaskContext.get().partitionId() << 40, 0, 0
        tail: list = []  # pieces of the sequence that is not full yet: (id, start, ids, doc_tokens, key)
        out: list = []

        def rows():
            columns = list(zip(*out))
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]] + ([pa.array(columns[8], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

        def emit(pieces):
            nonlocal sequence
            at = 0
            for own, start, ids, whole, key in pieces:
                out.append((own, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, base + sequence, at, key, *([ids.astype(np.int32)] if with_ids else [])))
                at += len(ids)
            sequence += 1

        for batch in batches:
            for own, key, whole, start, packed in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "n", "start", "ids"))):
                raw = open_.decompress(packed)
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * min(CHUNK, whole - start) else "<u4")
                at = 0
                while at < len(ids):
                    take = min(length - offset, len(ids) - at)
                    tail.append((own, start + at, ids[at : at + take], whole, key))
                    at, offset = at + take, offset + take
                    if offset == length:
                        emit(tail)
                        tail, offset = [], 0
                if len(out) >= 10_000:
                    yield rows()
                    out = []
        for size in tail_cuts(offset):
            part, need = [], size
            while need:
                own, start, ids, whole, key = tail[0]
                part.append((own, start, ids[:need], whole, key))
                if len(ids) > need:
                    tail[0] = (own, start + need, ids[need:], whole, key)
                else:
                    tail.pop(0)
                need -= min(len(ids), need)
            emit(part)
        if out:
            yield rows()
        tokens.give_back()

    return made.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "key", "n", "start", "ids").mapInArrow(run, schema)
