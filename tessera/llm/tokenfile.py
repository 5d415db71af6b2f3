"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of many documents, one after another, in blocks of BLOCK ids. A block stores its smallest id, the other
ids less that one in a width that a percentile of them fits in, and an exception list (positions, high bits) of the rest. A
document table and an index of block starts follow, so that a reader finds any document without decoding others.

    magic | blocks | document ids (int64) | null flags (u8) | ids per document (u64) | block starts (u64) | footer
    block: smallest u32, width u8, exceptions u8, ids u16 | packed ids | positions u8 | high bits u32
    footer: number of documents, blocks, ids, offset of the document table (4 x u64), magic

Cases: a null text counts as empty and holds the end id only; null identifiers come after all others; rows with equal
identifiers stand in order of their text's hash; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401  (pa.fs)
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import tokens

MAGIC = b"TESSPFR1"
BLOCK = 256
#: The share of a block's ids that the packed width must hold.
PERCENTILE = 0.9
#: Segments that a worker remembers here: it holds little else.
CACHE = 1_000_000
#: Blocks that are encoded or decoded at once.
BATCH = 4096


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The encoded blocks of ids (uint32; only the last block may be short) and the blocks' starts therein."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.uint64)
    k = -(-n // BLOCK)
    full = np.zeros(k * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[n - n % BLOCK :].min() if n % BLOCK else 0
    full = full.reshape(k, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    chosen = np.partition(rest, int(np.ceil(percentile * BLOCK)) - 1, axis=1)[:, int(np.ceil(percentile * BLOCK)) - 1]
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.int64)
    over = (rest >> width[:, None].astype(np.uint64)) > 0
    extra = over.sum(axis=1)
    sizes = 8 + width * (BLOCK // 8) + 5 * extra
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    count = np.full(k, BLOCK, np.uint16)
    count[-1] = n - (k - 1) * BLOCK
    head = np.zeros(k, np.dtype([("least", "<u4"), ("width", "u1"), ("extra", "u1"), ("count", "<u2")]))
    head["least"], head["width"], head["extra"], head["count"] = least, width, extra, count
    out[starts[:, None] + np.arange(8)] = head.view(np.uint8).reshape(k, 8)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            room = 2 if w <= 16 else 4  # bytes that the width fits in
            bits = np.unpackbits(np.ascontiguousarray(rest[at].astype(f"<u{room}")).view(np.uint8).reshape(len(at), BLOCK, room), axis=2, bitorder="little")[:, :, :w]
            out[(starts[at] + 8)[:, None] + np.arange(w * BLOCK // 8)] = np.packbits(np.ascontiguousarray(bits).reshape(len(at), -1), axis=1, bitorder="little")
    b, p = np.nonzero(over)
    if len(b):
        rank = np.arange(len(b)) - (np.cumsum(extra) - extra)[b]
        base = starts[b] + 8 + width[b] * (BLOCK // 8)
        out[base + rank] = p
        high = (rest[b, p] >> width[b].astype(np.uint64)).astype("<u4")
        out[(base + extra[b] + 4 * rank)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype(np.uint64)


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at starts in data."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    starts = starts.astype(np.int64)
    head = np.ascontiguousarray(raw[starts[:, None] + np.arange(8)]).view(np.dtype([("least", "<u4"), ("width", "u1"), ("extra", "u1"), ("count", "<u2")])).ravel()
    width, extra = head["width"].astype(np.int64), head["extra"].astype(np.int64)
    rest = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            packed = raw[(starts[at] + 8)[:, None] + np.arange(w * BLOCK // 8)]
            bits = np.zeros((len(at), BLOCK, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
            rest[at] = np.packbits(bits, axis=2, bitorder="little").reshape(len(at), -1).view("<u4")
    b = np.repeat(np.arange(len(starts)), extra)
    if len(b):
        rank = np.arange(len(b)) - (np.cumsum(extra) - extra)[b]
        base = starts[b] + 8 + width[b] * (BLOCK // 8)
        high = np.ascontiguousarray(raw[(base + extra[b] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        rest[b, raw[base + rank]] |= high << width[b].astype(np.uint32)
    full = (rest + head["least"][:, None]).ravel()
    if (head["count"] < BLOCK).any():
        return full[(np.arange(BLOCK)[None, :] < head["count"][:, None]).ravel()]
    return full


class Writer:
    """Writes one file; ids come document by document in any number of add() calls."""

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        self.sink.write(MAGIC)
        self.buffer: list[np.ndarray] = []
        self.held = self.total = 0
        self.ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(doc_ids.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.counts.append(counts.astype("<u8"))
        self.buffer.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK * BATCH:
            every = np.concatenate(self.buffer)
            cut = len(every) // (BLOCK * BATCH) * (BLOCK * BATCH)
            for k in range(0, cut, BLOCK * BATCH):
                self._flush(every[k : k + BLOCK * BATCH])
            self.buffer, self.held = [every[cut:]], len(every) - cut

    def _flush(self, ids: np.ndarray) -> None:
        data, starts = encode_blocks(ids)
        self.sink.write(data)
        self.starts.append(starts + np.uint64(self.at))
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.buffer))
        docs = sum(map(len, self.ids))
        for part in (self.ids, self.nulls, self.counts, [s.astype("<u8") for s in self.starts]):
            for x in part:
                self.sink.write(x.tobytes())
        self.sink.write(struct.pack("<4Q", docs, sum(map(len, self.starts)), self.total, self.at) + MAGIC)
        self.sink.close()


class Reader:
    """Reads a file by ranges; source: a seekable file with size()."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - 40)
        foot = source.read(40)
        if foot[32:] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_blocks, self.n_ids, self.table = struct.unpack("<4Q", foot[:32])
        source.seek(self.table)
        self.doc_ids = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(source.read(self.n_docs), np.uint8)
        self.counts = np.frombuffer(source.read(8 * self.n_docs), "<u8").astype(np.int64)
        self.starts = np.frombuffer(source.read(8 * self.n_blocks), "<u8").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def blocks(self, a: int, b: int) -> np.ndarray:
        """Ids of blocks a to b, b excluded."""
        if a >= b:
            return np.zeros(0, np.uint32)
        end = self.starts[b] if b < self.n_blocks else self.table
        self.source.seek(int(self.starts[a]))
        return decode_blocks(self.source.read(int(end - self.starts[a])), self.starts[a:b] - self.starts[a])

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by way of the block index."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        got = self.blocks(a // BLOCK, -(-b // BLOCK))
        return got[a - a // BLOCK * BLOCK : b - a // BLOCK * BLOCK]

    def each(self):
        """(k, ids) of every document in order, holding a batch of blocks and one document at a time."""
        held, k, at = np.zeros(0, np.uint32), 0, 0
        while k < self.n_docs:
            need = int(self.counts[k])
            parts = [held]
            have = len(held)
            while have < need:
                parts.append(self.blocks(at, min(at + BATCH, self.n_blocks)))
                have += len(parts[-1])
                at += BATCH
            held = np.concatenate(parts) if len(parts) > 1 else held
            done = 0
            while k < self.n_docs and done + int(self.counts[k]) <= len(held):
                yield k, held[done : done + int(self.counts[k])]
                done += int(self.counts[k])
                k += 1
            held = held[done:]


def open_out(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def open_in(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) range-dealt and sorted by identifier; ties, even of equal rows, are spread and ordered by text hash and row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), B.text_of(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    keys = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("row")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")


def write_files(docs: DataFrame, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 0) -> DataFrame:
    """Write docs as token files into the folder uri (None: a new one in the shared folder), one per range of identifiers.

    Returns the manifest (part, path, docs, ids), part ascending with the identifiers. A task writes under a name of its
    own, and only the files of tasks that succeeded are in the manifest, so lost executors and repeated tasks do no harm."""
    uri = uri or B.new_path(docs.sparkSession, "token-files")

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        path, out, n, total = f"{uri}/part-{part:06d}-{attempt}.pfor", None, 0, 0
        encoder = tokens.encoder(vocabulary, CACHE)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or Writer(open_out(path))
            texts, ids = batch.column("text"), batch.column("id")
            for a, b in tokens.slices(texts, 8_000_000):
                got, counts = tokens.with_end(*encoder.encode(texts.slice(a, b - a)), end)
                own = ids.slice(a, b - a)
                out.add(own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), got, counts)
                n, total = n + b - a, total + len(got)
            tokens.give_back()
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [n], "ids": [total]})
        tokens.give_back()

    with B.small_batches(docs.sparkSession):
        return B.stored(ordered(docs, id_col, text_col).mapInArrow(write, "part long, path string, docs long, ids long"), "manifest")


def read_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id_col, start (ids before it in all files), n_tokens, ids_crc32."""
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                r = Reader(open_in(path))
                crcs = np.zeros(r.n_docs, np.int64)
                for k, ids in r.each():
                    crcs[k] = zlib.crc32(ids.astype("<u4").tobytes())
                for a in range(0, r.n_docs, 10_000):
                    z = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_ids[z], mask=r.nulls[z].astype(bool)), pa.array(base + r.first[:-1][z]), pa.array(r.counts[z]), pa.array(crcs[z])], ["id", "start", "n_tokens", "ids_crc32"]
                    )

    spread = max(1, manifest.count())  # a file is read by one task
    return based.select("path", "base").repartition(spread).mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
