"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

An n-gram is ORDER UTF-16 units, which one long holds exactly; nothing is folded, so scripts, capitals and marks stay apart and
all tables grow with the text. Counts come from the trusted texts that are not held out. Three steps, none of which brings more
than a few numbers to the driver:

1. Counts, continuation counts, discounts, context totals and probabilities of each order are joins and sums of count tables
   dealt by n-gram or context.
2. Documents become postings: for each block of documents and each shard of n-grams, which n-grams stand how often in which
   document. The distinct n-grams of all postings are joined with the count tables, order by order, so each gets its
   interpolated probability, seen in training or not.
3. Postings meet the probabilities of their shard and give each document's log probability within that shard; the shards' sums
   are added up by block. Blocks are of bounded size, and a shard's probabilities are repeated for so many groups of blocks that no
   task grows with the corpus.

A document's perplexity is the exponential of its mean. Held-out trusted documents, a fixed share of identifiers, give the quantile of
perplexity by language; a document above its language's is rejected.

Cases: a null or empty text has null perplexity and is kept; a null or unseen language takes the limit over all languages; so
does one of fewer than LEAST_HELD held-out texts; without trusted text every document is kept; short texts are pulled towards their
language's median by PRIOR symbols; rows that repeat get equal results; null identifiers are scored and kept or rejected by their text,
but are never trusted; an empty table gives an empty result; other columns are ignored, whatever their names (keep_good passes
them through).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import tokens

ORDER, UNIT = 4, 16
#: One in HELD trusted documents is held out for the quantiles.
HELD = 5
#: The limit of log perplexity is this quantile of held-out text; languages with fewer than LEAST_HELD texts take the limit over all.
HIGH, LEAST_HELD = 0.99, 100
PRIOR = 60
#: Log probabilities are counted in steps of 1 / GRID for the quantiles.
GRID = 1000
#: N-grams are dealt to shards by a hash of FINE values: so many that a shard has about SHARD_GRAMS distinct ones (16 bytes each, held and sorted by a
#: worker), but LEAST_SHARDS at least. A group of blocks has about GROUP bytes of text for each shard, but at least COPIES times as many as the
#: shard's probabilities, which are repeated for every group: so they never move more bytes than a part of the postings.
FINE, SHARD_GRAMS, LEAST_SHARDS, GROUP, COPIES = 1 << 16, 1_000_000, 32, 4 << 20, 4
#: A block holds about BLOCK bytes of text, at most ROWS documents; a longer document is a block of its own, sorted PIECE symbols at a time.
BLOCK, ROWS, PIECE = 4_000_000, 8192, 1 << 22
#: Rows of a packed table of probabilities.
PACKED = 20_000


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of the texts, each after ORDER - 1 line ends, and the ends of the texts therein."""
    pad = "\n" * (ORDER - 1)
    unit = np.frombuffer((pad + pad.join(texts)).encode("utf-16-le", "surrogatepass"), np.uint16) if texts else np.zeros(0, np.uint16)
    return unit, np.cumsum([len(t.encode("utf-16-le", "surrogatepass")) // 2 + ORDER - 1 for t in texts])


def grams(unit: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each unit; the first ORDER - 1 units have none."""
    n = max(0, len(unit) - ORDER + 1)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(UNIT)) | unit[k : k + n]
    return out


def own_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts one after another, one for each unit of a text, and the number of each text's."""
    unit, ends = units(texts)
    g, sizes = grams(unit), np.diff(ends, prepend=0) - (ORDER - 1)
    if not len(g):
        return g, sizes
    inside = np.ones(len(g), bool)
    starts = ends - sizes - (ORDER - 1)
    for k in range(1, ORDER):  # n-grams that end in the line ends before a text
        at = starts[1:] - k
        inside[at[at >= 0]] = False
    return g[inside], sizes


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) of all texts (column text); a task sends an n-gram once for each slice of its texts, and once after Spark's own partial sums."""

    def run(batches):
        for batch in batches:
            for a, b in tokens.slices(batch.column("text")):
                g, n = np.unique(own_grams(batch.column("text").slice(a, b - a).to_pylist())[0], return_counts=True)
                for k in range(0, len(g), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(g[k : k + 50_000].view(np.int64)), pa.array(n[k : k + 50_000])], ["gram", "n"])
        tokens.give_back()

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(gram, k: int):
    """An n-gram of k units without its first one."""
    return gram.bitwiseAND(F.lit((1 << UNIT * (k - 1)) - 1).cast("long"))


def _discounts(levels: list[DataFrame]) -> list[tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of each table for counts 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    few = [own.where("n <= 4").groupBy("n").count().select(F.lit(k).alias("k"), "n", "count") for k, own in enumerate(levels)]
    n = {(r["k"], r["n"]): r["count"] for r in reduce(DataFrame.unionByName, few).collect()}  # four rows a table
    out = []
    for k in range(len(levels)):
        n1, n2, n3, n4 = (n.get((k, c), 0) for c in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            out.append(tuple(min(max(d, 0.05), c + 0.95) for c, d in enumerate(raw)))
        else:
            out.append((0.5, 1.0, 1.5))
    return out


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order, 1 first: (gram, p), the interpolated probability of each n-gram seen, and (context, back), the weight that a context
    gives to the lower order. Joins and sums of count tables only."""
    levels = [B.stored(counts, "grams")]
    for k in range(ORDER, 1, -1):  # continuation counts: in how many contexts a shorter n-gram occurs
        levels.insert(0, B.stored(levels[0].groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, (own, (d1, d2, d3)) in enumerate(zip(levels, _discounts(levels)), 1):
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = own.withColumns({"context": F.shiftrightunsigned("gram", UNIT), "cut": cut})
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("back"))
        rows = rows.join(contexts, "context")
        share = (F.col("n") - F.col("cut")) / F.col("total")
        if k == 1:
            rows = rows.withColumn("p", share + F.col("back") / (1 << UNIT))
        else:
            lower = out[-1][0].select(F.col("gram").alias("low"), F.col("p").alias("low_p"))
            rows = rows.withColumn("low", _suffix(F.col("gram"), k)).join(lower, "low").withColumn("p", share + F.col("back") * F.col("low_p"))
        out.append((B.stored(rows.select("gram", "p"), "kn"), contexts.select("context", "back")))
    return out


def smoothed(wanted: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """wanted (gram and other columns; one row an n-gram) with p: of those not seen, the context's weight times the lower order's p."""
    k = len(levels)
    if not k:
        return wanted.withColumn("p", F.lit(1.0 / (1 << UNIT)))
    own, contexts = levels[-1]
    got = B.stored(wanted.join(own, "gram", "left"), "wanted")
    lack = got.where(F.col("p").isNull()).drop("p").withColumns({"context": F.shiftrightunsigned("gram", UNIT), "low": _suffix(F.col("gram"), k)})
    lower = smoothed(lack.select(F.col("low").alias("gram")).distinct(), levels[:-1]).select(F.col("gram").alias("low"), F.col("p").alias("low_p"))
    backed = lack.join(contexts, "context", "left").join(lower, "low").withColumn("p", F.coalesce("back", F.lit(1.0)) * F.col("low_p"))
    return got.where(F.col("p").isNotNull()).unionByName(backed.select(*got.columns))


def fine_of(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(FINE)


def shard_of(g: np.ndarray, shards: int) -> np.ndarray:
    return (fine_of(g) * np.uint64(shards) // np.uint64(FINE)).astype(np.int32)


def shards_for(grams: int) -> int:
    return min(FINE, max(LEAST_SHARDS, -(-grams // SHARD_GRAMS)))


def _occurrences(unit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of n-gram and document with their numbers. doc: the document of the n-gram that begins at each unit but the last
    ORDER - 1, -1 for none, ascending otherwise. Units are renumbered densely, so that a pair mostly fits one word."""
    there = np.flatnonzero(np.bincount(unit, minlength=1 << UNIT))
    inside = doc >= 0
    own = doc[inside]
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits, first = max(1, int(len(there) - 1).bit_length()), int(own[0])
    room = 64 - ORDER * bits
    if int(own[-1]) - first >= 1 << room:  # many symbols: fewer documents at a time
        half = int(np.flatnonzero(doc >= (first + int(own[-1]) + 1) // 2)[0])
        return tuple(np.concatenate(x) for x in zip(_occurrences(unit[: half + ORDER - 1], doc[:half]), _occurrences(unit[half:], doc[half:])))
    code = np.zeros(1 << UNIT, np.uint16)
    code[there] = np.arange(len(there))
    small, key = code[unit], np.zeros(len(doc), np.uint64)
    for k in range(ORDER):
        np.left_shift(key, np.uint64(bits), out=key)
        np.bitwise_or(key, small[k : k + len(doc)], out=key)
    key = key[inside]
    if room:
        np.left_shift(key, np.uint64(room), out=key)
        np.bitwise_or(key, (own - first).astype(np.uint16), out=key)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, key = np.diff(np.append(at, len(key))), key[at]
    out, back = np.zeros(len(key), np.uint64), there.astype(np.uint64)
    for k in range(ORDER - 1, -1, -1):
        out = (out << np.uint64(UNIT)) | back[((key >> np.uint64(room + bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)]
    own = (key & np.uint64((1 << room) - 1)).astype(np.int64) if room else np.zeros(len(key), np.int64)
    return out, own + first, n


def _payloads(unit: np.ndarray, doc: np.ndarray, squeeze, shards: int) -> list[tuple[int, bytes]]:
    """(shard, postings): distinct n-grams, how many documents each has, those documents and how often each holds it."""
    gram, own, n = _occurrences(unit, doc)
    shard = shard_of(gram, shards)
    order = np.argsort(shard, kind="stable")
    gram, own, n, edge = gram[order], own[order].astype(np.uint16), n[order].astype(np.uint32), np.searchsorted(shard[order], np.arange(shards + 1))
    out = []
    for s, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        if a < b:
            at = np.flatnonzero(np.concatenate([[True], gram[a + 1 : b] != gram[a : b - 1]]))
            size = np.diff(np.append(at, b - a)).astype(np.uint16)
            few = n[a:b] < 255
            head = np.array([len(at), b - a, int((~few).sum())], np.uint32)
            parts = [head, np.diff(gram[a:b][at], prepend=np.uint64(0)), size, np.diff(own[a:b], prepend=np.uint16(0)), np.where(few, n[a:b], 255).astype(np.uint8), n[a:b][~few]]
            out.append((s, squeeze.compress(b"".join(p.tobytes() for p in parts))))
    return out


def _opened(packed: bytes, expand) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = expand.decompress(packed)
    k, m, large = np.frombuffer(raw, np.uint32, 3).tolist()
    at = 12
    gram = np.cumsum(np.frombuffer(raw, np.uint64, k, at), dtype=np.uint64)
    size = np.frombuffer(raw, np.uint16, k, at := at + 8 * k).astype(np.int64)
    own = np.cumsum(np.frombuffer(raw, np.uint16, m, at := at + 2 * k), dtype=np.uint16)
    n = np.frombuffer(raw, np.uint8, m, at := at + 2 * m).astype(np.uint32)
    n[n == 255] = np.frombuffer(raw, np.uint32, large, at + m)
    return gram, size, own, n


_INFO = {"doc": pa.int32(), "id": pa.int64(), "lang": pa.string(), "k1": pa.int64(), "k2": pa.int64(), "symbols": pa.int64(), "parts": pa.int32()}
_INFO_SQL = "doc int, id long, lang string, k1 long, k2 long, symbols long, parts int"


def _batch(names: list[str], kinds: dict, n: int, given: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(given[c], kinds[c]) if c in given else pa.nulls(n, kinds[c]) for c in names], names)


def postings(rows: DataFrame, shards: int) -> DataFrame:
    """rows (text, id, lang, k1, k2) as postings (shard, block, docs, payload) and one row a document (shard, block, doc, id, lang, k1, k2, symbols,
    parts), parts being the number of its block's postings. A block's number is a hash of its place and its documents, so postings and
    documents of unlike runs of a task never meet."""
    kinds = {"shard": pa.int32(), "block": pa.int64(), "docs": pa.int32(), "payload": pa.binary()} | _INFO
    names = list(kinds)

    def run(batches):
        squeeze, part, at = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in tokens.slices(batch.column("text"), BLOCK, ROWS):
                m = b - a
                unit, ends = units(batch.column("text").slice(a, m).to_pylist())
                sizes = np.diff(ends, prepend=0) - (ORDER - 1)
                doc = np.full(max(0, len(unit) - ORDER + 1), -1, np.int16)  # an n-gram begins ORDER - 1 units before the one it ends in
                for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                    doc[end - size - ORDER + 1 : end - ORDER + 1] = k
                own = {c: batch.column(c).slice(a, m) for c in ("id", "lang", "k1", "k2")}
                place = np.array([part, at], np.int64).tobytes() + b"".join(own[c].to_numpy(zero_copy_only=False).tobytes() for c in ("k1", "k2"))
                block = int(np.uint64(xxhash.xxh3_64_intdigest(place)).view(np.int64))
                told = [x for k in range(0, len(doc), PIECE) for x in _payloads(unit[k : k + PIECE + ORDER - 1], doc[k : k + PIECE], squeeze, shards)]
                yield _batch(names, kinds, m, own | {"shard": np.full(m, block % shards), "block": np.full(m, block), "doc": np.arange(m), "symbols": sizes, "parts": np.full(m, len(told))})
                yield _batch(names, kinds, len(told), {"shard": [s for s, _ in told], "block": [block] * len(told), "docs": [m] * len(told), "payload": [p for _, p in told]})
                at += 1
        tokens.give_back()

    return rows.select("text", "id", "lang", "k1", "k2").mapInArrow(run, "shard int, block long, docs int, payload binary, " + _INFO_SQL)


def _distinct_grams(rows: DataFrame) -> DataFrame:
    """(gram, fine) of all texts."""

    def run(batches):
        for batch in batches:
            for a, b in tokens.slices(batch.column("text"), BLOCK // 2):
                g = own_grams(batch.column("text").slice(a, b - a).to_pylist())[0]
                g = np.unique(np.concatenate([np.unique(g[k : k + PIECE]) for k in range(0, len(g), PIECE)])) if len(g) else g
                for k in range(0, len(g), 50_000):
                    part = g[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(fine_of(part).astype(np.int32))], ["gram", "fine"])
        tokens.give_back()

    return rows.select("text").mapInArrow(run, "gram long, fine int").distinct()


def _packed(scores: DataFrame) -> DataFrame:
    """(gram, shard, p) as rows of PACKED n-grams: (shard, grams, costs), costs -log p, sorted within a shard."""

    def run(batches):
        shard, held, size = None, [], 0

        def row():
            g, p = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([g.tobytes()], pa.binary()), pa.array([(-np.log(p)).astype(np.float64).tobytes()], pa.binary())], ["shard", "grams", "costs"])

        for batch in batches:
            s, g, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "gram", "p"))
            for part in np.split(np.arange(len(s)), np.flatnonzero(s[1:] != s[:-1]) + 1):
                if size and (s[part[0]] != shard or size >= PACKED):
                    yield row()
                    held, size = [], 0
                shard = int(s[part[0]])
                held.append((g[part], p[part]))
                size += len(part)
        if size:
            yield row()

    return scores.select("shard", "gram", "p").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, grams binary, costs binary")


def document_costs(rows: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(id, lang, k1, k2, symbols, nll) of every document: postings joined, shard by shard, with their n-grams' probabilities.

    Only rows' postings move, once: they are made twice as small as the texts by putting equal n-grams of a block together."""
    spark = rows.sparkSession
    with B.small_batches(spark):
        grams_ = B.stored(_distinct_grams(rows), "distinct")
        shards = shards_for(grams_.count())
        table = B.stored(_packed(smoothed(grams_.select("gram", F.floor(F.col("fine") * F.lit(shards).cast("long") / FINE).cast("int").alias("shard")), levels)), "scores")
    size = table.agg(F.sum(F.octet_length("grams") + F.octet_length("costs"))).first()[0] or 0
    groups = max(1, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max(shards * GROUP, COPIES * size))
    kinds = {"block": pa.int64(), "sums": pa.binary()} | _INFO
    names, info = list(kinds), list(_INFO)
    nothing = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _INFO_SQL.split(", ")]
    keys = table.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("tag"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("docs"), "grams", F.col("costs").alias("body"), *nothing)

    def add_up(batches):
        expand, at, grams_, costs, sorted_ = zstandard.ZstdDecompressor(), None, [], [], False
        for batch in batches:
            known = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                yield _batch(names, kinds, int(known.sum()), {c: batch.column(c).filter(pa.array(known)) for c in ["block", *info]})
                batch = batch.filter(pa.array(~known))
            out = []
            for shard, part, block, docs, g, body in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "block", "docs", "grams", "body"))):
                if (shard, part) != at:
                    at, grams_, costs, sorted_ = (shard, part), [], [], False
                if g is not None:
                    grams_.append(np.frombuffer(g, np.uint64))
                    costs.append(np.frombuffer(body, np.float64))
                    continue
                if not sorted_:
                    every, cost = np.concatenate(grams_), np.concatenate(costs)
                    order = np.argsort(every)
                    every, cost, sorted_ = every[order], cost[order], True
                gram, size, own, n = _opened(body, expand)
                each = np.repeat(cost[np.searchsorted(every, gram)], size) * n
                out.append((block, np.bincount(own, each, docs).astype(np.float32).tobytes()))
            if out:
                yield _batch(names, kinds, len(out), {"block": [x[0] for x in out], "sums": [x[1] for x in out]})
        tokens.give_back()

    with B.small_batches(spark, 1000):
        work = postings(rows, shards).select("shard", F.pmod("block", F.lit(groups)).cast("int").alias("part"), F.lit(1).alias("tag"), "block", "docs", F.lit(None).cast("binary").alias("grams"), F.col("payload").alias("body"), *info)
        both = keys.unionByName(work).repartition("shard", "part").sortWithinPartitions("shard", "part", "tag")
        sums = B.stored(both.mapInArrow(add_up, "block long, sums binary, " + _INFO_SQL), "sums")

    def gather(batches):
        at, total, met = None, None, 0
        own = ["id", "lang", "k1", "k2", "symbols"]
        for batch in batches:
            blocks, docs, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "doc", "parts"))
            nll, rows = np.zeros(len(docs)), np.flatnonzero(~np.isnan(docs.astype(float)))
            for k, block in enumerate(blocks.tolist()):
                if block != at:
                    at, total, met = block, None, 0
                if docs[k] != docs[k]:
                    part = np.frombuffer(batch.column("sums")[k].as_py(), np.float32).astype(np.float64)
                    total, met = part if total is None else total + part, met + 1
                elif met != parts[k]:
                    raise RuntimeError(f"a block has {met} of {parts[k]} postings: its task has run again over other rows")
                elif met:
                    nll[k] = total[int(docs[k])]
            if len(rows):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in own), pa.array(nll[rows])], [*own, "nll"])
        tokens.give_back()

    every = sums.repartition("block").sortWithinPartitions("block", F.col("doc").asc_nulls_first())
    with B.small_batches(spark):
        return B.stored(every.mapInArrow(gather, "id long, lang string, k1 long, k2 long, symbols long, nll double"), "costs")


def _medians(held: DataFrame) -> DataFrame:
    """(lang, all, mid) of nll / symbols on the grid; lang and all group by language and once over all (all = 1)."""
    cells = held.select("lang", F.floor(F.col("nll") / F.col("symbols") * GRID).cast("long").alias("cell")).groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n"))
    both = cells.select("lang", F.lit(0).alias("all"), "cell", "n").unionByName(cells.groupBy("cell").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(1).alias("all"), "cell", "n"))
    return both.groupBy("lang", "all").agg((F.percentile("cell", F.lit(0.5), F.col("n")) / GRID).alias("mid"), F.sum("n").alias("n")).where((F.col("all") == 1) | (F.col("n") >= LEAST_HELD)).drop("n")


def limits(held: DataFrame) -> DataFrame | None:
    """(lang, all, mid, limit) from held-out documents (lang, symbols, nll): the quantile HIGH of the score that judged() holds against it."""
    held = held.where("symbols > 0")
    long = held.where(F.col("symbols") >= PRIOR)
    mids = B.stored(_medians(held if long.isEmpty() else long), "mids")
    if mids.isEmpty():
        return None
    own = mids.select(F.col("lang").alias("m_lang"), F.col("all").alias("m_all"), "mid")
    told = held.withColumn("all", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("lang", F.when(F.col("all") == 0, F.col("lang")))
    told = told.join(F.broadcast(own), told["lang"].eqNullSafe(F.col("m_lang")) & (F.col("all") == F.col("m_all")))
    cells = told.withColumn("cell", F.ceil(_score(F.col("mid")) * GRID).cast("long")).groupBy("lang", "all", "mid", "cell").agg(F.count(F.lit(1)).alias("n"))
    return B.stored(cells.groupBy("lang", "all", "mid").agg((F.percentile("cell", F.lit(HIGH), F.col("n")) / GRID).alias("limit")), "limits")


def _score(mid):
    return (F.col("nll") + PRIOR * mid) / (F.col("symbols") + PRIOR)


def judged(costs: DataFrame, own: DataFrame | None) -> DataFrame:
    """costs with perplexity, limit and keep."""
    if own is None:
        got = costs.withColumns({c: F.lit(None).cast("double") for c in ("mid", "limit")})
    else:
        one = own.where(F.col("all") == 1).first()  # one row
        got = B.with_dim(costs, own.where((F.col("all") == 0) & F.col("lang").isNotNull()).select("lang", "mid", "limit"), "lang")
        got = got.withColumns({c: F.coalesce(c, F.lit(one[c])) for c in ("mid", "limit")})
    empty = F.col("symbols") == 0
    keep = empty | F.coalesce(_score(F.col("mid")) <= F.col("limit"), F.lit(True))
    return got.withColumns({"perplexity": F.when(~empty, F.exp(F.col("nll") / F.col("symbols"))), "keep": keep, "limit": F.exp("limit")}).drop("mid")


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trusted="quality = 1 and toxic = 0") -> DataFrame:
    """(id, lang, k1, k2, symbols, nll, perplexity, limit, keep), one row per document; k1 and k2 are hashes of what decides, language and text.

    The model is trained on the documents that labels call trusted and that are not held out; of their texts only those that pass a
    bounded filter are shuffled."""
    ids = labels.where(trusted).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    ids = ids.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(HELD)) == 0)
    lang, text = F.col(lang_col).cast("string"), B.text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), text.alias("text"), *_keys(lang, text))
    levels = kneser_ney(gram_counts(B.semi_rows(rows.select("id", "text"), F.col("id"), ids.where("not held").select(F.col("id").alias("key")))))
    costs = document_costs(rows, levels)
    return judged(costs, limits(costs.join(ids.where("held").select("id"), "id", "left_semi")))


def _keys(lang, text) -> list:
    return [F.xxhash64(F.lit(k), lang, text).alias(f"k{k}") for k in (1, 2)]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id_col, perplexity, limit, keep."""
    got = scored(docs, labels, id_col, text_col, lang_col)
    return got.select(F.col("id").alias(id_col), "perplexity", "limit", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rejected documents, columns as they were. Rejected are known by the hashes of language and text, and only
    rows that a bounded filter takes for rejected are shuffled."""
    bad = scored(docs, labels, id_col, text_col, lang_col).where("not keep").select(F.struct("k1", "k2").alias("key"))
    return B.anti_rows(docs, F.struct(*_keys(F.col(lang_col).cast("string"), B.text_of(text_col))), B.stored(bad.distinct(), "rejected"))
