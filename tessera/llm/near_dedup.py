"""MinHash near-deduplication with sequential Bayesian verification.

Documents are sets of word shingles. Equal sets are one class. Signatures of the classes are cut into bands; classes that share
a band's key are candidates. Candidates' signatures are compared batch by batch: after each batch a pair whose posterior
probability of reaching the threshold is below the chosen miss probability is pruned. Survivors are verified on their full sets.

Candidates within a bucket are not all paired. A bucket's members are compared with one pivot, the member that meets most others
over all bands, and links give labels by connected components. Two members x, y of a bucket that have unlike labels then share at
most min(|x & p|, |y & p|) shingles within the pivot p, so to link they must share so many of the rest, x - p and y - p. An index of
these rests, rarest shingles first and cut to the prefix that must hold a shared one, gives the pairs for which that can be. They go
through the same verification. So every pair of a bucket is either linked, of one component, or proven not to link.

Cases: a null text counts as empty; documents without words have an empty set and link with nothing; texts of fewer words than a
shingle are one shingle; null identifiers sort after all others, and a text that only rows without identifier hold links with none; rows with equal texts are one class; rows that share an
identifier but not the text are documents of their own whose component may bear the same identifier; an empty table gives an
empty result; other columns are ignored (drop_near_copies passes them through).
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import tokens
from tessera.llm.components import components

SHINGLE = 5
#: Similarity of 75 / 100 or more links.
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes that are compared before the posterior is looked at again.
BATCH = 16
#: Probability at which a pair is pruned that may reach the threshold.
MISS = 1e-6
_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def posterior(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of compared hashes agree) under a uniform prior: the upper tail of Beta(m + 1, n - m + 1)."""
    n = compared + 1
    return sum(comb(n, j) * threshold**j * (1 - threshold) ** (n - j) for j in range(matches + 1))


def least_matches(threshold: float = NUMERATOR / DENOMINATOR, miss: float = MISS) -> list[int]:
    """For 16, 32, ... compared hashes the fewest matches with which a pair stays."""
    return [next(m for m in range(n + 1) if posterior(m, n, threshold) >= miss) for n in range(BATCH, HASHES + 1, BATCH)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted: words are cut at ASCII white space, A-Z lower-cased."""
    cut = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(cut)), np.uint64, sum(map(len, cut)))
    n = len(flat)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):  # rolled[i] stands for words i .. i + k - 1
        if n > j:
            rolled[: n - j] = _mix(rolled[: n - j] * np.uint64(0x9E3779B97F4A7C15) + flat[j:] + np.uint64(j + 1))
    out, at = [], 0
    for c in cut:
        if len(c) >= k:
            out.append(np.unique(rolled[at : at + len(c) - k + 1]))
        elif c:
            h = np.array([len(c)], np.uint64)
            for x in flat[at : at + len(c)]:
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(c)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (sets, HASHES) of non-empty sets, 32 bits a hash."""
    if not sets:
        return np.zeros((0, HASHES), np.uint32)
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((HASHES, len(sets)), np.uint32)
    for i, m in enumerate(_MULTIPLIERS):
        out[i] = np.minimum.reduceat(every * m, starts) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), B.text_of(text_col).alias("text"))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, cls, sig): size and digest of each document's set, and its signature (null for empty sets)."""

    def run(batches):
        for batch in batches:
            for a, b in tokens.slices(batch.column("text"), 2_000_000):
                sets = shingle_sets(batch.column("text").slice(a, b - a).to_pylist())
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["id", "n", "cls", "sig"],
                )
        tokens.give_back()

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, n long, cls binary, sig binary")


def _band_keys(classes: DataFrame) -> DataFrame:
    """(cls, n, bucket): the band number is part of the hashed key."""
    width = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    return classes.select("cls", "n", F.explode(keys).alias("bucket"))


def _alive(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b, kept) without those that sizes or the signatures' posterior rule out, unless kept."""
    sig = classes.select("cls", "n", "sig")
    both = pairs.join(sig.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    both = both.where(F.col("kept") | (DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb"))).select("a", "b", "kept", "sa", "sb")
    need = least_matches()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
            stay, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(need):
                z = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (x[stay, z] == y[stay, z]).sum(axis=1)
                ok = matches >= least
                stay, matches = stay[ok], matches[ok]
            mask = batch.column("kept").to_numpy(zero_copy_only=False).copy()
            mask[stay] = True
            yield batch.select(["a", "b", "kept"]).filter(pa.array(mask))

    return both.mapInArrow(run, "a binary, b binary, kept boolean")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Full sets compared: (a, b, kept, na, shared, linked, rest), rest the shingles of a that b lacks, for kept pairs."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("ib")), "b")

    def run(batches):
        for batch in batches:
            na, common, linked, rest = [], [], [], []
            for x, y, kept in zip(batch.column("ia"), batch.column("ib"), batch.column("kept").to_pylist()):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                inside = np.isin(x, y, assume_unique=True)
                n = int(inside.sum())
                na.append(len(x))
                common.append(n)
                linked.append(DENOMINATOR * n >= NUMERATOR * (len(x) + len(y) - n))
                rest.append(x[~inside].view(np.int64) if kept else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "kept")), pa.array(na, pa.int64()), pa.array(common, pa.int64()), pa.array(linked, pa.bool_()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "kept", "na", "shared", "linked", "rest"])
        tokens.give_back()

    return both.select("a", "b", "kept", "ia", "ib").mapInArrow(run, "a binary, b binary, kept boolean, na long, shared long, linked boolean, rest array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, items): full sets of the classes wanted (id, cls), from one document each. Only texts that pass a bounded filter move."""
    rows = _rows(docs, id_col, text_col).where("id is not null").withColumnRenamed("id", "key")
    some = B.split_by_filter(rows, B.make_filter(wanted, F.col("id")))[1].join(wanted.withColumnRenamed("id", "key"), "key")

    def run(batches):
        for batch in batches:
            for a, b in tokens.slices(batch.column("text"), 2_000_000):
                sets = shingle_sets(batch.column("text").slice(a, b - a).to_pylist())
                keep = [(c, s.tobytes()) for c, s in zip(batch.column("cls").slice(a, b - a).to_pylist(), sets) if len(s) and _digest(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in keep], pa.binary()), pa.array([s for _, s in keep], pa.binary())], ["cls", "items"])
        tokens.give_back()

    with B.small_batches(docs.sparkSession):
        return B.stored(some.select("cls", "text").mapInArrow(run, "cls binary, items binary").dropDuplicates(["cls"]), "sets")


def _stars(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, kept): class a meets pivot b in a bucket, kept if it is one of three or more; and (cls) of all classes that share a bucket."""
    rows = _band_keys(classes).select("bucket", "cls")
    shared = B.stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    total = shared.agg(F.sum("size")).first()[0] or 0
    members = B.stored(B.lookup(rows, shared, "bucket", "size", total, "inner"), "members")
    degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))
    pivots = members.join(degree, "cls").groupBy("bucket").agg(F.max_by("cls", F.struct("degree", "cls")).alias("pivot"), F.first("size").alias("size"))
    met = B.lookup(members.drop("size"), B.stored(pivots, "pivots"), "bucket", "size", total, "inner")
    stars = met.where(F.col("cls") != F.col("pivot")).groupBy(F.col("cls").alias("a"), F.col("pivot").alias("b")).agg((F.max("size") > 2).alias("kept"))
    return stars, degree.select("cls")


def _rest_pairs(stars: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(a, b, kept = false): members of a star with unlike labels that may still link; None if there are none. stars: as compared, of three or
    more members.

    To link, x and y must share t = 75 (|x| + |y|) / 175 - min(|x & p|, |y & p|) shingles or more outside the pivot."""
    named = stars.select(F.col("a").alias("x"), F.col("b").alias("p"), F.col("na").alias("n"), "shared", "rest").join(labels.select(F.col("node").alias("x"), "label"), "x", "left").withColumn("label", F.coalesce("label", "x"))
    of = named.groupBy("p").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("n").alias("least"), F.count(F.lit(1)).alias("size")).where(F.col("l0") != F.col("l1")).drop("l0", "l1")
    of = B.stored(of, "open")
    total = of.agg(F.sum("size")).first()[0]
    if not total:
        return None
    # Labels are unlike only if one of them is not the pivot's: only rows of such labels (minor) look for others.
    roots = labels.select(F.col("node").alias("p"), F.col("label").alias("root"))
    of = of.join(roots, "p", "left").withColumn("root", F.coalesce("root", "p"))
    mine = B.lookup(named, of, "p", "size", total, "inner")
    half = lambda n, m: NUMERATOR * (n + m) / float(NUMERATOR + DENOMINATOR)
    smallest = F.greatest(F.col("least"), F.ceil(NUMERATOR * F.col("n") / DENOMINATOR))
    t = F.ceil(half(F.col("n"), smallest) - F.col("shared") - 1e-9)
    mine = B.stored(mine.withColumns({"m": F.size("rest"), "t": t, "minor": F.col("label") != F.col("root")}).where(F.col("t") <= F.col("m")), "rests")
    # A member's rests are counted as one list, however many pivots it has. What one member alone has cannot be shared, and what no minor row has joins
    # nothing; so of a rest only the other shingles (common, rarest first) matter, and of these the prefix that must hold a shared one.
    each = mine.groupBy("x").agg(F.max("minor").alias("minor"), F.array_distinct(F.flatten(F.collect_list("rest"))).alias("all"))
    items = B.stored(each.select("x", "minor", F.explode("all").alias("h")), "items")
    counts = B.stored(items.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.count_if("minor").alias("minors")).where("df > 1 and minors > 0").drop("minors"), "counts")
    held = B.lookup(items.drop("minor"), counts, "h", "df", counts.agg(F.sum("df")).first()[0] or 1, "inner")
    held = held.groupBy("x").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "h"))), lambda i: i["h"]).alias("held"))
    cut = mine.join(held, "x").withColumn("common", F.array_intersect("held", "rest")).drop("held", "rest", "least", "size", "root").withColumn("own", F.size("common"))
    cut = cut.where((F.col("own") > 0) & (F.col("t") <= F.col("own")))
    posts = cut.select("x", "p", "minor", "label", "n", "shared", "own", F.posexplode(F.slice("common", 1, F.least(F.col("own"), F.col("own") - F.col("t") + 1).cast("int"))).alias("k", "h"))
    posts = B.stored(posts.withColumn("e", F.xxhash64("p", "h")).drop("p", "h"), "posts")
    met = B.stored(posts.groupBy("e").agg(F.count(F.lit(1)).alias("df"), F.count_if("minor").alias("minors")).where("df > 1 and minors > 0"), "counts")
    posts = B.stored(B.lookup(posts, met, "e", "df", met.agg(F.sum("df")).first()[0] or 1, "inner"), "posts")
    other = posts.select("e", "df", "minors", *[F.col(c).alias(c + "2") for c in ("x", "label", "n", "shared", "own", "k")])
    lacks = half(F.col("n"), F.col("n2")) - F.least("shared", "shared2") - 1e-9
    near = B.block_pairs(posts.where("minor"), other, "e", ("minors", "df"), ("x", "x2")).where((F.col("label") != F.col("label2")) & (F.least(F.col("own") - F.col("k"), F.col("own2") - F.col("k2")) >= lacks))
    pairs = [B.stored(near.select("x", "x2").distinct(), "near")]
    # Pairs that need to share nothing outside the pivot.
    far = mine.where(F.col("minor") & (half(F.col("n"), F.col("least")) - 1e-9 <= F.col("shared")))
    far = B.stored(far.select("p", "size", F.lit(1).alias("few"), "x", "label", "n", "shared"), "far")
    if not far.isEmpty():
        all_ = mine.select("p", "size", F.lit(1).alias("few"), *[F.col(c).alias(c + "2") for c in ("x", "label", "n", "shared")]).join(far.select("p").distinct(), "p", "left_semi")
        inner = B.block_pairs(far, all_, "p", ("few", "size"), ("x", "x2")).where((F.col("x") != F.col("x2")) & (F.col("label") != F.col("label2")) & (lacks <= 0))
        pairs.append(inner.select("x", "x2"))
    return reduce(DataFrame.unionByName, pairs).select(F.least("x", "x2").alias("a"), F.greatest("x", "x2").alias("b"), F.lit(False).alias("kept")).distinct()


def class_links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, label): classes that have links, with one label a component. classes: (cls, n, sig, id), one row a class.

    Classes without identifier have no set to compare, so they are no members, and above all no pivots, of a bucket."""
    classes = classes.where("id is not null")
    stars, met = _stars(classes)
    alive = B.stored(_alive(B.stored(stars, "pairs"), classes), "alive")
    wanted = B.stored(met.join(classes.select("cls", "id"), "cls"), "met")
    sets = _full_sets(docs, wanted, id_col, text_col)
    compared = B.stored(_compared(alive, sets), "stars")
    labels = components(compared.where("linked").select("a", "b"))
    pairs = _rest_pairs(compared.where("kept"), labels)
    if pairs is None:
        return labels
    more = B.stored(_compared(B.stored(_alive(B.stored(pairs, "pairs"), classes), "alive"), sets).where("linked").select("a", "b"), "links")
    if more.isEmpty():
        return labels
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("l" + c))
    joined = B.stored(more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), "links")
    roots = components(joined)  # labels that the new links join
    both = labels.unionByName(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))).groupBy("node").agg(F.min("label").alias("label"))
    return B.stored(both.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (the smallest identifier reachable), kept."""
    with B.small_batches(docs.sparkSession):
        rows = B.stored(sketch(docs, id_col, text_col), "sketches")
    full = rows.where(F.col("cls").isNotNull())
    classes = B.stored(full.groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("id").alias("id"), F.count(F.lit(1)).alias("size")), "classes")
    labels = class_links(docs, classes, id_col, text_col)
    own = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = own.groupBy("label").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("count"))
    named = B.stored(B.lookup(own, lowest, "label", "count", max(1, classes.count())).select("cls", "low", "size"), "lowest")
    told = B.lookup(full.select("id", "n", "cls"), named, "cls", "size", full.count()).select("id", "n", "low")
    every = told.unionByName(rows.where(F.col("cls").isNull()).select("id", "n", F.col("id").alias("low")))
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), F.col("id").eqNullSafe(F.col("low")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, columns as they were. Only rows that a filter takes for copies move.

    Rows without identifier and rows that share one, usually none, are written once with numbers of their own, beyond all identifiers, and
    are documents like any other: each stays or goes by its own text."""
    own = F.col(id_col).cast("long")
    odd = B.stored(docs.select(own.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or key is null").select("key"), "odd")
    dropped = lambda told, key: B.stored(told.where("not kept").select(F.col(key).alias("key")), "dropped")
    if odd.isEmpty():
        return B.anti_rows(docs, own, dropped(near_groups(docs, id_col, text_col), id_col))
    low, top = docs.agg(F.min(own), F.max(own)).first()
    first = 0 if top is None else top + 1 if top < 1 << 62 else low - (1 << 61)
    if first < -(1 << 63):  # identifiers reach from end to end: all rows are numbered anew
        first, plain, strange = 0, docs.where(F.lit(False)), docs
    else:
        plain, strange = B.anti_rows(docs.where(own.isNotNull()), own, odd), docs.where(own.isNull()).unionByName(B.semi_rows(docs, own, odd))
    strange = strange.select((F.lit(first) + F.monotonically_increasing_id()).alias("key"), B.text_of(text_col).alias("text"), F.struct("*").alias("row"))
    strange = B.stored(strange, "strange")
    every = plain.select(own.alias("key"), B.text_of(text_col).alias("text")).unionByName(strange.select("key", "text"))
    gone = dropped(near_groups(every, "key", "text"), "key")
    return B.anti_rows(plain, own, gone).unionByName(strange.join(gone, "key", "left_anti").select("row.*"))
