"""Divergence of sources: how each source's word frequencies differ from those of the other sources and of its whole language.

Two passes over the texts. The first counts, exactly, in how many documents of its language each term occurs; a language keeps the terms
of least_docs documents or more. The second finds the kept terms again with Aho-Corasick automata over texts in which every character
that belongs to no term is a space, the terms being padded with a space on either side, and counts their occurrences by group, a group
being one source within one language. The counts stand as sparse postings (lang, source, term, n); what a group lacks is never stored, but
enters the sums in closed form. All arithmetic is in integers: p = 1 + floor(10^9 (n + 5) / (N + 5 V)).

Bounds: an automaton has about SHARD_TERMS terms, whatever the vocabulary's size; a larger vocabulary has several, by hash of the term, and
each is a pass of its own, so only one shard's terms are in the driver and in a worker at a time. Workers hand over their counts whenever
they hold FLUSH of them. Pairs of sources are summed in tiles of BLOCK sources by CHUNK terms.

Cases: a null text, language or source counts as ''; an empty text makes its group occur without terms; a language without kept terms has
V = 0, its pairs have value 0 and it has no term rows; rows that repeat are documents of their own; identifiers are not read; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _base as B

#: Documents of a language that a kept term needs; ranks of the term part.
LEAST_DOCS, TOP = 30, 50
#: Terms of one automaton; counts that a worker holds.
SHARD_TERMS, FLUSH = 200_000, 400_000
#: Sources and terms of one tile.
BLOCK, CHUNK = 64, 1024
#: Fixed values of the smoothed share: 10^9 (n + 5) / (N + 5 V).
UNIT, PRIOR = 1_000_000_000, 5

#: A-Z become a-z, all other ASCII but a-z becomes a space; bytes of other characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[B.text_of(c).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def _texts(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """(plain bytes, *columns) by row."""
    keys = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
    text = batch.column(batch.schema.get_field_index("text"))
    for i in range(batch.num_rows):
        yield text[i].as_py().encode().translate(_PLAIN), *[k[i] for k in keys]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def hand_over():
        for lang, c in held.items():
            terms = pa.array([t.decode() for t in c], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), terms, pa.array(c.values(), pa.int64())], ["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for text, lang in _texts(batch, "lang"):
            terms = set(text.split(b" "))
            terms.discard(b"")
            held.setdefault(lang, Counter()).update(terms)
        if sum(map(len, held.values())) > FLUSH:
            yield from hand_over()
    yield from hand_over()


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, df): in how many rows of the language the term occurs. Workers have summed already, so Spark sums behind the shuffle only."""
    return rows.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long").repartition("lang", "term").groupBy("lang", "term").agg(F.sum("n").alias("df"))


_built: tuple = (None, None)


def automaton(terms: list[tuple[int, str]], token: str) -> ahocorasick.Automaton:
    """The automaton of (number, term), built once a worker for each token."""
    global _built
    if _built[0] != token:
        _built = (None, None)
        a = ahocorasick.Automaton()
        for number, term in terms:
            a.add_word(f" {term} ", number)
        a.make_automaton()
        _built = (token, a)
    return _built[1]


def _occurrences(terms, token: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not terms.value:  # an automaton needs a term
            return
        found, number = automaton(terms.value, token), itemgetter(1)
        held: dict[tuple[str, str], Counter] = {}

        def hand_over():
            for (lang, source), c in held.items():
                lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (c.keys(), c.values())]
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([source], pa.string()), *lists], ["lang", "source", "tids", "ns"])
            held.clear()

        for batch in batches:
            for text, lang, source in _texts(batch, "lang", "source"):
                held.setdefault((lang, source), Counter()).update(map(number, found.iter(f" {text.decode()} ")))
            if sum(map(len, held.values())) > FLUSH:
                yield from hand_over()
        yield from hand_over()

    return count


def postings(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, tid, n): occurrences of each language's kept terms (lang, term) by group, where there are any."""
    spark = rows.sparkSession
    shards = max(1, -(-kept.select("term").distinct().count() // SHARD_TERMS))
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    terms = B.stored(kept.select("term").distinct().select("term", shard.alias("shard"), F.monotonically_increasing_id().alias("tid")), "terms")
    parts = []
    for k in range(shards):
        own = spark.sparkContext.broadcast([(r.tid, r.term) for r in terms.where(F.col("shard") == k).collect()])
        with B.small_batches(spark):
            each = rows.mapInArrow(_occurrences(own, uuid.uuid4().hex), "lang string, source string, tids array<long>, ns array<long>")
            each = each.select("lang", "source", F.explode(F.arrays_zip("tids", "ns")).alias("x")).select("lang", "source", F.col("x.tids").alias("tid"), F.col("x.ns").alias("n"))
            each = each.repartition("lang", "source", "tid").groupBy("lang", "source", "tid").agg(F.sum("n").alias("n"))
            parts.append(B.stored(each, "occurrences"))
        own.unpersist()
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return counts.join(kept.select("lang", "term").join(terms.select("term", "tid"), "term"), ["lang", "tid"])


def _p(n, total, v):
    """1 + floor(UNIT (n + PRIOR) / (total + PRIOR v)), in decimals, so counts of any size are exact."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + F.lit(PRIOR)).cast("decimal(20,0)"), (total + F.lit(PRIOR) * v).cast("decimal(20,0)"))


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """For one tile the sums over its terms of |p - q| - |p0 - q0|, p0 and q0 being the shares of absent terms, by pair of sources a < b."""
    lang, ba, bb = rows[["lang", "ba", "bb"]].iloc[0]
    seen = rows[rows["tid"] >= 0]
    dims = np.unique(seen["tid"])
    sides = []
    for b in (ba, bb):
        own = rows[(rows["block"] == b) & (rows["tid"] < 0)].sort_values("source")
        names, p0 = own["source"].to_numpy(object), own["p0"].to_numpy("int64")
        m = np.repeat(p0[:, None], len(dims), 1)
        mine = seen[seen["block"] == b]
        m[pd.Index(names).get_indexer(mine["source"]), np.searchsorted(dims, mine["tid"])] = mine["p"]
        sides.append((names, p0, m))
    (a, pa0, ma), (b, pb0, mb) = sides
    out = []
    for i in range(len(a)):
        v = np.abs(mb - ma[i]).sum(1) - len(dims) * np.abs(pb0 - pa0[i])
        use = np.arange(len(b)) > i if ba == bb else np.ones(len(b), bool)
        out.append(pd.DataFrame({"lang": lang, "a": a[i], "b": b[use], "v": v[use]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "v": []})


def pair_sums(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """(lang, a, b, value): for each two sources of a language, once, the sum of |p - q| over all V kept terms.

    groups: lang, source, v, p0; posted: lang, source, tid, v, p. Tiles are (chunk of terms, block of sources, block of sources) within a
    language; a posting goes to as many tiles as there are blocks, a group's row to as many as there are chunks and blocks."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / CHUNK))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    heads = B.with_dim(groups, blocks, "lang").select("lang", "source", "p0", block, "blocks", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(-1).cast("long").alias("tid"), F.lit(0).cast("long").alias("p"))
    each = B.with_dim(posted, blocks, "lang").select("lang", "source", F.lit(0).cast("long").alias("p0"), block, "blocks", F.pmod(F.xxhash64("tid"), chunks).alias("chunk"), "tid", "p")
    every = heads.unionByName(each).select("lang", "source", "p0", "block", "chunk", "tid", "p", other)
    every = every.withColumns({"ba": F.least("block", "other"), "bb": F.greatest("block", "other")}).drop("other")
    summed = every.groupBy("lang", "chunk", "ba", "bb").applyInPandas(_tile, "lang string, a string, b string, v long").groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    side = lambda c: groups.select("lang", F.col("source").alias(c), F.col("p0").alias("p" + c), *(["v"] if c == "a" else []))
    summed = summed.withColumnRenamed("v", "s").join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    return summed.select("lang", "a", "b", (F.col("s") + F.col("v") * F.abs(F.col("pa") - F.col("pb"))).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language by summed difference of shares; part `term`:
    the top kept terms that the group uses more than its language does. Ranks by value descending, then item."""
    with B.small_batches(docs.sparkSession):
        rows = _rows(docs, text_col, lang_col, source_col)
        kept = B.stored(document_frequencies(rows).where(F.col("df") >= least_docs), "kept")
        found = B.stored(postings(rows, kept), "postings")
        own = rows.select("lang", "source").distinct().join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        groups = B.with_dim(own, size, "lang").fillna(0, ["total", "v"])
        zero = F.lit(0).cast("long")
        groups = B.stored(groups.withColumn("p0", F.when(F.col("v") > 0, _p(zero, F.col("total"), F.col("v"))).otherwise(zero)), "groups")
        few = groups.limit(B.DIM_ROWS + 1).count() <= B.DIM_ROWS
        shares = found.join(F.broadcast(groups) if few else groups, ["lang", "source"])
        shares = B.stored(shares.select("lang", "source", "term", "tid", "n", "v", _p(F.col("n"), F.col("total"), F.col("v")).alias("p")), "shares")
        pairs = B.stored(pair_sums(groups.select("lang", "source", "v", "p0"), shares.select("lang", "source", "tid", "v", "p")), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"))
    q = B.with_dim(shares.groupBy("lang", "tid").agg(F.sum("n").alias("all"), F.first("v").alias("lv")), langs, "lang").select("lang", "tid", _p(F.col("all"), F.col("whole"), F.col("lv")).alias("q"))
    terms = shares.join(q, ["lang", "tid"]).where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    told = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return told(both, "pair").unionByName(told(terms, "term").where(F.col("rank") <= top))

