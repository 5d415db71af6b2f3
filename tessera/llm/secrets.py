"""Secret scan with corpus-wide ownership frequency, DataFrame functions only.

Patterns give candidate spans. The values of candidates are hashed and counted over the whole corpus by distinct repositories
and distinct owners: a value that several owners have, or that one owner has in many repositories, is a widely copied example; one that
a single owner has in few repositories is live-looking. A corpus without repositories needs a stand-in: by default an owner (source)
has one repository for each language.

Cases: a null text counts as empty; a null owner or repository counts as one of its own; rows that repeat count as rows (the
distinct counts do not change); overlapping kinds all stay; an empty table gives an empty result; other columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base as B

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern with the value as group 1, a literal or pattern that a text must hold to be searched. Base kinds come first.
#: A maximal run of 24 or more is what the run pattern followed by the length test finds, likewise for access keys.
BASE_KINDS = [
    ("access", r"(AKIA[A-Z0-9]{16,})", "AKIA"),
    ("hex", r"([0-9a-f]{24,})", None),
]
#: Kinds that the method adds to the base ones.
ADDED_KINDS = [
    ("forge", r"\b(gh[pousr]_[A-Za-z0-9]{30,})\b", "_"),
    ("chat", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})", "xox"),
    ("jwt", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "eyJ"),
    ("key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", "-----BEGIN"),
    ("url", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]{1,64}:([^\s:/@]{6,128})@", "://"),
]
#: A value that more owners than EXAMPLE_OWNERS have, or that stands in more repositories than EXAMPLE_REPOS, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 1, 2
#: Matches whose offsets are added up one after another; runs of so many are put together afterwards.
RUN = 256
#: Base kinds in the order that breaks ties of start.
ORDER = {"assign": 0, "access": 1, "hex": 2} | {k: 3 + i for i, (k, _, _) in enumerate(ADDED_KINDS)}


def _spans(text, kind: str, pattern: str, gate, value_group: int, least: int = 0):
    """array<struct<kind, rank, start, end, value>> of the leftmost non-overlapping matches.

    split() gives what lies between the matches, so running sums of lengths are the offsets. Texts that fail the gate are not searched."""
    gaps = F.split(text, pattern, -1)
    found, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    joined = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), values, lambda x, v: F.struct(F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("len"), v.alias("value")))
    kind_ = "array<struct<kind:string,rank:int,start:int,end:int,value:string>>"
    empty = F.lit(None).cast(kind_)

    def step(acc, x):
        end = acc["at"] + x["gap"] + x["len"]
        one = F.struct(F.lit(kind).alias("kind"), F.lit(ORDER[kind]).alias("rank"), (acc["at"] + x["gap"]).alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def run(acc, part):  # appending copies what is there, so long lists are made of runs
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(kind_).alias("out")), step)
        return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))[0]

    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(joined) / RUN).cast("int")), lambda k: F.slice(joined, k * RUN + 1, RUN))
    walked = F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_}>").alias("out")), run, lambda acc: acc["out"]))
    walked = F.filter(walked, lambda s: F.char_length(s["value"]) >= least) if least else walked
    return F.coalesce(F.when(gate, walked).otherwise(empty), F.array().cast("array<struct<kind:string,rank:int,start:int,end:int,value:string>>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang") -> DataFrame:
    """(row, id, owner, repo, spans): spans sorted by start, then kind. A repository is an owner's repo_col value.

    One pass over the text; only the spans leave it. row numbers rows, so that rows with equal identifiers stay apart."""
    text = F.col("_text")
    parts = [_spans(text, "assign", ASSIGN, text.rlike("(?i:password|passwd|secret|token|api_?key)"), 2, 6)]
    for kind, pattern, literal in BASE_KINDS + ADDED_KINDS:
        parts.append(_spans(text, kind, pattern, text.contains(literal) if literal else text.rlike(pattern), 1))
    own = F.coalesce(F.col(owner_col).cast("string"), F.lit("\0"))
    repo = F.concat_ws("\1", own, F.coalesce(F.col(repo_col).cast("string"), F.lit("\0"))) if repo_col else own
    base = docs.select(F.col(id_col).cast("long").alias("id"), own.alias("owner"), repo.alias("repo"), B.text_of(text_col).alias("_text"))
    every = F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    return base.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repo", every.alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, owners, repos, n) of exploded candidates; distinct pairs are formed on the map side first, so one value that a
    third of all rows hold sends a row a task and owner."""
    pairs = spans.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = pairs.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per document: id_col and findings, array<struct<kind, start, end, value_sha256, owners, repos, live>> by start, then kind.

    live: no more than example_owners owners, and no more than example_repos repositories, hold the value anywhere in the corpus."""
    seen = B.stored(
        candidates(docs, id_col, text_col, owner_col, repo_col).withColumn(
            "spans",
            F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"].cast("binary"), 256).alias("value_sha256"))),
        ),
        "secrets",
    )
    flat = seen.where(F.size("spans") > 0).select("row", "owner", "repo", F.explode("spans").alias("s"))
    flat = flat.select("row", "owner", "repo", F.col("s.kind").alias("kind"), F.col("s.rank").alias("rank"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value_sha256").alias("value_sha256"), F.col("s.value_sha256").alias("value_hash"))
    stats = B.stored(ownership(flat), "owners")
    total = stats.agg(F.sum("n")).first()[0] or 0
    told = B.lookup(flat.drop("owner", "repo"), stats, "value_hash", "n", total)
    found = told.groupBy("row").agg(
        F.sort_array(
            F.collect_list(F.struct("start", "rank", "kind", "end", "value_sha256", "owners", "repos", ((F.col("owners") <= example_owners) & (F.col("repos") <= example_repos)).alias("live")))
        ).alias("f")
    )
    none = "array<struct<kind:string,start:int,end:int,value_sha256:string,owners:bigint,repos:bigint,live:boolean>>"
    shaped = found.select("row", F.transform("f", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value_sha256", "owners", "repos", "live")])).cast(none).alias("findings"))
    return seen.select("row", "id").join(shaped, "row", "left").select(F.col("id").alias(id_col), F.coalesce("findings", F.array().cast(none)).alias("findings"))
