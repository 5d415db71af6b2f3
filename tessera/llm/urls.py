"""URL filters: rules by host and path, and a list of URLs, both held in one blocked Bloom filter before an exact join.

Every page is said in a few expressions: its canonical URL, and for each shape of rule (labels of the host, length of the path) the end of
its host with that many labels and the start of its path of that length. A blocked Bloom filter of all rules and listed canonical URLs lets
possible hits pass; an exact hash join with the entries removes false positives. Of the rules that fit, the longest (host and path together,
then the longer host) decides; without a rule a page is blocked if its canonical URL is listed, else allowed.

Host: what stands after the first :// up to /, ?, # or the end, A-Z in lower case. Path: what follows, up to ?, # or the end.
Canonical: the host without user, www. before it, port 80 or 443 and dots at its end; the path with runs of / as one, without index.html, .html, .htm
and / at its end; the query's parameters in order, without those that only track (utm_*, ref, fbclid, gclid, session ids); no scheme, no fragment.

Cases: a null URL or one without :// has empty host and path, fits no rule and is not listed, so it is allowed; repeated pages and null
identifiers are rows like any other; entries without host are never met; of rules with the same host and path that disagree, block wins; empty
tables of pages, rules or listed URLs are in order; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import bloom

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words that mark a host as one whose pages a list of unwanted URLs would hold.
UNWANTED = ["ads", "adult", "bet", "bets", "casino", "escort", "farm", "gambling", "jackpot", "loan", "loans", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx"]
#: Query parameters that do not change what a page shows.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sid|sessionid|phpsessid)(=|$)"


def _after(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url):
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_of(url):
    """'' where there is no host."""
    rest, s = _after(url), F.regexp_replace
    host = s(s(s(s(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), r"^.*@", ""), r":(80|443)?$", ""), r"\.+$", ""), r"^www\.", "")
    path = s(s(s(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"/+", "/"), r"(/index)?\.html?$", ""), r"/$", "")
    query = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))).otherwise("")


def listed_in(pages: DataFrame, url_col: str = "url", words: list[str] = UNWANTED) -> DataFrame:
    """(url): the pages' URLs whose host has one of words among its labels' parts. It stands in for a published list of URLs."""
    parts = F.split(host_of(F.col(url_col).cast("string")), r"[.-]")
    return pages.select(F.col(url_col).cast("string").alias("url")).where(F.arrays_overlap(parts, F.array(*map(F.lit, words)))).distinct()


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _labels(host):
    return F.size(F.split(host, r"\.")).cast("int")


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, kind, rule, host_size, verdict), one row a key."""
    key = F.concat(F.lit("r|"), "host", F.lit("|"), "path")
    ruled = rules.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
    ruled = ruled.select(key.alias("key"), F.lit("rule").alias("kind"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_size"), "verdict")
    canonical = listed.select(canonical_of(F.col("url")).alias("c")).where("c <> ''").distinct()
    told = canonical.select(F.concat(F.lit("u|"), "c").alias("key"), F.lit("url").alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("host_size"), F.lit("block").alias("verdict"))
    return ruled.unionByName(told)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, canonical, listed. rules: host, path, verdict; listed: url."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), *[f(F.coalesce(url, F.lit(""))).alias(n) for f, n in ((host_of, "host"), (path_of, "path"), (canonical_of, "canonical"))])
    rows = B.stored(rows.withColumn("rid", F.monotonically_increasing_id()), "urls")
    known = B.stored(entries(rules, listed), "entries")
    shapes = rules.where("host <> ''").select(_labels(F.col("host")).alias("m"), F.length("path").alias("n")).distinct().collect()  # a row a shape, however many rules
    filt = bloom.make(known, F.col("key"), known.count()).stored(lambda t: B.stored(t, "filter"))
    ends = [F.when((_labels(F.col("host")) >= s.m) & (F.length("path") >= s.n) & (F.col("host") != ""), F.concat(F.lit("r|"), F.substring_index("host", ".", -s.m), F.lit("|"), F.substring("path", 1, s.n))) for s in shapes]
    said = F.array_distinct(F.array_compact(F.array(F.when(F.col("canonical") != "", F.concat(F.lit("u|"), "canonical")), *ends)))
    tried = rows.select("rid", F.explode(said).alias("key"))
    maybe = B.stored(bloom.told(tried, F.col("key"), filt).where("f_maybe").select("rid", "key"), "possible")
    sized = known.join(maybe.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    hits = B.lookup(maybe, sized, "key", "n", maybe.count(), "inner")
    best = F.max_by(F.struct("rule", "verdict"), F.when(F.col("kind") == "rule", F.struct(F.length("rule"), "host_size"))).alias("best")
    decided = hits.groupBy("rid").agg(best, F.max(F.col("kind") == "url").alias("listed"))
    out = rows.join(decided, "rid", "left")
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "canonical", F.coalesce("listed", F.lit(False)).alias("listed"))
