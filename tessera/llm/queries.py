"""The queries of this subpackage: each operator with production parameters over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import divergence, exact_dedup, fingerprints, licenses, mixing, near_dedup, packing, prefix_trie, quality, secrets, sharding, tokenfile, urls

LABELS = "labels.parquet"


def op1_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, perplexity, limit, keep."""
    return quality.classify(B.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/{LABELS}"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(B.documents(spark, sf_dir))
    base = F.filter("findings", lambda s: s["kind"].isin("assign", "access", "hex"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    live = F.filter("findings", lambda s: s["live"])
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("findings")).alias("spans"),
        said(live).alias("live_spans"),
        *[F.coalesce(F.array_max(F.transform("findings", lambda s: s[c])), F.lit(0).cast("long")).alias(f"most_{c}") for c in ("owners", "repos")],
    )


def op3_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_likeness(B.documents(spark, sf_dir))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(B.documents(spark, sf_dir))


def op5_pfor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_files(tokenfile.write_files(B.documents(spark, sf_dir)))


def op6_merge_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(B.documents(spark, sf_dir))


def op7_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(B.documents(spark, sf_dir))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_rows(B.documents(spark, sf_dir), 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(B.documents(spark, sf_dir)).withColumn("findings", F.size("findings"))


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(B.documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(pages, urls.rule_table(spark), urls.listed_in(pages))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(B.documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_kneser_ney, op2_secret_ownership, op3_chunk_fingerprints, op4_hilbert_packing, op5_pfor_files, op6_merge_index_dedup, op7_bayes_minhash, op8_bounded_ring, op9_license_rules, op10_sainte_lague_mix, op11_prefix_trie, op12_url_filter, op13_source_divergence)}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


def _secret_sql() -> str:
    """Offsets are running sums of the lengths of matches and of what lies between them, as in the operator."""
    kinds = [("assign", secrets.ASSIGN, 2, 6)] + [(k, p, 1, 0) for k, p, _ in secrets.BASE_KINDS + secrets.ADDED_KINDS]
    one = []
    for kind, pattern, group, least in kinds:
        p = "'" + pattern.replace("'", "''") + "'"
        one.append(
            f"""SELECT row, owner, repo, '{kind}' AS kind, {secrets.ORDER[kind]} AS rank, i, g, m, v[i] AS value FROM (
  SELECT row, owner, repo, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS i FROM d) q
WHERE length(v[i]) >= {least}"""
        )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner, coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1)) AS repo FROM documents),
m AS ({" UNION ALL ".join(one)}),
s AS MATERIALIZED (SELECT row, owner, repo, kind, rank, value,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS b FROM m),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM s GROUP BY value),
f AS (SELECT row, list(kind || ':' || a || ':' || b ORDER BY a, rank) AS spans, list(kind || ':' || a || ':' || b ORDER BY a, rank) FILTER (rank < 3) AS base,
  list(kind || ':' || a || ':' || b ORDER BY a, rank) FILTER (owners <= {secrets.EXAMPLE_OWNERS} AND repos <= {secrets.EXAMPLE_REPOS}) AS live, max(owners) AS most, max(repos) AS most_repos,
  count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh FROM s JOIN o USING (value) GROUP BY row)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(array_to_string(base, ','), '')) AS base_sha256,
  coalesce(array_to_string(spans, ','), '') AS spans, coalesce(array_to_string(live, ','), '') AS live_spans, coalesce(most, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN f USING (row)"""


def _url_sql() -> str:
    after = "CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    words = ", ".join(f"'{w}'" for w in urls.UNWANTED)
    tracking = urls.TRACKING
    return rf"""
WITH p AS (SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT row, page_id, {after} AS rest FROM p),
h AS (SELECT row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{tracking}'))) AS params FROM q),
n AS (SELECT row, page_id, host, path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '\.+$', ''), '^www\.', '') AS name,
  regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(/index)?\.html?$', ''), '/$', '') AS way, array_to_string(params, '&') AS query FROM h),
c AS (SELECT row, page_id, host, path, CASE WHEN name = '' THEN '' ELSE name || way || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM n),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND list_has_any(string_split_regex(host, '[.-]'), [{words}])),
r(rule_host, rule_path, said) AS (VALUES {rules}),
f AS (SELECT row, rule_host || rule_path AS rule, said, row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.said, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, c.canonical, l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN f ON f.row = c.row AND f.k = 1 LEFT JOIN l ON l.canonical = c.canonical"""


def _trie_sql() -> str:
    """A node is named by the hash of the list of its turns."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))"
    return f"""
WITH o AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor({crc}, 4294967295) % {prefix_trie.HEAD_MOD} AS h FROM o),
r AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % {prefix_trie.FAMILY}),
m AS MATERIALIZED (SELECT conv_id, d AS depth, sha256(CAST(turns[1:d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN sha256(CAST(turns[1:d - 1] AS VARCHAR)) END AS up, CASE WHEN d > 0 THEN strlen(turns[d][2]) ELSE 0 END AS bytes, d = len(turns) AS ended
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r) q),
n AS MATERIALIZED (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY depth, node),
c AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, node)),
s AS (SELECT a.depth, a.node, sum(k.saved) AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM (SELECT DISTINCT a.depth, a.node, b.depth AS low_depth, b.node AS low_node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth) a JOIN k ON k.depth = low_depth AND k.node = low_node GROUP BY a.depth, a.node)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (depth, node) LEFT JOIN n p ON p.depth = k.depth - 1 AND p.node = k.up"""


def _divergence_sql() -> str:
    share = lambda n, total: f"1 + ({divergence.UNIT}::HUGEINT * ({n} + {divergence.PRIOR})) // ({total} + {divergence.PRIOR} * v)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}') AS t FROM documents),
w AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.LEAST_DOCS}),
s AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "total")} AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, {share("n", "total")} AS q FROM (SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term) JOIN (SELECT lang, any_value(v) AS v, sum(total) AS total FROM g GROUP BY lang) USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e) WHERE part = 'pair' OR rank <= {divergence.TOP}"""


ORACLE_SQL = {
    "op11_prefix_trie": _trie_sql(),
    "op12_url_filter": _url_sql(),
    "op13_source_divergence": _divergence_sql(),
    "op2_secret_ownership": _secret_sql(),
    "op6_merge_index_dedup": f"""
WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)""",
    "op7_bayes_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS items
  FROM w),
n AS (SELECT doc_id, len(items) AS n FROM s),
u AS (SELECT doc_id, unnest(items) AS item FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)""",
}
