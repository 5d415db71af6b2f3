"""Prefix tries, URL filters and the divergence audit against brute force over rows that hold every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bloom, divergence, prefix_trie, urls

# ---------------------------------------------------------------- 11

TURNS = "conv_id long, turn long, role string, text string, conv string, key string, i int"


def talk(seed: int, convs: int, longest: int) -> list[tuple]:
    """Conversations with common starts, copies, ends within others, missing families, nulls and clashing extra columns."""
    r = random.Random(seed)
    stems = [[(r.choice(["user", "assistant"]), r.choice(["a", "b", "é", ""])) for _ in range(longest)] for _ in range(3)]
    rows = []
    for c in r.sample(range(-40, 4 * convs), convs):
        stem = r.choice(stems)
        n = r.choice([1, 2, 3, r.randint(1, longest), longest])
        said = stem[: r.randint(0, n)]
        said = said + [("user", r.choice(["a", "b", "c"])) for _ in range(n - len(said))]
        turns = r.sample(range(1000), n)
        for t, (role, text) in zip(sorted(turns), said, strict=True):
            rows.append((c, t, role or None, text or None, "x", "y", 1))
    rows += [(c, None, "user", "first", "x", None, None) for c in (5, 6, 7)]
    rows += [(None, 1, "user", "nobody", None, None, None)]
    r.shuffle(rows)
    return rows


def trie_truth(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, f"{role or ''}\n{text or ''}", role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not children[node]
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def told_trie(df) -> set[tuple]:
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_prefix_trie(spark):
    rows = talk(1, 120, 12)
    assert told_trie(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5))) == trie_truth(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_prefix_trie_many_blocks(spark, monkeypatch, seed):
    """Keys of two units and blocks of three positions: several levels, and nearly all intervals reach into other blocks."""
    for name, value in (("WIDTH", 2), ("LEAST_BLOCK", 3), ("FILL", 2)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = talk(seed, 70, 17) + [(c, t, "user", "copy", "x", "y", 2) for c in range(1000, 1030) for t in range(12)]
    assert told_trie(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3))) == trie_truth(rows)


def test_prefix_trie_odd(spark):
    frame = lambda rows: spark.createDataFrame(rows, TURNS)
    assert prefix_trie.prefix_trie(frame([])).count() == 0
    assert prefix_trie.prefix_trie(frame([(None, 1, "a", "b", None, None, None)])).count() == 0
    for rows in ([(3, None, None, None, None, None, None)], [(5, 1, "u", "x", None, None, None)] * 4, [(c, t, "u", "x" * 5000, None, None, None) for c in (11, 12) for t in range(40)], [(c, 0, "u", "t", None, None, None) for c in range(11, 15)]):
        assert told_trie(prefix_trie.prefix_trie(frame(rows))) == trie_truth(rows)


def test_turns_of_a_conversation_over_partitions(spark):
    """One conversation holds most rows and lies in several partitions."""
    rows = [(0, k // 2, "u", f"{k % 7}", None, None, None) for k in range(600)] + [(c, 0, "u", "x", None, None, None) for c in range(1, 20)]
    want = sorted((t, f"u\n{x}", x) for c, t, _, x, *_ in rows if c == 0)
    got = prefix_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(4)).where("conv = 0").orderBy("q").collect()
    assert [r.q for r in got] == list(range(1, 601)) and [r.cum for r in got] == list(range(1, 601))
    assert [r.unit for r in got] == [hashlib.sha256(f"1:u{x}".encode()).hexdigest()[:32] for _, _, x in want]


def test_lows():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 40):
        v = r.integers(0, 6, n)
        low = prefix_trie.Lows(v)
        for at in range(n + 1):
            for x in range(8):
                assert low.before(at, x) == max([k for k in range(at) if v[k] < x], default=-1)
                assert low.after(at, x) == min([k for k in range(at, n) if v[k] < x], default=n)
            assert all(low.over(a, at) == min(v[a:at], default=prefix_trie.NOBODY) for a in range(at + 1))


# ---------------------------------------------------------------- 12

PAGES = "page_id long, url string, html string, host string, key string, rid int"


def canonical(u: str) -> str:
    rest = u[u.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    host = re.sub(r"^www\.", "", re.sub(r"\.+$", "", re.sub(r":(80|443)?$", "", re.sub(r"^.*@", "", host))))
    path = re.match(r"[^?#]*", tail)[0]
    path = re.sub(r"/$", "", re.sub(r"(/index)?\.html?$", "", re.sub(r"/+", "/", path)))
    query = tail.split("#")[0].partition("?")[2].split("&")
    query = sorted(p for p in query if p and not re.match(urls.TRACKING, p))
    return host and host + path + ("?" + "&".join(query) if query else "")


def judged(u: str | None, rules, listed: set[str]) -> tuple:
    if u is None or "://" not in u:
        return "", "", None, "allow"
    rest = u[u.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if canonical(u) in listed - {""} else "allow"


def addresses() -> list[str | None]:
    r = random.Random(3)
    hosts = ["example.org", "A.Example.ORG", "notexample.org", "org", ".org", "x.com", "com", "www.casino-win.example.net", "casino-win.example.net:443", "me@casino-win.example.net", "free.bets.net", "example.net.", "é.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=1", "/en/2", "/fr/1", "/de/9#top", "//a//b/", "/index.html", "/p.html?b=2&a=1&utm_source=q", "?q=/es/", "#x", "/" + "y" * 3000]
    out = [f"{r.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths]
    return out + [None, "", "no scheme", "://", "a://b://c/d", "http://x.net/\n/es/"] + ["http://hot.example.org/en/1"] * 90


def test_urls(spark):
    every = addresses()
    pages = spark.createDataFrame([(k if k % 3 else None, u, "h", "clash", "clash", 1) for k, u in enumerate(every)], PAGES).repartition(4)
    rules = urls.RULES + [("net", "", "allow"), ("bets.net", "/", "block"), ("", "/es/", "block")]
    listed = {u for u in every if u and "://" in u and set(re.split(r"[.-]", judged(u, [], set())[0])) & set(urls.UNWANTED)}
    got = urls.judge(pages, urls.rule_table(spark, rules), urls.listed_in(pages)).collect()
    for use, df in ((rules, got), (urls.RULES, urls.judge(pages, urls.rule_table(spark), urls.listed_in(pages)).collect())):
        want = Counter((k if k % 3 else None, *judged(u, [x for x in use if x[0]], {canonical(x) for x in listed})) for k, u in enumerate(every))
        assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df) == want


def test_urls_odd(spark):
    none = spark.createDataFrame([], PAGES)
    some = spark.createDataFrame([(1, "http://a.b/c", None, None, None, None)], PAGES)
    no_rules, no_urls = urls.rule_table(spark, []), spark.createDataFrame([], "url string")
    assert urls.judge(none, urls.rule_table(spark), urls.listed_in(none)).count() == 0
    assert [(r.host, r.rule, r.verdict) for r in urls.judge(some, no_rules, no_urls).collect()] == [("a.b", None, "allow")]
    both = urls.rule_table(spark, [("b", "/", "allow"), ("b", "/", "block")])
    assert [(r.rule, r.verdict) for r in urls.judge(some, both, no_urls).collect()] == [("b/", "block")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_bloom(spark, monkeypatch, broadcast):
    """Every key passes, few strangers do, at any number of blocks."""
    if not broadcast:
        monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", 0)
    keys = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("k"))
    filt = bloom.make(keys, keys["k"], 30_000)
    assert filt.blocks == 11 and filt.table.count() == 11
    passed = bloom.told(spark.range(60_000).select("id", F.concat(F.lit("k"), "id").alias("k")), F.col("k"), filt).where("f_maybe")
    ids = {r.id for r in passed.select("id").collect()}
    assert ids >= set(range(30_000)) and len(ids) < 30_000 * 1.02
    nulls = bloom.told(spark.createDataFrame([(None,), ("k1",)], "k string"), F.col("k"), filt).collect()
    assert {r.k: r.f_maybe for r in nulls} == {None: False, "k1": True}


def test_bloom_size_follows_the_keys():
    for n in (0, 10**6, 10**8, 10**9):
        bits = bloom.blocks_for(n) * bloom.BLOCK_BITS
        assert bits >= bloom.KEY_BITS * n
        if n:
            assert (1 - np.exp(-bloom.HASHES * n / bits)) ** bloom.HASHES < 0.01


# ---------------------------------------------------------------- 13


def audit_truth(rows: list[tuple], least: int, top: int) -> set[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for _, t, lang, source, *_ in rows:
        groups.add((lang or "", source or ""))
        df.update((lang or "", w) for w in set(words(t)))
        counts[lang or "", source or ""].update(words(t))
    out = set()
    for lang, source in groups:
        kept = sorted({w for (g, w), n in df.items() if g == lang and n >= least})
        v = len(kept)

        def share(c, kept=kept, v=v):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * v) for w in kept}

        mine = counts[lang, source]
        p, q = share(mine), share(sum((c for (g, _), c in counts.items() if g == lang), Counter()))
        pairs = []
        for s in (s for g, s in groups if g == lang and s != source):
            o = share(counts[lang, s])
            pairs.append((-sum(abs(p[w] - o[w]) for w in kept), s.encode(), s))
        terms = [(q[w] - p[w], w.encode(), w) for w in kept if mine[w] and p[w] > q[w]]
        for part, got in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -x, k) for k, (x, _, item) in enumerate(got, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, docs, rows, odd, none, monkeypatch, small):
    if small:  # several automata, tiles of few sources and terms, counts handed over often
        for name, value in (("SHARD_TERMS", 40), ("FLUSH", 50), ("BLOCK", 2), ("CHUNK", 16)):
            monkeypatch.setattr(divergence, name, value)
    got = [tuple(r) for r in divergence.audit(docs, least_docs=3, top=7).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_truth(rows, 3, 7)
    if small:
        assert {tuple(r) for r in divergence.audit(odd, least_docs=1).collect()} == audit_truth([tuple(r) for r in odd.collect()], 1, 50)
        assert {tuple(r) for r in divergence.audit(odd).collect()} == audit_truth([tuple(r) for r in odd.collect()], 30, 50)
        assert divergence.audit(none).count() == 0


def test_divergence_terms(spark):
    """Terms within terms, neighbours, delimiters of every kind, white space beyond ASCII."""
    texts = ["a aa a\tA a", "ab-a_b a1b", "ÄÖ ä\u00a0b \u2028c", "\U0001f600 x", "a" * 70_000 + " a", "A\x00a\x7fa"] * 2
    rows = [(k, t, "xx", f"s{k % 3}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(df, least_docs=2).collect()} == audit_truth(rows, 2, 50)


def test_shares_of_large_counts(spark):
    n, total, v = 4 * 10**15, 9 * 10**17, 10**6
    got = spark.createDataFrame([(n, total, v)], "n long, t long, v long").select(divergence._p(F.col("n"), F.col("t"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)
